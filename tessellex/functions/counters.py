"""Counter algebra: sparse vectors as (key, value) tables.

Every function takes and gives DataFrames with columns ``key`` and ``value``
(two keys ``k1``, ``k2`` for the two-dimensional ones). Aggregations are
partial before they shuffle; keyed binary operations co-group by one full join.
Null keys are dropped, null values count as 0, empty counters give empty
results (scalars: one row with null or 0, as stated).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter(frame: DataFrame, key: Column | str, value: Column | None = None) -> DataFrame:
    """Counts (or sums a value) per key."""
    key = F.col(key) if isinstance(key, str) else key
    keyed = frame.select(key.alias("key"), (F.lit(1.0) if value is None else F.coalesce(value.cast("double"), F.lit(0.0))).alias("v"))
    return keyed.where("key is not null").groupBy("key").agg(F.sum("v").alias("value"))


def total(c: DataFrame) -> DataFrame:
    """One row: sum, size, greatest, least, mean, population deviation."""
    return c.agg(
        F.sum("value").alias("total"),
        F.count("*").alias("size"),
        F.max("value").alias("greatest"),
        F.min("value").alias("least"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("deviation"),
    )


def _with_total(c: DataFrame, value: Column, name: str) -> DataFrame:
    """Attaches a one-row aggregate; it is one row whatever the counter's size."""
    return c.crossJoin(F.broadcast(c.agg(value.alias(name))))


def normalize(c: DataFrame) -> DataFrame:
    """Values divided by their sum."""
    return _with_total(c, F.sum("value"), "t").select("key", (F.col("value") / F.nullif("t", F.lit(0.0))).alias("value"))


def l2_normalize(c: DataFrame) -> DataFrame:
    return _with_total(c, F.sqrt(F.sum(F.col("value") * F.col("value"))), "t").select("key", (F.col("value") / F.nullif("t", F.lit(0.0))).alias("value"))


def entropy(c: DataFrame) -> DataFrame:
    """One row: entropy in bits of the normalized counter."""
    p = F.col("value") / F.col("t")
    return _with_total(c.where("value > 0"), F.sum("value"), "t").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def combine(a: DataFrame, b: DataFrame, how) -> DataFrame:
    """Joins two counters on their keys; missing values are 0."""
    left, right = a.select("key", F.col("value").alias("x")), b.select("key", F.col("value").alias("y"))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return left.join(right, "key", "full").select("key", how(x, y).alias("value"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sums values; one aggregation, no join."""
    return a.unionByName(b).groupBy("key").agg(F.sum("value").alias("value"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Least of both values over the shared keys."""
    return a.join(b.withColumnRenamed("value", "y"), "key").select("key", F.least("value", "y").alias("value"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.withColumnRenamed("value", "y"), "key").select("key", (F.col("value") * F.col("y")).alias("value"))


def division(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quotients over the keys of both; over 0 they are infinite, 0 over 0 is NaN."""
    return combine(a, b, lambda x, y: F.when(y != 0, x / F.nullif(y, F.lit(0.0))).when(x == 0, F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf"))))


def division_defined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Quotients over the keys with a divisor other than 0; a missing dividend is 0."""
    divisors = b.withColumnRenamed("value", "y").where("y <> 0")
    return divisors.join(a, "key", "left").select("key", (F.coalesce("value", F.lit(0.0)) / F.col("y")).alias("value"))


def average(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: (x + y) / 2)


def absolute_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distances over the keys of both; keys of equal values are left out."""
    return combine(a, b, lambda x, y: F.abs(x - y)).where("value > 0")


def linear_combination(a: DataFrame, wa: float, b: DataFrame, wb: float) -> DataFrame:
    return combine(a, b, lambda x, y: x * wa + y * wb)


def similarities(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: dot product, cosine (0 if a counter is all 0), Jaccard
    coefficient (least over greatest values) and Jaccard index of the keys."""
    left, right = a.select("key", F.col("value").alias("x")), b.select("key", F.col("value").alias("y"))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    both = (F.col("x").isNotNull() & F.col("y").isNotNull()).cast("double")
    return left.join(right, "key", "full").agg(
        F.coalesce(F.sum(x * y), F.lit(0.0)).alias("dot"),
        F.coalesce(F.sum(x * y) / F.nullif(F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y)), F.lit(0.0)), F.lit(0.0)).alias("cosine"),
        (F.sum(F.least(x, y)) / F.nullif(F.sum(F.greatest(x, y)), F.lit(0.0))).alias("jaccard"),
        (F.sum(both) / F.nullif(F.count("*"), F.lit(0))).alias("key_jaccard"),
    )


def _information(p: Column, q: Column) -> Column:
    """p log2(p / q): 0 for p = 0, infinite for q = 0."""
    return F.when(p <= 0, F.lit(0.0)).when(q <= 0, F.lit(float("inf"))).otherwise(p * F.log2(p / F.nullif(q, F.lit(0.0))))


def divergences(a: DataFrame, b: DataFrame, skew: float = 0.99) -> DataFrame:
    """One row, in bits over the normalized counters: ``kl`` (infinite if a key
    of the first is missing in the second), ``js``, and ``skew``, the
    divergence from ``skew`` parts of the second mixed with the first."""
    left, right = normalize(a).withColumnRenamed("value", "p"), normalize(b).withColumnRenamed("value", "q")
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    m = (p + q) / 2
    return left.join(right, "key", "full").agg(
        F.sum(_information(p, q)).alias("kl"),
        (F.sum(_information(p, m) + _information(q, m)) / 2).alias("js"),
        F.sum(_information(p, skew * q + (1 - skew) * p)).alias("skew"),
    )


def cross_entropy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: values of the first times log2 of the second's shares, not
    negated; minus infinity if the second lacks a key of the first."""
    joined = a.where("value <> 0").join(normalize(b).withColumnRenamed("value", "q"), "key", "left")
    part = F.when(F.col("q") > 0, F.col("value") * F.log2(F.nullif("q", F.lit(0.0)))).otherwise(F.lit(float("-inf")))
    return joined.agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("cross_entropy"))


def retain_top(c: DataFrame, n: int) -> DataFrame:
    """The n greatest values; ties go by key."""
    return c.orderBy(F.desc("value"), "key").limit(n)


def retain_above(c: DataFrame, least: float) -> DataFrame:
    return c.where(F.col("value") >= least)


def retain_below(c: DataFrame, most: float) -> DataFrame:
    return c.where(F.col("value") <= most)


def retain_keys(c: DataFrame, keys: DataFrame) -> DataFrame:
    """Only the keys of another table."""
    return c.join(keys.select("key").distinct(), "key", "left_semi")


def remove_keys(c: DataFrame, keys: DataFrame) -> DataFrame:
    return c.join(keys.select("key").distinct(), "key", "left_anti")


def keys_below(c: DataFrame, most: float) -> DataFrame:
    return c.where(F.col("value") <= most).select("key")


def keys_above(c: DataFrame, least: float) -> DataFrame:
    return c.where(F.col("value") >= least).select("key")


def keys_at(c: DataFrame, value: float) -> DataFrame:
    return c.where(F.col("value") == value).select("key")


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """``key, x, y, order``: both values and the sign of their difference."""
    left, right = a.select("key", F.col("value").alias("x")), b.select("key", F.col("value").alias("y"))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return left.join(right, "key", "full").select("key", x.alias("x"), y.alias("y"), F.signum(x - y).cast("int").alias("order"))


def equals(a: DataFrame, b: DataFrame, within: float = 0.0) -> DataFrame:
    """One row: whether no value differs by more than ``within``."""
    return absolute_difference(a, b).agg((F.coalesce(F.max("value"), F.lit(0.0)) <= within).alias("equal"))


def sample(c: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``draw, key`` for n draws with replacement, in proportion to the values.

    Draws are placed on the running sum by a range join of buckets; running
    sums come from totals per hash part, so no task sees all keys.
    """
    spark = c.sparkSession
    parts = c.where("value > 0").select("key", "value", F.pmod(F.xxhash64("key"), F.lit(256)).cast("int").alias("part"))
    inside = Window.partitionBy("part").orderBy("key")
    totals = {r.part: r.t for r in parts.groupBy("part").agg(F.sum("value").alias("t")).collect()}  # 256 rows at most
    if not totals:
        return spark.createDataFrame([], "draw bigint, key string")
    starts, at = [], 0.0
    for part in sorted(totals):
        starts.append((part, at, at + totals[part]))
        at += totals[part]
    table = F.broadcast(spark.createDataFrame(starts, "part int, lo double, hi double"))
    draws = spark.range(n).withColumnRenamed("id", "draw")
    unit = (F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))) * F.lit(at)
    draws = draws.withColumn("u", unit).join(table, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "part", (F.col("u") - F.col("lo")).alias("u"))
    ranges = parts.withColumn("end", F.sum("value").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the last range of a part reaches beyond rounding
    ranges = ranges.withColumn("begin", F.col("end") - F.col("value")).withColumn("end", F.when(F.lead("key").over(inside).isNull(), F.lit(float("inf"))).otherwise(F.col("end")))
    points = draws.select("part", F.col("u").alias("at"), F.lit(1).alias("kind"), "draw", F.lit(None).cast("string").alias("key"))
    events = points.unionByName(ranges.select("part", F.col("begin").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("draw"), F.col("key").cast("string").alias("key")))
    line = Window.partitionBy("part").orderBy("at", "kind", "draw").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("key", F.last("key", ignorenulls=True).over(line)).where("kind = 1").select("draw", "key")


def good_turing(c: DataFrame) -> DataFrame:
    """``value, keys, smoothed, unseen``: simple Good-Turing estimates per count.

    Averaged numbers of keys are fitted by a line in log-log space; the count
    itself is used as long as it differs from the fit by more than 1.65
    deviations. ``unseen`` is the share of keys never seen. The table of count
    counts is small: as many rows as there are distinct counts.
    """
    import math

    import pandas as pd

    def fit(batches):
        pdf = pd.concat(list(batches)).sort_values("value")
        r, n = pdf["value"].tolist(), pdf["keys"].tolist()
        if not r:
            return
        total = sum(a * b for a, b in zip(r, n))
        z = [n[i] / (0.5 * ((r[i + 1] if i + 1 < len(r) else 2 * r[i] - (r[i - 1] if i else 0)) - (r[i - 1] if i else 0))) for i in range(len(r))]
        x, y = [math.log(v) for v in r], [math.log(v) for v in z]
        mx, my = sum(x) / len(x), sum(y) / len(y)
        spread = sum((v - mx) ** 2 for v in x)
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / spread if spread else 0.0
        smooth = lambda v: math.exp(my - slope * mx + slope * math.log(v))
        counts, estimates, own = dict(zip(r, n)), [], True
        for v, k in zip(r, n):
            fitted = (v + 1) * smooth(v + 1) / smooth(v)
            if own and v + 1 in counts:
                more = counts[v + 1]
                plain = (v + 1) * more / k
                own = abs(plain - fitted) > 1.65 * math.sqrt((v + 1) ** 2 * more / k**2 * (1 + more / k))
            else:
                own = False
            estimates.append(plain if own else fitted)
        unseen = counts.get(1, 0) / total
        seen = sum(k * e for k, e in zip(n, estimates))
        share = [(1 - unseen) * e / seen for e in estimates]
        yield pd.DataFrame({"value": r, "keys": n, "smoothed": [total * p for p in share], "unseen": unseen})

    per = c.where("value > 0").groupBy(F.round("value").cast("bigint").alias("value")).agg(F.count("*").alias("keys"))
    return per.coalesce(1).mapInPandas(fit, "value bigint, keys bigint, smoothed double, unseen double")


def save_counter(c: DataFrame, path: str) -> None:
    """Lines of key, tab, value."""
    c.select("key", "value").write.mode("overwrite").option("sep", "\t").csv(path)


def load_counter(spark, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("key string, value double").csv(path).where("key is not null")


def argmax(c: DataFrame) -> DataFrame:
    """One row: the least key among those of the greatest value."""
    best = c.agg(F.min(F.struct((-F.col("value")).alias("v"), "key")).alias("s"))
    return best.select(F.col("s.key").alias("key"), (-F.col("s.v")).alias("value"))


def ranks(c: DataFrame) -> DataFrame:
    """Rank by falling value: ``rank`` (ties by key) and ``tied_rank`` (ties averaged).

    Ranks come from counts per distinct value, so no task sorts all keys: the
    running sum is over distinct values only, which partial counts keep few.
    """
    per = c.groupBy("value").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("value", before.alias("before"), "n")
    inside = F.row_number().over(Window.partitionBy("value").orderBy("key"))
    out = c.join(per, "value").withColumn("inside", inside)
    return out.select("key", "value", (F.col("before") + F.col("inside")).cast("bigint").alias("rank"), (F.col("before") + (F.col("n") + 1) / 2).alias("tied_rank"))


def count_counts(c: DataFrame) -> DataFrame:
    """How many keys have each value."""
    return c.groupBy("value").agg(F.count("*").alias("keys"))


def h_index(c: DataFrame) -> DataFrame:
    """One row: greatest h such that h keys have a value of at least h."""
    per = count_counts(c)
    at_least = F.sum("keys").over(Window.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0))
    return per.select(F.floor(F.least("value", at_least.cast("double"))).alias("h")).agg(F.coalesce(F.max("h"), F.lit(0)).cast("bigint").alias("h_index"))


def tf_log(c: DataFrame) -> DataFrame:
    """1 + ln of positive values, 0 for others."""
    return c.select("key", F.when(F.col("value") > 0, 1 + F.log("value")).otherwise(F.lit(0.0)).alias("value"))


def scale_power(c: DataFrame, factor: float, power: float) -> DataFrame:
    return c.select("key", (factor * F.pow("value", F.lit(power))).alias("value"))


def pmi(pairs: DataFrame) -> DataFrame:
    """Pointwise mutual information (bits) of a two-dimensional counter ``k1, k2, value``."""
    rows = pairs.groupBy("k1").agg(F.sum("value").alias("r"))
    cols = pairs.groupBy("k2").agg(F.sum("value").alias("c"))
    all_ = pairs.agg(F.sum("value").alias("t"))
    out = pairs.join(rows, "k1").join(cols, "k2").crossJoin(F.broadcast(all_))
    return out.select("k1", "k2", F.log2(F.col("value") * F.col("t") / (F.col("r") * F.col("c"))).alias("value"))


def row_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("k1").alias("key")).agg(F.sum("value").alias("value"))


def column_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("k2").alias("key")).agg(F.sum("value").alias("value"))


def pivot(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """The dense form, for a stated list of second keys."""
    return pairs.groupBy("k1").agg(*(F.sum(F.when(F.col("k2") == c, F.col("value")).otherwise(0.0)).alias(c) for c in columns))
