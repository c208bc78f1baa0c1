"""Chunks over token rows: label schemes, spans, attribute aggregation, scores.

Tables of tokens have group columns (a sentence), an order column and a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Schemes that labels can be written in.
SCHEMES = ("io", "iob1", "iob2", "ioe1", "ioe2", "sbieo", "bilou", "noprefix")


def label_runs(tokens: DataFrame, group: list[str], order: str, label: str) -> DataFrame:
    """Adds ``type`` (null outside), ``starts`` and ``ends`` of chunks.

    Any scheme is read: a chunk starts at B, S or U, where the type changes,
    after a token that ends one (E, L, S, U), and after tokens outside.
    """
    line = Window.partitionBy(*group).orderBy(order)
    prefix = F.when(F.col(label).rlike("^[BILESUO]-"), F.substring(label, 1, 1))
    kind = F.when(F.col(label).rlike("^[BILESU]-"), F.substring(F.col(label), 3, 1 << 20)).when(F.col(label) != "O", F.col(label))
    rows = tokens.withColumn("_prefix", prefix).withColumn("type", F.nullif(kind, F.lit("")))
    before, last = F.lag("type").over(line), F.lag("_prefix").over(line)
    starts = F.col("type").isNotNull() & (F.coalesce(F.col("_prefix").isin("B", "S", "U"), F.lit(False)) | ~F.col("type").eqNullSafe(before) | F.coalesce(last.isin("E", "L", "S", "U"), F.lit(False)))
    rows = rows.withColumn("starts", starts)
    after = F.lead("type").over(line)
    ends = F.col("type").isNotNull() & (after.isNull() | F.coalesce(F.lead("starts").over(line), F.lit(True)))
    return rows.withColumn("ends", ends).drop("_prefix")


def convert_labels(tokens: DataFrame, group: list[str], order: str, label: str, scheme: str, name: str = "converted") -> DataFrame:
    """Adds the label in another scheme; outside is ``O`` in all of them."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme}")
    line = Window.partitionBy(*group).orderBy(order)
    rows = label_runs(tokens, group, order, label)
    first, last = F.col("starts"), F.col("ends")
    touches = first & F.col("type").eqNullSafe(F.lag("type").over(line))  # right after a chunk of its type
    touched = last & F.col("type").eqNullSafe(F.lead("type").over(line))
    prefix = {
        "io": F.lit("I-"),
        "noprefix": F.lit(""),
        "iob1": F.when(touches, "B-").otherwise("I-"),
        "iob2": F.when(first, "B-").otherwise("I-"),
        "ioe1": F.when(touched, "E-").otherwise("I-"),
        "ioe2": F.when(last, "E-").otherwise("I-"),
        "sbieo": F.when(first & last, "S-").when(first, "B-").when(last, "E-").otherwise("I-"),
        "bilou": F.when(first & last, "U-").when(first, "B-").when(last, "L-").otherwise("I-"),
    }[scheme]
    out = F.when(F.col("type").isNull(), "O").otherwise(F.concat(prefix, F.col("type")))
    return rows.withColumn(name, out).drop("type", "starts", "ends")


def labelled_spans(tokens: DataFrame, group: list[str], order: str, label: str) -> DataFrame:
    """``group.., type, begin, end`` of the chunks (end exclusive)."""
    line = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = label_runs(tokens, group, order, label).where("type is not null").withColumn("_chunk", F.sum(F.col("starts").cast("int")).over(line))
    return rows.groupBy(*group, "_chunk", "type").agg(F.min(order).alias("begin"), (F.max(order) + 1).alias("end")).drop("_chunk")


def aggregate_chunks(tokens: DataFrame, group: list[str], order: str, how: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per group: ``name -> (attribute, way)``.

    Ways: FIRST, LAST, FIRST_NON_NIL, LAST_NON_NIL, COUNT, SUM, MIN, MAX,
    MOST_FREQ (least value on ties), CONCAT (no glue) and CONCAT_TEXT (blanks).
    """
    out = []
    for name, (attribute, way) in how.items():
        value = F.col(attribute)
        pair = F.struct(F.col(order).alias("o"), value.alias("v"))
        listed = F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), pair))), lambda x: x["v"].cast("string"))
        ways: dict[str, Column] = {
            "FIRST": F.min_by(pair, order)["v"],
            "LAST": F.max_by(pair, order)["v"],
            "FIRST_NON_NIL": F.min_by(value, F.when(value.isNotNull(), F.col(order))),
            "LAST_NON_NIL": F.max_by(value, F.when(value.isNotNull(), F.col(order))),
            "COUNT": F.count(value),
            "SUM": F.sum(value),
            "MIN": F.min(value),
            "MAX": F.max(value),
            "MOST_FREQ": F.mode(value, True) if attribute else value,
            "CONCAT": F.array_join(listed, ""),
            "CONCAT_TEXT": F.array_join(listed, " "),
        }
        out.append(ways[way].alias(name))
    return tokens.groupBy(*group).agg(*out)


def span_scores(gold: DataFrame, guess: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of spans, by ``type`` and over all (``type`` null).

    Spans are equal if all ``keys`` and the type are; repeated ones count once.
    """
    left = gold.select(*keys, "type").distinct().withColumn("_g", F.lit(1))
    right = guess.select(*keys, "type").distinct().withColumn("_p", F.lit(1))
    both = left.join(right, [*keys, "type"], "full").select("type", F.coalesce("_g", F.lit(0)).alias("g"), F.coalesce("_p", F.lit(0)).alias("p"))
    sums = both.rollup("type").agg(F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return sums.select("type", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def class_scores(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """Precision, recall and F1 per class of labelled rows; nulls are a class of their own name ``O``."""
    g, p = F.coalesce(F.col(gold).cast("string"), F.lit("O")), F.coalesce(F.col(guess).cast("string"), F.lit("O"))
    cells = rows.groupBy(g.alias("g"), p.alias("p")).agg(F.count("*").alias("n"))
    sides = cells.select(F.explode(F.array_distinct(F.array("g", "p"))).alias("label"), "g", "p", "n").groupBy("label")
    hit = (F.col("g") == F.col("label")) & (F.col("p") == F.col("label"))
    sums = sides.agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit & (F.col("p") == F.col("label")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit & (F.col("g") == F.col("label")), F.col("n")).otherwise(0)).alias("fn"),
    )
    precision = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    recall = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return sums.select("label", "tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).alias("f1"))


def accuracy(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """One row: share of rows whose guess is right, and their number."""
    return rows.agg(F.avg(F.col(gold).eqNullSafe(F.col(guess)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def precision_recall_curve(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """``score, found, hits, precision, recall``: at each distinct score as the cut.

    The running sums are over distinct scores, counted before.
    """
    per = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(positive).cast("int"), F.lit(0))).alias("k"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.select("score", F.sum("n").over(down).alias("found"), F.sum("k").over(down).alias("hits"))
    total = per.agg(F.sum("k").alias("total"))
    return out.crossJoin(F.broadcast(total)).select("score", "found", "hits", (F.col("hits") / F.col("found")).alias("precision"), (F.col("hits") / F.nullif("total", F.lit(0))).alias("recall"))


def information_gain(rows: DataFrame, feature: str, label: str, row: str) -> DataFrame:
    """``feature, gain`` in bits of knowing whether a row has a feature.

    ``rows``: a feature per line; a row's repeated features count once.
    """
    seen = rows.select(F.col(row).alias("r"), F.col(label).alias("l"), F.col(feature).alias("feature")).distinct()
    labels = seen.select("r", "l").distinct().groupBy("l").agg(F.count("*").alias("nl"))
    total = labels.agg(F.sum("nl").alias("n"))
    cells = seen.where("feature is not null").groupBy("feature", "l").agg(F.count("*").alias("c"))
    sums = cells.groupBy("feature").agg(F.sum("c").alias("nf"))
    grid = cells.join(labels, "l").join(sums, "feature").crossJoin(F.broadcast(total))  # one row
    part = lambda k, a, b: F.when(k > 0, k / F.col("n") * F.log2(k * F.col("n") / (a * F.nullif(b, F.lit(0))))).otherwise(F.lit(0.0))
    rest = F.col("n") - F.col("nf")
    cell = part(F.col("c"), F.col("nl"), F.col("nf")) + part(F.col("nl") - F.col("c"), F.col("nl"), rest)
    per = grid.groupBy("feature", "n", "nf").agg(F.sum(cell).alias("seen"), F.sum("nl").alias("covered"))
    # labels that never come with the feature: all their rows are without it
    others = F.col("n") - F.col("covered")
    return per.select("feature", (F.col("seen") + F.when((others > 0) & (rest > 0), others / F.col("n") * F.log2(F.col("n") / F.nullif(rest, F.lit(0)))).otherwise(F.lit(0.0))).alias("gain"))
