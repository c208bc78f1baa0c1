"""Documents into containers of fixed capacity, with as little room left as possible.

Best fit in bulk-synchronous rounds over documents and containers as rows. As
many containers as the tokens need are opened at once. A round sorts documents
and gaps by size together and reads them as brackets: a document opens, a gap
closes. Documents and gaps that match as brackets are placed: every gap gets
the largest document below it that no nearer gap takes, so one sweep settles
all conflicts by rank. Gaps shrink, and the next round begins; where nothing
fits, new containers are opened for what is left.

The depth of a bracket follows from the number of rows of each size before it
(a table bounded by the capacity) and from its rank among those of its size;
sizes that very many rows share are numbered in salted parts. Brackets of one
depth, at most two per size, are then matched within a window.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellex.session import collect_bounded, cut_lineage

#: Rank file of a public tokenizer, and the pattern that splits text before its merges.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Containers opened beyond what the tokens need, and the most documents a container opened later is meant for:
#: both keep the rounds few, at a cost of a 500th of the fill at most.
SPARE, LATE_ITEMS = 0.002, 32
SIZES_SCHEMA = "doc_id bigint, part_no bigint, begin_token bigint, end_token bigint, value int, key bigint"


@lru_cache(maxsize=4)
def tokenizer(ranks: str, pattern: str = GPT_PATTERN):
    """A byte-level BPE tokenizer from a rank file (one ``base64 rank`` a line)."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def token_sizes(docs: DataFrame, capacity: int, ranks: str = DEFAULT_RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Items to pack: whole documents, or the parts of those over the capacity.

    ``value`` is the size; ``key`` numbers the items (task, then place in it).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(ranks).encode_ordinary
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                n = len(encode(text)) if text else 0
                for part, lo in enumerate(range(0, n, capacity)):
                    hi = min(n, lo + capacity)
                    rows.append((None if pd.isna(doc_id) else int(doc_id), part, lo, hi, hi - lo, key))
                    key += 1
            yield pd.DataFrame(rows, columns=["doc_id", "part_no", "begin_token", "end_token", "value", "key"], dtype=object)

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInPandas(run, SIZES_SCHEMA)


def _tally(events: DataFrame, capacity: int) -> dict[tuple[int, int], int]:
    """Rows by size and kind (0 document, 1 gap)."""
    rows = collect_bounded(events.groupBy("value", "kind").agg(F.count("*").alias("n")), 2 * (capacity + 1), "sizes up to the capacity")
    return {(r["value"], r["kind"]): r["n"] for r in rows}


def _numbered(events: DataFrame, tally: dict[tuple[int, int], int], part_rows: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """Rows with ``salt`` and ``nth`` in it, and where each (size, kind, salt) starts among its size."""
    hot = {k: -(-n // part_rows) for k, n in tally.items() if n > part_rows}
    if hot:
        spark = events.sparkSession
        parts = F.broadcast(spark.createDataFrame([(*k, n) for k, n in hot.items()], "value int, kind int, parts int"))
        events = events.join(parts, ["value", "kind"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
        counts = collect_bounded(events.groupBy("value", "kind", "salt").agg(F.count("*").alias("n")), len(tally) + sum(hot.values()), "parts of sizes")
        cells = sorted((r["value"], r["kind"], r["salt"], r["n"]) for r in counts)
    else:
        events = events.withColumn("salt", F.lit(0))
        cells = sorted((v, k, 0, n) for (v, k), n in tally.items())
    starts, last, at = [], None, 0
    for value, kind, salt, n in cells:
        at = 0 if (value, kind) != last else at
        last = (value, kind)
        starts.append((value, kind, salt, at))
        at += n
    nth = F.row_number().over(Window.partitionBy("value", "kind", "salt").orderBy("key")) - 1
    return events.withColumn("nth", nth), starts


def match_round(events: DataFrame, tally: dict[tuple[int, int], int], part_rows: int = 200_000) -> DataFrame:
    """One sweep: documents (kind 0) and gaps (kind 1) with what they are matched with.

    ``other``/``room``: for a matched document its container and the gap it
    had; ``taken``: whether a gap was given to a document.
    """
    spark = events.sparkSession
    numbered, starts = _numbered(events, tally, part_rows)
    depth, base = 0, {}
    for value, kind in sorted(tally):  # a document comes before a gap of its size: it fits
        base[(value, kind)] = depth
        depth += tally[(value, kind)] * (1 if kind == 0 else -1)
    rows = [(v, k, s, base[(v, k)] + (1 + at if k == 0 else -at)) for v, k, s, at in starts]
    table = F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=["value", "kind", "salt", "start"]), "value int, kind int, salt int, start bigint"))
    placed = numbered.join(table, ["value", "kind", "salt"]).withColumn("depth", F.col("start") + F.when(F.col("kind") == 0, F.col("nth")).otherwise(-F.col("nth")))
    line = Window.partitionBy("depth").orderBy("value", "kind")
    closes = (F.col("kind") == 0) & (F.lead("kind").over(line) == 1)
    return placed.select(
        "value",
        "kind",
        "key",
        F.when(closes, F.lead("key").over(line)).alias("other"),
        F.when(closes, F.lead("value").over(line)).alias("room"),
        F.coalesce((F.col("kind") == 1) & (F.lag("kind").over(line) == 0), F.lit(False)).alias("taken"),
    )


def place_items(items: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """``key, container, offset_token`` for items (``key``, ``value`` tokens), and the rounds it took."""
    spark = items.sparkSession
    events = items.select("value", F.lit(0).alias("kind"), "key")
    tally = _tally(events, capacity)
    done, opened, rounds, stuck = [], 0, 0, True
    while any(kind == 0 for _, kind in tally):
        if stuck:  # nothing fits any more: open what the tokens left need
            left = sum(v * n for (v, kind), n in tally.items() if kind == 0)
            fresh = -(-left // capacity)
            fresh = max(fresh, -(-sum(n for (_, kind), n in tally.items() if kind == 0) // LATE_ITEMS)) if opened else int(fresh * (1 + SPARE)) or 1
            gaps = spark.range(opened, opened + fresh).select(F.lit(capacity).alias("value"), F.lit(1).alias("kind"), F.col("id").alias("key"))
            events = events.where("kind = 0").unionByName(gaps)
            tally = {k: n for k, n in tally.items() if k[1] == 0} | {(capacity, 1): fresh}
            opened += fresh
        matched = cut_lineage(match_round(events, tally))
        done.append(matched.where("other is not null").select("key", F.col("other").alias("container"), (F.lit(capacity) - F.col("room")).alias("offset_token")))
        kept = matched.where("other is null and not taken").select("value", "kind", "key")
        smaller = matched.where("room > value").select((F.col("room") - F.col("value")).alias("value"), F.lit(1).alias("kind"), F.col("other").alias("key"))
        before = sum(n for (_, kind), n in tally.items() if kind == 0)
        events = kept.unionByName(smaller)
        tally = _tally(events, capacity)
        stuck = before == sum(n for (_, kind), n in tally.items() if kind == 0)
        rounds += 1
    if not done:
        return spark.createDataFrame([], "key bigint, container bigint, offset_token int"), 0
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, rounds


def pack_documents(docs: DataFrame, capacity: int = 2048, ranks: str = DEFAULT_RANKS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document in a container of ``capacity`` tokens.

    Result: ``doc_id, part_no, begin_token, end_token, n_tokens, container,
    offset_token``. A document is split (into parts of the capacity and a
    rest) only if it alone exceeds a container. Of a size under a 64th of the
    capacity, one document per container is placed by itself; further ones go
    in bundles of up to a 32nd, so that the rounds stay few in a corpus of
    tiny texts.

    Null and empty texts have no tokens and give no rows; a null id stays
    null; repeated rows are packed each for itself; further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # written once: row keys must not change if a task is run again
    sizes = cut_lineage(token_sizes(docs, capacity, ranks, id_column, text_column))
    tally = _tally(sizes.select("value", F.lit(0).alias("kind")), capacity)
    containers = -(-sum(v * n for (v, _), n in tally.items()) // capacity)
    bundles = {v: capacity // 32 // v for (v, _), n in tally.items() if v * 64 < capacity and n > containers and capacity // 32 // v > 1}
    single = sizes.where(~F.col("value").isin(list(bundles))) if bundles else sizes
    member = single.withColumn("item", F.col("key")).withColumn("inside", F.lit(0))
    items = single.select("key", "value")
    if bundles:
        small = sizes.where(F.col("value").isin(list(bundles))).withColumn("kind", F.lit(0))
        numbered, starts = _numbered(small, {(v, 0): n for (v, _), n in tally.items() if v in bundles}, 200_000)
        facts = spark.createDataFrame([(v, s, at, bundles[v], tally[(v, 0)]) for v, _, s, at in starts], "value int, salt int, start bigint, width int, n bigint")
        rank = F.col("start") + F.col("nth")
        over = rank - F.lit(containers)
        placed = numbered.join(F.broadcast(facts), ["value", "salt"]).withColumn("rank", rank)
        placed = placed.withColumn("at", F.when(over >= 0, F.pmod(over, F.col("width"))).otherwise(0)).withColumn("first", F.col("rank") - F.col("at"))
        # negative keys: the size and the rank of the bundle's first document
        placed = cut_lineage(placed.withColumn("item", -(F.col("first") * F.lit(capacity) + F.col("value"))).withColumn("inside", (F.col("at") * F.col("value")).cast("int")))
        size = F.when(F.col("rank") < containers, F.col("value")).otherwise(F.col("value") * F.least(F.col("width").cast("bigint"), F.col("n") - F.col("first")))
        items = items.unionByName(placed.where("at = 0").select(F.col("item").alias("key"), size.cast("int").alias("value")))
        member = member.unionByName(placed.select(*member.columns))
    found, _ = place_items(items, capacity)
    placed = member.join(found.withColumnRenamed("key", "item"), "item")
    return placed.select(
        "doc_id",
        "part_no",
        "begin_token",
        "end_token",
        F.col("value").cast("bigint").alias("n_tokens"),
        "container",
        (F.col("offset_token") + F.col("inside")).cast("bigint").alias("offset_token"),
    )


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """How full the containers are: one row of totals."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    totals = per.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("fullest"))
    return totals.withColumn("fill", F.col("tokens") / (F.col("containers") * F.lit(capacity)))
