"""CoNLL-U reader and CoNLL writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONLLU = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def conll_line(*columns: str) -> Column:
    """Tab-separated line; nulls, empty values and negative heads as ``_``."""
    cells = []
    for c in columns:
        value = F.col(c).cast("string")
        if c == "head":
            value = F.when(F.col(c) >= 0, value)
        cells.append(F.coalesce(F.nullif(value, F.lit("")), F.lit("_")))
    return F.concat_ws("\t", *cells)


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """Token rows of CoNLL-U files: sentences are blocks between blank lines.

    Every file block is one row first (``lineSep`` of two line feeds), so
    files split by Spark keep their sentences whole.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).withColumn("file", F.col("_metadata.file_path"))
    return parse_conllu(blocks.select("file", F.monotonically_increasing_id().alias("block_id"), "value"))


def parse_conllu(blocks: DataFrame) -> DataFrame:
    """``file, block_id, sent_id`` and the ten CoNLL-U fields of text blocks."""
    text = F.regexp_replace("value", "\r", "")
    rows = blocks.select("file", "block_id", F.nullif(F.regexp_extract(text, r"(?m)^# sent_id = (.*)$", 1), F.lit("")).alias("sent_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = rows.where("line <> '' and not startswith(line, '#')").withColumn("f", F.split("line", "\t"))
    cell = lambda i: F.nullif(F.get("f", F.lit(i)), F.lit("_"))
    # the form and the lemma may be an underscore themselves
    fields = [F.get("f", F.lit(i)).alias(c) if c in ("id", "form", "lemma") else cell(i).alias(c) for i, c in enumerate(CONLLU)]
    out = rows.select("file", "block_id", "line_no", "sent_id", *fields)
    return out.withColumn("head", F.col("head").try_cast("int")).withColumn("feats", F.when(F.col("feats").isNotNull(), F.str_to_map("feats", F.lit(r"\|"), F.lit("="))))
