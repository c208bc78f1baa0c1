"""Readers: every one is a Spark scan, split over files and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str | list[str], pattern: str | None = None, deep: bool = False) -> DataFrame:
    """``file, text``: whole files of a path, list or folder (``deep``: folders below too); gz is unpacked."""
    reader = spark.read.option("recursiveFileLookup", deep)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """The texts of the files that a list names, a line each (empty lines don't count)."""
    names = [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()]  # a list of arguments
    return read_texts(spark, names) if names else spark.createDataFrame([], "file string, text string")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line``; files are split by Spark, so lines carry no numbers."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_table(spark: SparkSession, path: str, separator: str = ",", strict: bool = False) -> DataFrame:
    """Delimited rows with a header, quoted fields over lines allowed; ``strict`` fails on malformed ones."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", separator).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)


def read_delimited(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """``file, idx, piece``: files cut at a regular expression, empty pieces left out."""
    whole = read_texts(spark, path)
    return whole.select("file", F.posexplode(F.filter(F.split("text", delimiter), lambda p: p != "")).alias("idx", "piece"))


def read_elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``file, idx, attributes, body`` of a tag's elements (not nested in themselves)."""
    whole = read_texts(spark, path)
    found = F.regexp_extract_all("text", F.lit(rf"(?s)<{tag}(?:\s[^<>]*)?(?:/>|>.*?</{tag}\s*>)"), F.lit(0))
    rows = whole.select("file", F.posexplode(found).alias("idx", "element"))
    pairs = F.regexp_extract_all(F.regexp_extract("element", rf"^<{tag}([^<>]*?)/?>", 1), F.lit(r"""[\w:.-]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.split(p, "=", 2)[0]).alias("key"), F.regexp_replace(F.trim(F.split(p, "=", 2)[1]), r"""^["']|["']$""", "").alias("value")))
    body = F.regexp_extract("element", rf"(?s)^<{tag}[^<>]*(?<!/)>(.*)</{tag}\s*>$", 1)
    return rows.select("file", "idx", F.map_from_entries(F.array_distinct(entries)).alias("attributes"), body.alias("body"))


def read_columns(spark: SparkSession, path: str, names: tuple[str, ...], separator: str = r"\s+", skip: str = "-DOCSTART-") -> DataFrame:
    """Token rows of column files: sentences are blocks between blank lines.

    ``file, block_id, idx`` and the named columns; short rows give nulls,
    lines that begin with ``skip`` are left out.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("block_id"), "value")
    return parse_columns(blocks, names, separator, skip)


def parse_columns(blocks: DataFrame, names: tuple[str, ...], separator: str = r"\s+", skip: str = "-DOCSTART-") -> DataFrame:
    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: (F.trim(x) != "") & ~x.startswith(skip))
    rows = blocks.select("file", "block_id", F.posexplode(lines).alias("idx", "line")).withColumn("c", F.split(F.trim("line"), separator))
    return rows.select("file", "block_id", "idx", *(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))


CONLL_2003 = ("word", "pos", "chunk", "ner")


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """``label, features``: sparse rows ``label i:v ...``; comments after ``#`` don't count."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = spark.read.text(path).select(line.alias("line")).where("line <> ''").select(F.split("line", r"\s+").alias("c"))
    cells = F.transform(F.slice("c", 2, 1 << 30), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("key"), F.split(x, ":")[1].cast("double").alias("value")))
    return rows.select(F.get("c", F.lit(0)).alias("label"), F.map_from_entries(cells).alias("features"))


def tsv_sentences(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """A sentence per line: tab-separated fields; those in braces ``{a,b}`` become arrays."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    return rows.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))


def parse_array(text: Column) -> Column:
    """Items of ``{a,"b,c",d}``; quoted items keep commas, doubled quotes stand for one."""
    inner = F.regexp_extract(text, r"(?s)^\{(.*)\}$", 1)
    items = F.regexp_extract_all(inner, F.lit(r'"(?:[^"]|"")*"|[^,]+'), F.lit(0))
    return F.transform(items, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_json_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Documents that the JSON writer wrote, a line each; the schema is inferred from all of them."""
    return spark.read.option("samplingRatio", 1.0).json(path)


def numbered_lines(lines: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``line_no`` from 0 within a file."""
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)
