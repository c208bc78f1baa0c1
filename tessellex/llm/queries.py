"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.llm.canonical import canonical_documents, reading_classes, reading_pairs
from tessellex.llm.language import document_languages, fit_languages, language_segments, wrongly_labelled
from tessellex.llm.leakage import leaked_documents, leaked_sentences
from tessellex.llm.packing import container_fill, pack_documents
from tessellex.llm.reading import fit_levels, reading_levels
from tessellex.llm.sentences import fit_periods, sentence_units
from tessellex.llm.split import oversized_blocks, split_documents
from tessellex.operators.nested import nested_rows
from tessellex.session import collect_bounded, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can express it, its SQL."""

    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def size_limit(spark: SparkSession, folder: str, counted_in: str) -> tuple[int, int]:
    """Capacity and overlap that are counted in the given unit."""
    rows = collect_bounded(table(spark, folder, "size_limits"), 100, "size limits")
    row = next(r for r in rows if (r.counted_in or "").startswith(counted_in))
    return int(row.capacity), int(row.overlap or 0)


@query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = size_limit(spark, folder, "char")
    return oversized_blocks(table(spark, folder, "documents", "doc_id", "text"), limit, overlap)


@query("p1_pieces")
def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    limit, overlap = size_limit(spark, folder, "char")
    return split_documents(table(spark, folder, "documents", "doc_id", "text"), limit, overlap)


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return reading_pairs(table(spark, folder, "documents", "doc_id", "text"))


@query("p5_classes")
def p5_classes(spark: SparkSession, folder: str) -> DataFrame:
    return reading_classes(table(spark, folder, "documents", "doc_id", "text"))


@query("p5_texts")
def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_documents(table(spark, folder, "documents", "doc_id", "text"))


@query("p4_found")
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = fit_periods(docs, table(spark, folder, "lang_samples", "lang", "text"))
    return sentence_units(docs, model)


@query("p4_texts")
def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The units with their texts."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = fit_periods(docs, table(spark, folder, "lang_samples", "lang", "text"))
    return sentence_units(docs, model, with_text=True)


@query("p4_payloads")
def p4_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Units of the payloads' own texts, beside the sentences they came with."""
    docs = table(spark, folder, "documents", "doc_id", "text")
    model = fit_periods(docs, table(spark, folder, "lang_samples", "lang", "text"))
    records = table(spark, folder, "annotation_records", "record_id", "payload")
    texts = F.coalesce(F.get_json_object("payload", "$.text"), F.get_json_object("payload", "$.document.text"))
    texts = records.select(F.col("record_id").alias("doc_id"), texts.alias("text")).distinct()
    units = sentence_units(texts, model).withColumnRenamed("doc_id", "record_id")
    given = nested_rows(records, kinds=("sentence",)).select(
        "record_id",
        F.coalesce(F.col("fields")["characteroffsetbegin"].try_cast("bigint"), F.lit(0)).alias("begin_char"),
        F.col("fields")["characteroffsetend"].try_cast("bigint").alias("end_char"),
    )
    given = given.distinct().withColumn("given", F.lit(True))
    return units.join(given, ["record_id", "begin_char", "end_char"], "full").withColumn("given", F.coalesce("given", F.lit(False)))


def _language_net(spark: SparkSession, folder: str):
    docs = table(spark, folder, "documents", "doc_id", "text", "lang")
    return docs, fit_languages(table(spark, folder, "lang_samples", "lang", "text"), docs)


@query("p2_found")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, net = _language_net(spark, folder)
    return wrongly_labelled(document_languages(docs, net))


@query("p2_segments")
def p2_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches in one language with their confidence."""
    docs, net = _language_net(spark, folder)
    return language_segments(docs, net)


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_documents(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("p7_sentences")
def p7_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Every leaked sentence, also those that came back with other parameters."""
    return leaked_sentences(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text"))


@query("p6_containers")
def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity, _ = size_limit(spark, folder, "token")
    return pack_documents(table(spark, folder, "documents", "doc_id", "text"), capacity)


@query("p6_fill")
def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Number of containers and how full they are."""
    capacity, _ = size_limit(spark, folder, "token")
    return container_fill(pack_documents(table(spark, folder, "documents", "doc_id", "text"), capacity), capacity)


def _levels(spark: SparkSession, folder: str):
    docs = table(spark, folder, "documents", "doc_id", "text", "n_chars", "source")
    model = fit_levels(docs, table(spark, folder, "labels", "doc_id", "level"), table(spark, folder, "lang_samples", "lang", "text"))
    return docs, model


@query("p8_found")
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs, model = _levels(spark, folder)
    levels = reading_levels(docs.where("n_chars >= 400"), model)
    return levels.select("doc_id", F.col("level").cast("string").alias("level"))


@query("p8_profile")
def p8_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per source and level, for profiles of the corpus."""
    docs, model = _levels(spark, folder)
    return reading_levels(docs, model, "source").groupBy("source", "level").agg(F.count("*").alias("documents"), F.avg("score").alias("score"))
