"""Annotators by name, their prerequisites, and pipelines of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.operators import entities, normalize
from tessellex.operators.tokenize import TokenOptions, annotate_tokens, capital_tokens, lemma, stem

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Annotator:
    """Adds tables to the tables of a pipeline; ``requires`` are other annotators."""

    name: str
    requires: tuple[str, ...]
    run: Callable[[Frames, dict[str, str]], Frames]


REGISTRY: dict[str, Annotator] = {}


def annotator(name: str, *requires: str):
    def add(run):
        REGISTRY[name] = Annotator(name, requires, run)
        return run

    return add


def plan(names: list[str]) -> list[str]:
    """Prerequisite closure in an order that satisfies every requirement."""
    out: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError(f"annotators need each other: {' > '.join((*above, name))}")
        if name not in REGISTRY:
            raise ValueError(f"no annotator {name!r}; known: {', '.join(sorted(REGISTRY))}")
        if name not in out:
            for r in REGISTRY[name].requires:
                visit(r, (*above, name))
            out.append(name)

    for n in names:
        visit(n, ())
    return out


class Pipeline:
    """``Pipeline({"annotators": "tokenize,ner"}).annotate(docs)`` gives tables by name.

    ``docs``: doc_id, text, and doc_date if times are to be resolved.
    """

    def __init__(self, properties: dict[str, str]):
        self.properties = properties
        self.order = plan([a.strip() for a in properties.get("annotators", "tokenize").split(",") if a.strip()])

    def annotate(self, docs: DataFrame, **resources: DataFrame) -> Frames:
        frames: Frames = {"documents": docs, **resources}
        for name in self.order:
            frames |= REGISTRY[name].run(frames, self.properties)
        return frames


def _flag(props: dict[str, str], name: str, default: bool = False) -> bool:
    return props.get(name, str(default)).lower() == "true"


@annotator("cleanxml")
def _cleanxml(frames: Frames, props: dict[str, str]) -> Frames:
    text = F.regexp_replace(F.regexp_replace("text", r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", ""), r"<[^<>]+>", " ")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return {"documents": frames["documents"].withColumn("text", text)}


@annotator("docdate")
def _docdate(frames: Frames, props: dict[str, str]) -> Frames:
    docs = frames["documents"]
    own = F.col("doc_date") if "doc_date" in docs.columns else F.lit(None).cast("string")
    fixed = F.lit(props["docdate.useFixedDate"]) if "docdate.useFixedDate" in props else F.lit(None).cast("string")
    return {"documents": docs.withColumn("doc_date", F.coalesce(fixed, own))}


@annotator("tokenize")
def _tokenize(frames: Frames, props: dict[str, str]) -> Frames:
    options = TokenOptions(ptb3_escaping=_flag(props, "tokenize.ptb3Escaping"), ascii_quotes=_flag(props, "tokenize.asciiQuotes"), americanize=_flag(props, "tokenize.americanize"), split_hyphenated=_flag(props, "tokenize.splitHyphenated"))
    policy = props.get("ssplit.newlineIsSentenceBreak", "TWO_CONSECUTIVE").upper()
    rows = annotate_tokens(frames["documents"], options, policy)
    sentences = rows.select("doc_id", F.posexplode("sentences").alias("sentence", "s")).select("doc_id", "sentence", "s.begin_token", "s.end_token")
    number = F.transform("sentences", lambda s: s["begin_token"])
    tokens = rows.select("doc_id", F.explode("tokens").alias("t"), number.alias("begins"))
    sentence = F.size(F.filter("begins", lambda b: b <= F.col("t.idx"))) - 1
    return {"annotated": rows, "sentences": sentences, "tokens": tokens.select("doc_id", sentence.alias("sentence"), "t.*"), "capitals": capital_tokens(frames["documents"], options, policy)}


@annotator("ssplit", "tokenize")
def _ssplit(frames: Frames, props: dict[str, str]) -> Frames:
    return {}


@annotator("pos", "tokenize")
def _pos(frames: Frames, props: dict[str, str]) -> Frames:
    """Lexicon tags where a ``tag_lexicon`` (word, tag) is given, else suffix rules."""
    w, low = F.col("word"), F.lower("word")
    rules = (
        F.when(w.rlike(r"^[^\p{L}\p{N}]+$"), w)
        .when(w.rlike(r"^[0-9]"), "CD")
        .when(low.isin("the", "a", "an", "this", "that", "every"), "DT")
        .when(low.isin("in", "on", "at", "by", "of", "for", "with", "near", "under", "from"), "IN")
        .when(low.isin("and", "or", "but"), "CC")
        .when(low.isin("he", "she", "it", "they", "we", "i", "you", "him", "her", "them"), "PRP")
        .when(low.isin("is", "has", "does"), "VBZ")
        .when(w.rlike(r"^\p{Lu}") & (F.col("idx") > 0), "NNP")
        .when(low.endswith("ly"), "RB")
        .when(low.endswith("ing"), "VBG")
        .when(low.endswith("ed"), "VBD")
        .when(low.rlike("(ous|ful|ive|al|able)$"), "JJ")
        .when(low.endswith("s") & (F.length(low) > 3), "NNS")
        .otherwise("NN")
    )
    tokens = frames["tokens"]
    if "tag_lexicon" in frames:
        from tessellex.session import broadcast_checked

        lexicon = broadcast_checked(frames["tag_lexicon"].groupBy(F.col("word")).agg(F.min("tag").alias("known")), 500_000)
        return {"tokens": tokens.join(lexicon, "word", "left").withColumn("tag", F.coalesce("known", rules)).drop("known")}
    return {"tokens": tokens.withColumn("tag", rules)}


@annotator("lemma", "pos")
def _lemma(frames: Frames, props: dict[str, str]) -> Frames:
    @F.pandas_udf("string")
    def lemmas(word: pd.Series, tag: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else lemma(w, t or "") for w, t in zip(word, tag)], dtype=object)

    return {"tokens": frames["tokens"].withColumn("lemma", lemmas("word", "tag"))}


@annotator("stem", "tokenize")
def _stem(frames: Frames, props: dict[str, str]) -> Frames:
    @F.pandas_udf("string")
    def stems(word: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else stem(w) for w in word], dtype=object)

    return {"tokens": frames["tokens"].withColumn("stem", stems("word"))}


@annotator("regexner", "tokenize")
def _regexner(frames: Frames, props: dict[str, str]) -> Frames:
    phrases = entities.phrase_table(frames["phrases"])
    return {"gazetteer": entities.gazetteer_matches(frames["documents"], phrases)}


@annotator("time", "docdate")
def _time(frames: Frames, props: dict[str, str]) -> Frames:
    return {"times": normalize.annotate_times(frames["documents"], date_column="doc_date")}


@annotator("ner", "tokenize", "lemma", "time")
def _ner(frames: Frames, props: dict[str, str]) -> Frames:
    """Numbers, dates and name-like runs as labels of tokens."""
    tokens = frames["tokens"]
    times = frames["times"].select("doc_id", F.col("begin_char").alias("tb"), F.col("end_char").alias("te"), "type", "value")
    joined = tokens.join(times, (tokens.doc_id == times.doc_id) & (F.col("begin_char") >= F.col("tb")) & (F.col("end_char") <= F.col("te")), "left").drop(times.doc_id)
    name = (F.col("tag") == "NNP").cast("boolean")
    label = F.when(F.col("type").isNotNull(), F.col("type")).when(F.col("word").rlike(r"^[0-9][0-9.,]*$"), "NUMBER").when(name, "PERSON").otherwise("O")
    return {"tokens": joined.withColumn("ner", label).drop("tb", "te", "type")}


@annotator("entitymentions", "ner")
def _mentions(frames: Frames, props: dict[str, str]) -> Frames:
    return {"mentions": entities.entity_mentions(frames["tokens"], ["doc_id", "sentence"], "idx", "ner", "word", "value")}


@annotator("coref", "entitymentions")
def _coref(frames: Frames, props: dict[str, str]) -> Frames:
    """Chains of the PERSON mentions. Without a lexicon only tokens in capitals can
    be names, so only those are read; other tokens part mentions by their gaps."""
    named = frames if "tag_lexicon" in frames else frames | _pos({"tokens": frames["capitals"]}, props)
    named = _ner({"tokens": named["tokens"].where("tag = 'NNP'").select("doc_id", "sentence", "idx", "word", "tag", "begin_char", "end_char"), "times": frames["times"]}, props)
    mentions = entities.entity_mentions(named["tokens"].where("ner = 'PERSON'"), ["doc_id", "sentence"], "idx", "ner", "word", "value")
    return {"chains": entities.name_chains(mentions)}


@annotator("quote")
def _quote(frames: Frames, props: dict[str, str]) -> Frames:
    return {"quotes": entities.annotate_quotes(frames["documents"])}
