"""Scalar text and array functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"\p{L}+"


def words(docs: DataFrame, pattern: str = WORD, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per match of a pattern: ``keep..., idx, word`` (idx from 0)."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return docs.select(*keep, F.posexplode(found).alias("idx", "word"))


def whitespace_tokens(text: Column) -> Column:
    """Array of the maximal runs without blank, tab, carriage return or line feed."""
    return F.regexp_extract_all(text, F.lit(r"[^ \t\r\n]+"), F.lit(0))


def ngrams(tokens: Column, n: int, separator: str = " ") -> Column:
    """Array of the joined n-grams of an array of tokens."""
    at = F.sequence(F.lit(0), F.size(tokens) - n)
    return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i + 1, n), separator))).otherwise(F.array().cast("array<string>"))


def char_ngrams(text: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substring(text, i, n))).otherwise(F.array().cast("array<string>"))


def shape_dan1(word: Column) -> Column:
    """Coarse word shape; the empty word counts as digits, one capital as upper."""
    return (
        F.when(word.rlike(r"^\p{Nd}*$"), "ALL-DIGITS")
        .when(word.rlike(r"^\p{Lu}+$"), "ALL-UPPER")
        .when(word.rlike(r"^\p{Ll}+$"), "ALL-LOWER")
        .when(word.rlike(r"^\p{Lu}\p{Ll}+$"), "MIXED-CASE")
        .otherwise("OTHER")
    )


def char_shape(word: Column, longest: int = 4) -> Column:
    """Each sign by class (X, x, d, itself), runs cut to ``longest``."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, "[A-Z]", "X"), "[a-z]", "x"), "[0-9]", "d")
    for sign in "Xxd":
        shape = F.regexp_replace(shape, f"{sign}{{{longest},}}", sign * longest)
    return shape


def capitalize(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))


def ascii_quotes(text: Column) -> Column:
    """Directed quotation marks as straight ones."""
    return F.regexp_replace(F.regexp_replace(text, "[“”„«»]", '"'), "[‘’‚]", "'")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^<>]+>", "")


def pad_or_truncate(text: Column, n: int) -> Column:
    return F.rpad(text, n, " ")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
