"""One consistent form for texts that read the same.

A quick check (one character class, built from the Unicode data) isolates the
segments of a text that may change: compatibility forms of letters and
digits, kinds of space, characters that show nothing, combining marks with
the base before them, and words that mix scripts. Only those segments are
normalized, and spliced into the unchanged rest.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.session import broadcast_checked, cut_lineage

# Letters of other scripts that look like Latin letters.
GREEK_ALIKE = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"))
CYRILLIC_ALIKE = dict(zip("АВЕКМНОРСТХЅІЈаеорсухѕіјһԁԛԝ", "ABEKMHOPCTXSIJaeopcyxsijhdqw"))

_TO_LATIN = str.maketrans(GREEK_ALIKE | CYRILLIC_ALIKE)
_TO_CYRILLIC = {ord(v): k for k, v in CYRILLIC_ALIKE.items()}
_TO_GREEK = {ord(v): k for k, v in GREEK_ALIKE.items()}

# Characters of other kinds that show nothing.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0}

#: Compatibility tags that only say how a letter, digit or space is drawn.
_DRAWN = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}


def _canonical_char(char: str) -> str:
    """What one character becomes before composition; itself where it is stable."""
    kind = unicodedata.category(char)
    code = ord(char)
    if kind == "Zs" or char == "\t":
        return " "
    if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in _UNSEEN:
        return ""
    parts = unicodedata.decomposition(char)
    if parts.startswith("<"):
        tag = parts.split()[0]
        full = unicodedata.normalize("NFKD", char)
        if tag in _DRAWN or tag == "<compat>" and all(unicodedata.category(c)[0] in "LM" for c in full):
            return "".join(_canonical_char(c) if c != char else c for c in unicodedata.normalize("NFKC", char))
    return char


def _class(codes: list[int]) -> str:
    """A regular-expression class of sorted code points, as ranges."""
    out, lo, hi = [], None, None
    for c in [*codes, -1]:
        if lo is not None and c == hi + 1:
            hi = c
            continue
        if lo is not None:
            out.append(f"\\U{lo:08x}" + (f"-\\U{hi:08x}" if hi > lo else ""))
        lo = hi = c
    return "".join(out)


_RANGES = ((0, 0x3400), (0xA000, 0xAC00), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE01F0))


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str], re.Pattern, re.Pattern, frozenset[str]]:
    """The character map, and the quick check: a search for what may change.

    The search over the basic plane is a bitmap; the one over all planes is
    slow and only used for texts that hold one of the characters in the set.

    Besides the map's own characters these are the ones whose NFC quick check
    says No (they change) or Maybe (second in a canonical composition).
    """
    change, marks = {}, {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    for code in (c for lo, hi in _RANGES for c in range(lo, hi)):
        char = chr(code)
        new = _canonical_char(char)
        if new != char:
            change[code] = new
            continue
        parts = unicodedata.decomposition(char)
        if parts and not parts.startswith("<"):
            if unicodedata.normalize("NFC", char) != char:
                marks.add(code)
            elif " " in parts:
                marks.add(int(parts.split()[1], 16))
    unstable = sorted({*change, *marks})
    plane = re.compile(f"[{_class([c for c in unstable if c <= 0xFFFF])}]+")
    return change, plane, re.compile(f"[{_class(unstable)}]+"), frozenset(chr(c) for c in unstable if c > 0xFFFF)


_LATIN = "A-Za-z\\u00c0-\\u024f"
_EAST = "\\u0370-\\u052f"  # Greek and Cyrillic
_LATIN_ALIKE = "".join(sorted({*CYRILLIC_ALIKE.values(), *GREEK_ALIKE.values()}))
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_FOREIGN = re.compile(f"[{_EAST}]")
#: Words that mix scripts, and words of look-alike letters alone.
_MIXED = re.compile(
    rf"[{_LATIN}{_EAST}]*(?:[{_LATIN}](?=[{_EAST}])|[{_EAST}](?=[{_LATIN}]))[{_LATIN}{_EAST}]*"
    rf"|\b[{''.join(GREEK_ALIKE)}{''.join(CYRILLIC_ALIKE)}]+\b|\b[{_LATIN_ALIKE}]+\b"
)
#: Letters that only one script has.
_OWN = {
    "L": re.compile(f"(?![{_LATIN_ALIKE}])[{_LATIN}]"),
    "C": re.compile(f"(?![{''.join(CYRILLIC_ALIKE)}])[\\u0400-\\u052f]"),
    "G": re.compile(f"(?![{''.join(GREEK_ALIKE)}])[\\u0370-\\u03ff]"),
}
_EMOJI = "\\u2600-\\u27bf\\ufe0f\\U0001f000-\\U0001faff"
_JOINED = re.compile(f"(?<=[{_EMOJI}])\\u200d(?=[{_EMOJI}])")


def normalize_segments(text: str) -> str:
    """Form, width, spaces, joined letters, unseen characters; not look-alikes."""
    if text.isascii() and "\t" not in text:
        return text
    change, check, check_all, astral = _tables()
    if not astral.isdisjoint(_ASTRAL.findall(text)):
        check = check_all
    held = "\u200d" in text and _JOINED.search(text) is not None
    if held:  # joiners inside emoji sequences do show
        text = _JOINED.sub("\ufdd0", text)
    out, done = [], 0
    for match in check.finditer(text):
        start, stop = match.span()
        while start > done and unicodedata.combining(text[start - 1]):
            start -= 1
        start = max(done, start - 1)  # boundary context: what a mark may join
        out += text[done:start], unicodedata.normalize("NFC", text[start:stop].translate(change))
        done = stop
    out.append(text[done:])
    form = "".join(out)
    if not unicodedata.is_normalized("NFC", form):  # marks out of order, or over a seam
        form = unicodedata.normalize("NFC", form)
    return form.replace("\ufdd0", "\u200d") if held else form


def unify_scripts(text: str) -> str:
    """Look-alike letters take the script of their word, or of the letters around.

    All look-alikes are read as Latin first, so that the result is the same
    whatever script they came in. A word with a letter that only one script
    has then goes to that script; a word of look-alikes alone goes to the
    script of the nearest such letter of the text.
    """
    if not _FOREIGN.search(text):
        return text
    text = text.translate(_TO_LATIN)
    if not _FOREIGN.search(text):
        return text
    counts = {k: len(p.findall(text)) for k, p in _OWN.items()}
    main = max(counts, key=lambda k: (counts[k], k == "L"))
    marks: list[tuple[int, str]] = []

    def nearest(start: int, stop: int) -> str:
        if not marks:
            marks.extend(sorted((m.start(), k) for k, p in _OWN.items() for m in p.finditer(text)))
        at = bisect_left(marks, (start, ""))
        before = start - marks[at - 1][0] if at else len(text)
        after = bisect_left(marks, (stop, ""))
        beyond = marks[after][0] - stop if after < len(marks) else len(text)
        if before == beyond == len(text):
            return main
        return marks[at - 1][1] if before <= beyond else marks[after][1]

    def fix(match: re.Match) -> str:
        word = match[0]
        own = {k: len(p.findall(word)) for k, p in _OWN.items()}
        best = max(own, key=lambda k: (own[k], k == main))
        if own[best] == 0:
            best = nearest(*match.span())
        return word if best == "L" else word.translate(_TO_CYRILLIC if best == "C" else _TO_GREEK)

    return _MIXED.sub(fix, text)


def canonical_text(text: str) -> str:
    """The one form of a text."""
    return unify_scripts(normalize_segments(text))


def reading_key(text: str) -> str:
    """A 128-bit key of the one form: equal for texts that read the same."""
    return xxhash.xxh3_128_hexdigest(canonical_text(text))


def _map(docs: DataFrame, id_column: str, text_column: str, schema: str, make) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield make(batch)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, schema)


def canonical_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, text, changed``: every text in its one form.

    A null text stays null (changed false), an empty one empty; repeated rows
    come out as often as they went in; further columns are ignored.
    """

    def make(batch: pd.DataFrame) -> pd.DataFrame:
        new = [None if t is None else canonical_text(t) for t in batch["text"]]
        return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": pd.Series(new, dtype=object), "changed": [a != b for a, b in zip(new, batch["text"])]})

    return _map(docs, id_column, text_column, "doc_id bigint, text string, changed boolean", make)


def reading_keys(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, key, exact``: the key of the one form, and of the text as it is.

    Rows with a null id or text have no key and give no row.
    """

    def make(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.dropna()
        return pd.DataFrame({"doc_id": batch["doc_id"].astype("int64").tolist(), "key": [reading_key(t) for t in batch["text"]], "exact": [xxhash.xxh3_128_hexdigest(t) for t in batch["text"]]}, dtype=object)

    return _map(docs, id_column, text_column, "doc_id bigint, key string, exact string", make)


def reading_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, class_id, exact``: the documents that read the same as one with
    another text; the class is named by its least id, ``exact`` by the text itself."""
    keys = cut_lineage(reading_keys(docs, id_column, text_column))
    per = keys.groupBy("key").agg(F.min("doc_id").alias("class_id"), F.min("exact").alias("a"), F.max("exact").alias("b")).where("a <> b")
    return keys.join(per.select("key", "class_id"), "key").select("doc_id", "class_id", "exact")


def reading_pairs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_rows: int = 20_000, part_texts: int = 1_000) -> DataFrame:
    """Pairs of documents that read the same but differ in a character.

    Result: ``doc_id_a < doc_id_b``, distinct. Texts are first reduced to
    (key, exact text) groups with partial aggregation; pairs are formed
    between groups of one key, never within a group of equal texts, and only
    then expanded to their documents. A key with more than ``part_texts``
    texts, and a text with more than ``part_rows`` documents, are salted into
    parts of about that size, whatever the corpus.
    """
    keys = cut_lineage(reading_keys(docs, id_column, text_column))
    groups = keys.groupBy("key", "exact").agg(F.count("*").alias("n"))
    # only keys of several texts go on
    several = groups.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
    groups = groups.join(several, "key").withColumn("parts", F.ceil(F.col("texts") / part_texts).cast("int"))
    left = groups.select("key", F.col("exact").alias("exact_a"), F.col("n").alias("n_a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = groups.select("key", F.col("exact").alias("exact_b"), F.col("n").alias("n_b"), F.pmod(F.xxhash64("exact"), F.col("parts")).cast("int").alias("part"))
    variants = left.join(right, ["key", "part"]).where("exact_a < exact_b").drop("key", "part")
    salts = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    hot = broadcast_checked(groups.where(F.col("n") > part_rows).select("exact", salts("n").alias("salts")), 200_000)
    members = keys.join(hot, "exact", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int")).select("doc_id", "exact", "salt")
    spread = variants.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts("n_a") - 1, F.lit(0)))))
    first = spread.withColumnRenamed("exact_a", "exact").join(members, ["exact", "salt"]).select(F.col("doc_id").alias("a"), F.col("exact_b").alias("exact"), "n_b")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts("n_b") - 1, F.lit(0)))))
    both = first.join(members.withColumnRenamed("doc_id", "b"), ["exact", "salt"])
    pairs = both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).where("doc_id_a < doc_id_b")
    return pairs.distinct()
