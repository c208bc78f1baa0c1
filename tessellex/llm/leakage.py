"""Passages of held-out items inside corpus documents.

Texts are reduced to canonical tokens; numbers, names and units become typed
placeholders. Windows of the resulting templates are hashed and joined with
the windows of the items' sentences. Of a sentence only its rarest windows are
indexed, as many as the words that may differ can't all break, so that the
join loses nothing. The values in the slots of what was joined are checked:
the sentence's own values mean that it leaked, a consistent renaming that it
came back with other parameters; an alignment of the whole sentence decides.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellex.llm.canonical import _FOREIGN, _TO_LATIN, normalize_segments
from tessellex.session import broadcast_checked, collect_bounded, cut_lineage

_JOIN = re.compile(r"(?<=\w)['’ʼ‐-―-](?=\w)")
_WORDS = re.compile(r"[぀-ヿ㐀-鿿]|[^\W_぀-ヿ㐀-鿿]+")
_SENTENCE = re.compile(r"(?<=[.!?؟।])[\"”»’]?\s+|(?<=[。！？])")
_QUESTION = re.compile(r"[?？؟]\W*\Z")
_CAPITAL = r"(?<=\s)[A-ZÀ-ÞΑ-ΩЀ-Я]\w*"
#: Kinds of a token, in the low bits of its code; numbers, names and units are slots.
_WORD, _NUMBER, _NAME, _UNIT = 0, 1, 2, 3
WINDOW = 3
#: Share of a sentence's words that may be changed, added or dropped; most changes in a renamed template.
MOST_EDITS, MOST_RENAMED = 0.18, 2
_LARGEST_FILTER = 1 << 26


def plain_form(text: str) -> str:
    """Canonical characters, words kept together over apostrophes and hyphens."""
    if not text.isascii():
        text = normalize_segments(text)
        if _FOREIGN.search(text):
            text = text.translate(_TO_LATIN)
    return _JOIN.sub("", text)


class Codes(dict):
    """Word -> code: a hash of the word without case, and its kind in the two low bits."""

    def __init__(self, units: frozenset[str] = frozenset()):
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:  # a cache: emptied, not a bound on what is read
            self.clear()
        plain = word.casefold()
        data = plain.encode()
        kind = _NUMBER if plain.isdigit() else _UNIT if plain in self.units else _NAME if word[0].isupper() else _WORD
        code = self[word] = (zlib.crc32(data) << 30 ^ zlib.adler32(data) << 2) & ~3 | kind
        return code

    def of(self, text: str) -> np.ndarray:
        words = _WORDS.findall(plain_form(text))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _windows(codes: np.ndarray, names: bool) -> np.ndarray:
    """Hashes of the windows of a template; 0 where all of a window is slots.

    Numbers and units are slots always, names (capitalised words) if asked for.
    """
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    kind = codes & 3
    slot = (kind == _NUMBER) | (kind == _UNIT) | ((kind == _NAME) if names else False)
    token = np.where(slot, kind, codes | 3)
    out, full = np.full(n, 17 if names else 11, np.int64), np.ones(n, bool)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            out = out * 1_000_003 + token[j : j + n]
            full &= slot[j : j + n]
        out ^= out >> 29
    out[full] = 0
    return out


def _room(n: int) -> int:
    return int(MOST_EDITS * n)


def _edits(a: np.ndarray, b: np.ndarray) -> int:
    """Least edits that make ``a`` a stretch of ``b``."""
    prev = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = np.empty_like(prev)
        cur[0] = i
        np.minimum(prev[:-1] + (b != x), prev[1:] + 1, out=cur[1:])
        prev = np.minimum.accumulate(cur - steps) + steps
    return int(prev.min())


def compare(sentence: np.ndarray, area: np.ndarray) -> tuple[str, int] | None:
    """``same`` or ``renamed`` and the edits, for a sentence and a stretch of a document (codes)."""
    own, there = sentence >> 2, area >> 2
    room, near = _room(len(own)), set(there.tolist())
    # slots first: a sentence that leaked keeps its own values but for the words that may differ
    if len(set(own.tolist()) - near) <= room:
        edits = _edits(own, there)
        if edits <= room:
            return "same", edits
    kind = sentence & 3
    slots = kind > 0
    if slots.all() or len(set(own[~slots].tolist()) - near) > MOST_RENAMED or len(own) > len(there):
        return None
    template = np.where(slots, -kind, own)
    places = np.lib.stride_tricks.sliding_window_view(area, len(own))
    filled = np.where(places & 3 > 0, -(places & 3), places >> 2)
    off = (filled != template).sum(1)
    for at in np.flatnonzero(off <= min(room, MOST_RENAMED)).tolist():
        names: dict[int, int] = {}
        values = there[at : at + len(own)]
        same_slot = slots & (filled[at] == template)
        # one value always becomes the same other value
        if all(names.setdefault(a, b) == b for a, b in zip(own[same_slot].tolist(), values[same_slot].tolist())):
            return "renamed", int(off[at])
    return None


def item_sentences(items: DataFrame, least_words: int, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, sentence, words, key``: sentences of the items' passages, with codes of their words.

    Not of the passage are a last line that asks and lines (up to names and
    numbers) that stand beside at least three different passages. The longest
    line of an item is always passage, so items that share it don't lose it.
    Sentences of fewer than ``least_words`` words are short phrases and left out.
    """
    source = items.select(F.col(item_column).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and text is not null").distinct()
    lines = F.filter(F.split("text", r"\R"), lambda x: F.trim(x) != "")
    source = source.select("item_id", "text", lines.alias("lines")).where(F.size("lines") > 0)
    longest = F.expr("array_max(transform(lines, x -> named_struct('n', length(x), 'line', x)))")["line"]
    rows = source.select("item_id", "text", F.size("lines").alias("last"), longest.alias("longest"), F.posexplode("lines").alias("no", "line"))
    template = F.trim(F.lower(F.regexp_replace(F.regexp_replace("line", "(?U)" + _CAPITAL, "@"), r"\d+", "#")))
    rows = rows.withColumn("template", template)
    beside = rows.where("line <> longest").select("template", F.xxhash64("longest").alias("passage")).distinct()
    shared = beside.groupBy("template").count().where("count >= 3").select("template", F.lit(True).alias("shared"))
    rows = rows.join(shared, "template", "left").where("line = longest or shared is null")
    asks = (F.col("no") > 0) & (F.col("no") == F.col("last") - 1) & F.col("line").rlike(_QUESTION.pattern.replace(r"\Z", r"\z"))
    rows = rows.where(~asks).select("item_id", F.concat_ws("-", F.xxhash64("text"), "no").alias("place"), "line")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, place, line in zip(batch["item_id"], batch["place"], batch["line"]):
                for k, sentence in enumerate(_SENTENCE.split(plain_form(line))):
                    words = _WORDS.findall(sentence)
                    if len(words) >= least_words:
                        out.append((int(item), f"{place}-{k}", words))
            yield pd.DataFrame(out, columns=["item_id", "sentence", "words"], dtype=object)

    return rows.mapInPandas(run, "item_id bigint, sentence string, words array<string>").withColumn("key", F.xxhash64(F.concat_ws(" ", F.transform("words", F.lower))))


def learn_units(sentences: DataFrame, most: int = 100_000) -> frozenset[str]:
    """Words that follow a number, and different ones, in most of their uses."""
    pairs = F.expr("transform(sequence(1, size(words)), i -> named_struct('word', lower(get(words, i - 1)), 'before', get(words, i - 2)))")
    rows = sentences.select(F.explode(pairs).alias("p")).select("p.word", "p.before").where(~F.col("word").rlike(r"^\d+$"))
    number = F.when(F.col("before").rlike(r"^\d+$"), F.col("before"))
    by = rows.groupBy("word").agg(F.count("*").alias("n"), F.count(number).alias("after"), F.count_distinct(number).alias("values"))
    return frozenset(r.word for r in collect_bounded(by.where("values >= 3 and after > 0.5 * n").select("word"), most, "units"))


def sentence_index(distinct: DataFrame) -> DataFrame:
    """``window, key, at``: the rarest template windows of every sentence.

    ``e`` edits break at most ``WINDOW * e`` windows, so one more of them, in
    each of the two forms (with and without names as slots), finds a sentence.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, codes in zip(batch["key"], batch["codes"]):
                row = np.frombuffer(codes, np.int64)
                for form in (False, True):
                    most = WINDOW * (min(_room(len(row)), MOST_RENAMED) if form else _room(len(row))) + 1
                    out.extend((int(h), int(key), at, form, most) for at, h in enumerate(_windows(row, form).tolist()) if h)
            yield pd.DataFrame(out, columns=["window", "key", "at", "form", "most"], dtype=object)

    windows = distinct.select("key", "codes").mapInPandas(run, "window bigint, key bigint, at int, form boolean, most int")
    uses = windows.groupBy("window").agg(F.count("*").alias("uses"))
    rank = F.row_number().over(Window.partitionBy("key", "form").orderBy("uses", "window", "at"))
    return windows.join(uses, "window").withColumn("rank", rank).where("rank <= most").select("window", "key", "at")


def window_filter(index: DataFrame) -> np.ndarray:
    """A bit for every place (hash by the filter's size) that an indexed window falls on; 8 MB at most."""
    size = min(_LARGEST_FILTER, max(1 << 12, 1 << (2048 * index.count()).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch["window"].to_numpy(np.int64) & (size - 1)] = True
        yield pd.DataFrame({"bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    parts = index.select("window").coalesce(2).mapInPandas(run, "bits binary")
    out = np.zeros(size // 8, np.uint8)
    for row in parts.toLocalIterator():
        out |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


def leaked_sentences(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", least_words: int = 5) -> DataFrame:
    """Sentences of items found in documents: ``doc_id, item_id, how, edits``.

    ``how`` is ``same`` (the sentence, up to single changed, added or dropped
    words) or ``renamed`` (its template with other names or numbers). The
    corpus is read once, whole; a filter of 8 MB keeps the windows out that no
    item has, the rest is joined by hash. Null ids and null or empty texts
    match nothing; a document repeated under its id counts once, different
    texts under one id each; repeated items count once; further columns are
    ignored.
    """
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, how string, edits bigint"
    sentences = cut_lineage(item_sentences(items, least_words, item_column, item_text))
    units = learn_units(sentences)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Codes(units)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "codes": [np.array([table[w] for w in words], np.int64).tobytes() for words in batch["words"]]})

    distinct = sentences.groupBy("key").agg(F.first("words").alias("words")).mapInPandas(encode, "key bigint, codes binary")
    distinct = cut_lineage(distinct)
    index = cut_lineage(sentence_index(distinct))
    shared = spark.sparkContext.broadcast((window_filter(index), units))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, known = shared.value
        table = Codes(known)
        for batch in batches:
            out = []
            for doc_id, text_key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                codes = table.of(text)
                found = []
                for form in (False, True):
                    windows = _windows(codes, form)
                    place = windows & (8 * len(bits) - 1)
                    for at in np.flatnonzero((bits[place >> 3] >> (7 - (place & 7))) & 1).tolist():
                        found.append((int(windows[at]), at))
                if found:
                    out.append((int(doc_id), int(text_key), codes.tobytes(), [w for w, _ in found], [at for _, at in found]))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "codes", "windows", "places"], dtype=object)

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, key, own, text, lo, hi in batch.itertuples(index=False, name=None):
                row, codes = np.frombuffer(own, np.int64), np.frombuffer(text, np.int64)
                room = _room(len(row))
                got = compare(row, codes[max(0, lo - room) : hi + len(row) + room])
                if got:
                    out.append((doc_id, key, *got))
            yield pd.DataFrame(out, columns=["doc_id", "key", "how", "edits"], dtype=object)

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).where("doc_id is not null and text is not null")
    touched = source.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInPandas(hits, "doc_id bigint, text_key bigint, codes binary, windows array<bigint>, places array<int>")
    touched = cut_lineage(touched)
    joined = touched.select("doc_id", "text_key", F.explode(F.arrays_zip("windows", "places")).alias("w")).select("doc_id", "text_key", F.col("w.windows").alias("window"), F.col("w.places").alias("place"))
    joined = joined.join(broadcast_checked(index, 500_000), "window").withColumn("start", F.col("place") - F.col("at"))
    pairs = joined.groupBy("doc_id", "text_key", "key").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    texts = touched.select("doc_id", "text_key", F.col("codes").alias("text")).dropDuplicates(["doc_id", "text_key"])
    pairs = pairs.join(texts, ["doc_id", "text_key"]).join(broadcast_checked(distinct, 50_000), "key")
    decided = pairs.select("doc_id", "key", "codes", "text", "lo", "hi").mapInPandas(decide, "doc_id bigint, key bigint, how string, edits bigint")
    members = sentences.select("item_id", "key").distinct()
    return decided.join(members, "key").select(*(c.split()[0] for c in schema.split(", ")))


def leaked_documents(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """``doc_id, item_id`` of documents that hold a whole sentence of an item."""
    found = leaked_sentences(docs, items, **columns)
    return found.where("how = 'same'").select("doc_id", "item_id").distinct()
