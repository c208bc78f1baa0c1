"""Reading level of documents, comparable across languages.

For each language two models are trained on labelled documents: one of easy
text, one of demanding text. How often a word opens up in each level gives its
rate under both by maximum likelihood (EM); it tells if the better fit of two
rates is worth its parameter (BIC). Bigrams are interpolated with unigrams by
deleted interpolation; a word its predecessor foretells opens no new unit.

Over a whole document the surprisals under both models give two shares: of the
telling tokens, and of the runs and phrases, that the demanding model expects.
Their mean is the score. Scores mean the same in every language, so one
isotonic regression maps them to levels. It is fitted on scores that come from
models of the other folds, never from a model that saw the document.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.llm.canonical import _FOREIGN, _TO_LATIN, normalize_segments
from tessellex.llm.sentences import _EAST, language_votes, text_language
from tessellex.session import broadcast_checked, collect_bounded, cut_lineage

LEVELS = (1, 4)
RANKS = LEVELS[1] - LEVELS[0] + 1
FOLDS = 5
BINS = 1000
#: Share of demanding text taken for the lowest to highest level when words are fitted.
SHARES = np.linspace(0.02, 0.98, RANKS)
#: Least ratio of a word's two rates, and the chance from which a word counts as foretold.
TELL, FORETOLD = 3.0, 0.3
#: Weight of a phrase that goes on in a run of the same side; a new run weighs 1.
GOING_ON = 0.35
_BREAK = "."
_WORDS = re.compile(r"[^\W\d_]+|[.,;:!?…؟،؛]+")
_MARKS = re.compile("[ऀ-ॣ]+|[।,;:!?]+")
_CJK_RUN = re.compile("[぀-ヿ㐀-鿿]+|[。，、；：！？]+")


def reading_tokens(text: str, lang: str) -> list[str]:
    """Running words, pairs of signs in scripts without spaces, and breaks."""
    if not text.isascii():
        text = normalize_segments(text)
    if lang in ("zh", "ja"):
        out: list[str] = []
        for run in _CJK_RUN.findall(text):
            if run[0] < "぀" or run[0] > "鿿":
                out.append(_BREAK)
            else:
                out.extend(run[i : i + 2] for i in range(len(run) - 1))
        return out
    if lang == "hi":
        return [w if w[0] >= "ऀ" and w[0] != "।" else _BREAK for w in _MARKS.findall(text)]
    if lang not in ("ru", "ar") and _FOREIGN.search(text):
        text = text.translate(_TO_LATIN)
    return [w if w[0].isalpha() else _BREAK for w in _WORDS.findall(text.lower())]


def languages_read(text: str, votes: dict[str, str]) -> list[tuple[str, list[str]]]:
    """The main language with its tokens, then those of other scripts in the text."""
    if text.isascii() or not _EAST.search(text):
        tokens = reading_tokens(text, "xx")
        tally = Counter(filter(None, map(votes.get, tokens)))
        return [(tally.most_common(1)[0][0] if tally else "xx", tokens)]
    lang, alone = text_language(text, text.split(), votes)
    parts = [(lang, reading_tokens(text, lang))]
    if not alone:
        for other, script in _SCRIPT_SIGNS.items():
            if other != lang and re.search(script, text):
                parts.append((other, reading_tokens(text, other)))
        if lang in _SCRIPT_SIGNS:
            latin = Counter(filter(None, map(votes.get, _WORDS.findall(text.lower()))))
            if latin:
                parts.append((latin.most_common(1)[0][0], reading_tokens(text, "xx")))
    return parts


_SCRIPT_SIGNS = {"ru": "[а-я]", "ar": "[ؠ-ي]", "hi": "[ऀ-ॣ]", "zh": "[㐀-鿿]", "ja": "[぀-ヿ]"}


@dataclass
class LanguageRegister:
    """Telling words of one language with the side they speak for, per model."""

    ids: dict[str, int]
    sides: np.ndarray  # (models, ids): -1 easy, 1 demanding, 0 neither
    foretold: np.ndarray  # sorted keys of pairs, first * size + second


@dataclass
class LevelModel:
    """Registers by language; the last model saw all labelled documents."""

    votes: dict[str, str]
    registers: dict[str, LanguageRegister] = field(default_factory=dict)
    edges: list[float] = field(default_factory=lambda: [0.1, 0.5, 0.8])  # scores at which the level rises
    silent: int = 2  # level of a text in which no token tells

    def shares(self, lang: str, tokens: list[str], model: int) -> np.ndarray:
        """Telling tokens and units: (easy tokens, demanding tokens, easy units, demanding units)."""
        own = self.registers.get(lang)
        if own is None or not tokens:
            return np.zeros(4)
        ids = np.fromiter(map(own.ids.get, tokens, repeat(0)), np.int64, len(tokens))
        side = own.sides[model][ids]
        at = np.flatnonzero((side != 0) | (ids == 1))  # telling tokens and breaks
        tells = side[at]
        again = np.zeros(len(at), bool)
        again[1:] = (tells[1:] == tells[:-1]) & (tells[1:] != 0)
        weight = np.where(again, GOING_ON, 1.0)
        follow = at[again]
        if follow.size and own.foretold.size:
            key = ids[follow - 1] * len(own.sides[model]) + ids[follow]
            near = np.minimum(np.searchsorted(own.foretold, key), own.foretold.size - 1)
            weight[np.flatnonzero(again)[own.foretold[near] == key]] = 0.0
        hard, easy = tells > 0, tells < 0
        return np.array([easy.sum(), hard.sum(), weight[easy].sum(), weight[hard].sum()], float)

    def score(self, text: str, model: int = FOLDS) -> float | None:
        """Mean share of demanding tokens and units of the whole text; None if none tells."""
        sums = sum((self.shares(lang, tokens, model) for lang, tokens in languages_read(text, self.votes)), np.zeros(4))
        if sums[0] + sums[1] == 0:
            return None
        return float(sums[1] / (sums[0] + sums[1]) + sums[3] / (sums[2] + sums[3])) / 2

    def level(self, score: float | None) -> int:
        return self.silent if score is None else LEVELS[0] + sum(score >= e for e in self.edges)


COUNT_SCHEMA = "lang string, first string, second string, cell int, n double"


def count_sequences(labelled: DataFrame, votes: dict[str, str]) -> DataFrame:
    """Documents with a word by fold and level, and token pairs over all.

    ``cell`` is ``fold * levels + level - 1`` for words (``second`` null) and
    for the documents themselves (``first`` null too), -1 for pairs. A document
    counts a word once, so that names dear to one document don't look like a
    trait of its level; one between two levels counts in part for both.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums: dict[tuple, float] = defaultdict(float)
            for text, level, fold in zip(batch["text"], batch["level"], batch["fold"]):
                lang, tokens = languages_read(text, votes)[0]
                low = min(int(level), LEVELS[1] - 1)
                cells = [(fold * RANKS + low - LEVELS[0] + up, w) for up, w in ((0, low + 1 - level), (1, level - low)) if w > 0]
                for cell, weight in cells:
                    sums[(lang, None, None, cell)] += weight
                    for word in set(tokens):
                        sums[(lang, word, None, cell)] += weight
                for pair in zip([_BREAK, *tokens], [*tokens, _BREAK]):
                    sums[(lang, *pair, -1)] += 1
            yield pd.DataFrame([(*k, n) for k, n in sums.items()], columns=["lang", "first", "second", "cell", "n"], dtype=object)

    rows = labelled.select("text", "level", "fold").mapInPandas(run, COUNT_SCHEMA)
    return rows.groupBy("lang", "first", "second", "cell").agg(F.sum("n").alias("n"))


def fit_rates(counts: np.ndarray, docs: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Rates of words in easy and demanding text, and the gain in fit of two rates over one.

    ``counts`` (words, levels) are documents with the word, ``docs`` (levels)
    all documents; a level's rate is the mix of both rates by its share of
    demanding text (Poisson maximum likelihood by EM).
    """
    parts = np.stack([docs * (1 - SHARES), docs * SHARES], 1)
    whole = np.maximum(parts.sum(0), 1e-9)
    pooled = counts.sum(1) / max(docs.sum(), 1e-9)
    rates = np.stack([pooled, pooled], 1) + 1e-9
    for _ in range(rounds):
        rates *= (counts / (rates @ parts.T + 1e-12)) @ parts / whole
    mean, alone = rates @ parts.T + 1e-12, pooled[:, None] * docs + 1e-12
    return rates, 2 * ((counts * np.log(mean / alone)).sum(1) - (mean - alone).sum(1))


def telling_words(counts: DataFrame, docs: dict[str, np.ndarray], least_docs: int) -> DataFrame:
    """``lang, word, sides``: the side of every word that tells, for the model without each fold and for the full one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lang, part in batch.groupby("lang"):
                table = np.zeros((len(part), FOLDS * RANKS))
                for i, cells in enumerate(part["cells"]):
                    for cell in cells:
                        table[i, cell["cell"]] = cell["n"]
                table = table.reshape(len(part), FOLDS, RANKS)
                sides = np.zeros((len(part), FOLDS + 1), np.int8)
                for model in range(FOLDS + 1):
                    kept = [f for f in range(FOLDS) if f != model]
                    seen, all_docs = table[:, kept].sum(1), docs[lang][kept].sum(0)
                    rates, gain = fit_rates(seen, all_docs)
                    n = max(all_docs.sum(), 1.0)
                    ratio = (rates[:, 1] + 0.2 / n) / (rates[:, 0] + 0.2 / n)
                    tells = (gain > np.log(n)) & (seen.sum(1) >= least_docs)
                    sides[:, model] = tells * ((ratio > TELL).astype(np.int8) - (ratio < 1 / TELL).astype(np.int8))
                out.extend((lang, word, row.tolist()) for word, row in zip(part["first"], sides) if row.any())
            yield pd.DataFrame(out, columns=["lang", "word", "sides"], dtype=object)

    words = counts.where("second is null and first is not null").where(F.col("first") != _BREAK)
    words = words.groupBy("lang", "first").agg(F.collect_list(F.struct("cell", "n")).alias("cells"), F.sum("n").alias("docs"))
    return words.where(F.col("docs") >= least_docs).select("lang", "first", "cells").mapInPandas(run, "lang string, word string, sides array<int>")


def foretold_pairs(counts: DataFrame, telling: DataFrame) -> DataFrame:
    """Pairs whose second word, a telling one, has at least the chance FORETOLD after the first.

    Bigram and unigram chances are interpolated; the weight of each language
    comes from deleted interpolation: every pair votes, by its count, for the
    chance that is greater. Chances are taken with one occurrence held out, so
    that a pair seen once foretells nothing.
    """
    pairs = counts.where("second is not null").select("lang", "first", "second", "n")
    firsts = pairs.groupBy("lang", "first").agg(F.sum("n").alias("c1"))
    seconds = pairs.groupBy("lang", "second").agg(F.sum("n").alias("c2"))
    every = pairs.groupBy("lang").agg(F.sum("n").alias("total"))
    joined = pairs.join(firsts, ["lang", "first"]).join(seconds, ["lang", "second"]).join(F.broadcast(every), "lang")
    after = F.when(F.col("c1") > 1, (F.col("n") - 1) / (F.col("c1") - 1)).otherwise(0.0)
    alone = (F.col("c2") - 1) / F.greatest(F.col("total") - 1, F.lit(1.0))
    weights = joined.groupBy("lang").agg((F.sum(F.when(after > alone, F.col("n")).otherwise(0.0)) / F.sum("n")).alias("weight"))
    chance = F.col("weight") * after + (1 - F.col("weight")) * alone
    known = telling.select("lang", F.col("word").alias("second"))
    return joined.join(F.broadcast(weights), "lang").where(chance >= FORETOLD).join(known, ["lang", "second"], "left_semi").select("lang", "first", "second")


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Isotonic regression: the nearest non-decreasing sequence."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(n, v) for v, _, n in blocks]) if blocks else np.empty(0)


def level_edges(scores: np.ndarray, fitted: np.ndarray) -> list[float]:
    """Scores at which the fitted level passes 1.5, 2.5 and 3.5."""
    edges = []
    for cut in np.arange(LEVELS[0] + 0.5, LEVELS[1]):
        above = np.flatnonzero(fitted >= cut)
        if not above.size:
            edges.append(2.0)
        elif above[0] == 0:
            edges.append(-1.0)
        else:
            edges.append(float(scores[above[0] - 1] + scores[above[0]]) / 2)
    return edges


def fit_levels(docs: DataFrame, labels: DataFrame, samples: DataFrame, least_docs: int = 3, max_words: int = 1_000_000, max_broadcast: int = 1_000_000, id_column: str = "doc_id", text_column: str = "text", level_column: str = "level") -> LevelModel:
    """Trains the models and the regression on all labelled documents.

    Several labels of a document are averaged, levels outside the scale are
    moved to its ends. Up to ``max_broadcast`` labelled ids are sent to the
    documents; for more, ids and texts are shuffled. At most
    ``max_words`` telling words and as many pairs reach the driver, else an error is raised.
    """
    votes = language_votes([(r.lang, r.text) for r in collect_bounded(samples.select("lang", "text"), 10_000, "language samples") if r.lang and r.text])
    level = F.greatest(F.lit(float(LEVELS[0])), F.least(F.lit(float(LEVELS[1])), F.avg(level_column)))
    known = labels.where(F.col(level_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(level.alias("level"))
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    labelled = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    labelled = cut_lineage(labelled.join(broadcast_checked(known, max_broadcast), "_id").select("text", "level", fold))
    counts = cut_lineage(count_sequences(labelled, votes))
    model = LevelModel(votes)
    docs_by: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(FOLDS * RANKS))
    for r in collect_bounded(counts.where("first is null"), 1_000 * FOLDS * RANKS, "languages by level"):
        docs_by[r.lang][r.cell] = r.n
    docs_by = {lang: n.reshape(FOLDS, RANKS) for lang, n in docs_by.items()}
    telling = cut_lineage(telling_words(counts, docs_by, least_docs))
    words, pairs = defaultdict(list), defaultdict(list)
    for r in collect_bounded(telling, max_words, "telling words"):
        words[r.lang].append((r.word, r.sides))
    for r in collect_bounded(foretold_pairs(counts, telling), max_words, "foretold pairs"):
        pairs[r.lang].append((r["first"], r.second))
    for lang, known_words in words.items():
        tells = dict(known_words)
        # 0 stands for unknown words, 1 for a break; then telling words and their predecessors
        ids = {_BREAK: 1} | {w: i for i, w in enumerate(sorted({*tells, *(a for a, _ in pairs[lang] if a != _BREAK)}), 2)}
        sides = np.zeros((FOLDS + 1, len(ids) + 1), np.int8)
        for word, row in known_words:
            sides[:, ids[word]] = row
        model.registers[lang] = LanguageRegister(ids, sides, np.array(sorted(ids[a] * (len(ids) + 1) + ids[b] for a, b in pairs[lang]), np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = [(shared.value.score(t, f), lv) for t, lv, f in zip(batch["text"], batch["level"], batch["fold"])]
            yield pd.DataFrame([(-1 if s is None else int(round(s * BINS)), lv) for s, lv in scored], columns=["bin", "level"], dtype=object)

    bins = labelled.mapInPandas(run, "bin int, level double").groupBy("bin").agg(F.avg("level").alias("level"), F.count("*").alias("n"))
    table = sorted(collect_bounded(bins, BINS + 2, "score bins"), key=lambda r: r["bin"])
    told = [r for r in table if r["bin"] >= 0]
    if told:
        fitted = pool_adjacent(np.array([r["level"] for r in told]), np.array([float(r["n"]) for r in told]))
        model.edges = level_edges(np.array([r["bin"] / BINS for r in told]), fitted)
    if table:  # texts in which nothing tells get their own mean, else that of all
        none = [r for r in table if r["bin"] < 0] or table
        model.silent = int(round(sum(r["level"] * r["n"] for r in none) / sum(r["n"] for r in none)))
    return model


def reading_levels(docs: DataFrame, model: LevelModel, *carried: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, level, score``: level 1 (easiest) to 4 and the score behind it.

    The score is null where no token tells (an empty text, say); the level is
    then the mean one of labelled documents without a telling token. Null texts give no row, a null id
    stays null, repeated rows come out each for itself; of further columns
    those named in ``carried`` (strings) come along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "level", "score", *carried]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            rows = []
            for doc_id, text, *rest in batch.itertuples(index=False, name=None):
                score = own.score(text)
                rows.append((None if pd.isna(doc_id) else int(doc_id), own.level(score), score, *rest))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    source = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), *(F.col(c).cast("string") for c in carried))
    return source.mapInPandas(run, "doc_id bigint, level bigint, score double" + "".join(f", `{c}` string" for c in carried))
