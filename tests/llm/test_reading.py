"""Reading levels: isotonic fit against brute force, held-out documents, defined results."""

import itertools
import random

import numpy as np

from tessellex.llm.reading import SHARES, fit_levels, fit_rates, level_edges, pool_adjacent, reading_levels

EASY = ["the cat sat by the stove", "my aunt ate a warm bun", "the boy lost a blue hat", "we ran to the big lake", "the dog hid the jam"]
HARD = [
    "the committee promulgated mutually contradictory directives",
    "the consortium exacerbated the asymmetry between creditors",
    "an adjudicator delineated the parameters of permissible intervention",
    "a protracted dispute attenuated the evidential weight of testimony",
    "the directorate necessitated a comprehensive reappraisal of competence",
]


def make(rng, level, n=24):
    share = {1: 0.03, 2: 0.3, 3: 0.7, 4: 0.97}[level]
    return ". ".join(rng.choice(HARD if rng.random() < share else EASY) for _ in range(n)) + "."


def test_pool_adjacent_is_the_best_monotone_fit():
    rng = random.Random(3)
    grid = [x / 4 for x in range(0, 17)]
    for _ in range(20):
        v = np.array([rng.choice([0.0, 1.0, 2.0, 4.0]) for _ in range(4)])
        w = np.array([float(rng.randrange(1, 4)) for _ in range(4)])
        fit = pool_adjacent(v, w)
        best = min(float((w * (np.array(c) - v) ** 2).sum()) for c in itertools.combinations_with_replacement(grid, 4))
        assert np.all(np.diff(fit) >= 0) and (w * (fit - v) ** 2).sum() <= best + 1e-9


def test_edges():
    assert level_edges(np.array([0.1, 0.5, 0.9]), np.array([1.0, 2.0, 4.0])) == [0.3, 0.7, 0.7]


def test_held_out_levels_and_defined_results(spark):
    rng = random.Random(8)
    rows = [(i, make(rng, 1 + i % 4), 1 + i % 4) for i in range(400)]
    odd = [(None, make(rng, 4), 4), (900, None, 1), (901, "", 1), (902, make(rng, 1, 20_000), 1), (903, make(rng, 2), 2), (903, make(rng, 2), 2)]
    docs = spark.createDataFrame([(a, b, "x") for a, b, _ in rows + odd], "doc_id bigint, text string, level string")
    labels = spark.createDataFrame([(a, c) for a, _, c in rows if a // 4 % 2] * 2 + [(None, 2), (7, None)], "doc_id bigint, level int")
    samples = spark.createDataFrame([("en", " ".join(EASY + HARD))] * 3, "lang string, text string")
    model = fit_levels(docs, labels, samples)
    out = reading_levels(docs, model).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.level)
    held = [(got[i][0], level) for i, _, level in rows if i // 4 % 2 == 0]
    assert np.mean([a == b for a, b in held]) > 0.85 and max(abs(a - b) for a, b in held) <= 1
    assert got[None] == [4] and 900 not in got and got[902] == [1] and len(got[903]) == 2
    assert [r.score for r in out if r.doc_id == 901] == [None]
    assert reading_levels(docs.limit(0), model).count() == 0
    carried = reading_levels(docs.withColumnRenamed("level", "source"), model, "source").collect()
    assert len(carried) == len(out) and {r["source"] for r in carried} == {"x"}
    untrained = fit_levels(docs, labels.limit(0), samples)
    assert {r.level for r in reading_levels(docs.limit(5), untrained).collect()} == {2}


def test_rates_of_two_registers():
    docs = np.array([100.0, 100.0, 100.0, 100.0])
    counts = np.stack([60 * SHARES, 60 * (1 - SHARES), np.full(4, 30.0)])
    rates, gain = fit_rates(counts, docs)
    assert np.allclose(rates, [[0, 0.6], [0.6, 0], [0.3, 0.3]], atol=0.02) and gain[2] < 1e-6 < 20 < gain[:2].min()


def test_all_labels_are_used(spark):
    n = 60_000
    docs = spark.range(n).selectExpr("id as doc_id", "if(id % 2 = 0, 'the warm bun', 'the lengthy tribunal') as text")
    labels = docs.selectExpr("doc_id", "cast(if(doc_id % 2 = 0, 1, 4) as int) as level")
    samples = spark.createDataFrame([("en", " ".join(EASY + HARD))] * 3, "lang string, text string")
    sent = fit_levels(docs, labels, samples, least_docs=n // 2)
    shuffled = fit_levels(docs, labels, samples, least_docs=n // 2, max_broadcast=100)
    for model in (sent, shuffled):
        (own,) = model.registers.values()
        assert {"bun", "warm", "lengthy", "tribunal"} <= set(own.ids) and own.ids.keys() == next(iter(sent.registers.values())).ids.keys()
