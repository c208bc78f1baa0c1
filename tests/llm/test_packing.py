"""Packing against a sequential best fit, one document at a time."""

import random
from collections import defaultdict

from tessellex.llm.packing import _tally, container_fill, match_round, pack_documents, place_items


def sequential(sizes, capacity):
    """Gaps after best-fit decreasing, item by item."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return gaps


def brackets(docs, gaps):
    """Matches of a sweep with a stack, sizes only."""
    stack, out = [], []
    for value, kind in sorted([(v, 0) for v in docs] + [(v, 1) for v in gaps]):
        if kind == 0:
            stack.append(value)
        elif stack:
            out.append((stack.pop(), value))
    return sorted(out)


def test_a_round_matches_like_a_stack(spark):
    rng = random.Random(1)
    for part_rows in (10_000, 3):  # the second numbers common sizes in parts
        docs, gaps = ([rng.choice([3, 3, 3, rng.randrange(1, 20)]) for _ in range(n)] for n in (60, 40))
        rows = [(v, 0, i) for i, v in enumerate(docs)] + [(v, 1, i) for i, v in enumerate(gaps)]
        events = spark.createDataFrame(rows, "value int, kind int, key bigint")
        out = match_round(events, _tally(events, 20), part_rows).collect()
        assert sorted((r.value, r.room) for r in out if r.other is not None) == brackets(docs, gaps)
        assert all(gaps[r.other] == r.room for r in out if r.other is not None)
        assert {r.key for r in out if r.taken} == {r.other for r in out if r.other is not None} and len(out) == 100


def test_containers_are_no_more_than_one_by_one(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 61) if rng.random() < 0.6 else rng.choice([1, 30, 20]) for _ in range(150)]
    items = spark.createDataFrame(list(enumerate(sizes)), "key bigint, value int")
    found, rounds = place_items(items, 60)
    used = defaultdict(list)
    for r in found.collect():
        used[r.container].append((r.offset_token, sizes[r.key]))
    assert sum(map(len, used.values())) == 150 and rounds < 40
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 60
    assert len(used) <= len(sequential(sizes, 60)) + 2


def test_tiny_texts_are_bundled(spark):
    docs = spark.createDataFrame([(i, "word") for i in range(3000)], "doc_id bigint, text string")
    out = pack_documents(docs, 128).collect()
    used = defaultdict(list)
    for r in out:
        used[r.container].append(r.offset_token)
    assert len(out) == 3000 and all(sorted(v) == list(range(len(v))) for v in used.values()) and len(used) <= 25


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.randrange(1, 90)) for i in range(300)] + [(900, "word " * 1000), (901, None), (902, ""), (None, "tiny"), (5, "again " * 5), (5, "again " * 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, size string").repartition(5)
    out = pack_documents(docs, 128).collect()
    used, spans = defaultdict(list), defaultdict(list)
    for r in out:
        used[r.container].append((r.offset_token, r.offset_token + r.n_tokens))
        spans[r.doc_id].append((r.begin_token, r.end_token))
        assert r.n_tokens == r.end_token - r.begin_token and r.n_tokens <= 128
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and parts[-1][1] <= 128 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    big = sorted(spans[900])
    assert len(big) > 1 and all(a[1] == b[0] for a, b in zip(big, big[1:])) and all(b - a == 128 for a, b in big[:-1])
    assert all(len(v) == 1 for k, v in spans.items() if k not in (900, 5)) and len(spans[5]) == 3 and len(spans[None]) == 1
    assert not {901, 902} & set(spans)
    sizes = [r.n_tokens for r in out]
    assert len(used) <= len(sequential(sizes, 128)) + 2
    total = container_fill(spark.createDataFrame(out), 128).collect()[0]
    assert total.containers == len(used) and total.fullest <= 128


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string"), 128).count() == 0
