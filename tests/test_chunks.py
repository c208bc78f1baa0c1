"""Label schemes, spans, aggregation and scores; expressions of rules."""

import pytest
from pyspark.sql import functions as F

from tessellex.functions.expressions import compile_expression as E
from tessellex.operators import chunks as K
from tessellex.operators.spans import interval_relation

# one sentence in every scheme: two chunks of A that touch, then B of one token
WRITTEN = {
    "iob1": "I-A I-A B-A O I-B",
    "iob2": "B-A I-A B-A O B-B",
    "ioe1": "I-A E-A I-A O I-B",
    "ioe2": "I-A E-A E-A O E-B",
    "sbieo": "B-A E-A S-A O S-B",
    "bilou": "B-A L-A U-A O U-B",
}


def tokens(spark, labels):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(labels.split())], "s int, i int, label string")


@pytest.mark.parametrize("source", ["iob1", "ioe2", "bilou"])
def test_every_scheme_to_every_other(spark, source):
    rows = tokens(spark, WRITTEN[source])
    for scheme, want in WRITTEN.items():
        rows = K.convert_labels(rows, ["s"], "i", "label", scheme, scheme)
    rows = K.convert_labels(rows, ["s"], "i", "label", "io", "io").collect()
    for scheme, want in WRITTEN.items():
        assert " ".join(r[scheme] for r in sorted(rows, key=lambda r: r.i)) == want, scheme
    assert [r.io for r in sorted(rows, key=lambda r: r.i)] == ["I-A", "I-A", "I-A", "O", "I-B"]
    spans = K.labelled_spans(tokens(spark, WRITTEN[source]), ["s"], "i", "label").collect()
    assert sorted((r.type, r.begin, r.end) for r in spans) == [("A", 0, 2), ("A", 2, 3), ("B", 4, 5)]


def test_scores(spark):
    gold = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 4, "B"), (1, 3, 4, "B")], "s int, begin int, end int, type string")
    guess = spark.createDataFrame([(1, 0, 2, "A"), (1, 3, 5, "B")], "s int, begin int, end int, type string")
    got = {r.type: (r.tp, r.fp, r.fn) for r in K.span_scores(gold, guess, ["s", "begin", "end"]).collect()}
    assert got == {"A": (1, 0, 0), "B": (0, 1, 1), None: (1, 1, 1)}
    assert K.span_scores(gold.limit(0), guess.limit(0), ["s"]).collect() in ([], [(None, None, None, None, None, None, None)])


def test_aggregation_ways(spark):
    rows = spark.createDataFrame([(1, 0, None, 2), (1, 1, "b", 3), (1, 2, "a", 3), (1, 3, None, None)], "s int, i int, w string, n int")
    how = {k: ("w", k) for k in ("FIRST", "LAST", "FIRST_NON_NIL", "LAST_NON_NIL", "CONCAT", "CONCAT_TEXT")} | {k: ("n", k) for k in ("COUNT", "SUM", "MIN", "MAX", "MOST_FREQ")}
    got = K.aggregate_chunks(rows, ["s"], "i", how).collect()[0].asDict()
    assert got == {"s": 1, "FIRST": None, "LAST": None, "FIRST_NON_NIL": "b", "LAST_NON_NIL": "a", "CONCAT": "ba", "CONCAT_TEXT": "b a", "COUNT": 3, "SUM": 8, "MIN": 2, "MAX": 3, "MOST_FREQ": 3}


def test_expressions(spark):
    row = spark.createDataFrame([("Blue", 7, {"k": "v"}, [3, 1, 2])], "w string, n int, m map<string,string>, l array<int>")
    cases = {
        'Concat(Uppercase(w), "-", "x")': "BLUE-x",
        "Aggregate(l, \"Add\", 0)": 6,
        'Map(l, "Multiply", 2)': [6, 2, 4],
        "l[0]": 3,
        "l[9]": None,
        "Divide(n, 0)": None,
        'case(GT(n, 8), "big", GT(n, 5), "fair", "small")': "fair",
        'GetTag(Tag(m, "k", "w"), "k")': "w",
        'Get(RemoveVTag(m, "k"), "k")': None,
        'Match(w, /[A-Z].*/)': True,
        "Max(l)": 3,
        'w.Replace(/l/, "r").Lowercase()': "brue",
        "And(true, Not(EQ(n, 7)))": False,
        'Match(w, CreateRegex(words))': True,
        '["a", "b"][1]': "b",
    }
    got = row.select(*(E(t, {"words": ["Blue", "Red"]}).alias(f"c{i}") for i, t in enumerate(cases))).collect()[0]
    assert dict(zip(cases, got)) == cases
    for bad in ("Concat(w", "Nope(w)", "w w", "Match(w, n)"):
        with pytest.raises(ValueError):
            E(bad)


def test_interval_relations(spark):
    want = {(1, 5): "EQUAL", (1, 9): "INSIDE", (2, 5): "CONTAIN", (0, 5): "INSIDE", (2, 3): "CONTAIN", (6, 9): "BEFORE", (-3, 0): "AFTER", (5, 9): "END_MEET_BEGIN", (-1, 1): "BEGIN_MEET_END", (3, 9): "OVERLAP", (None, 2): "NONE"}
    rows = spark.createDataFrame(list(want), "a int, b int")
    assert {(r.a, r.b): r.r for r in rows.select("a", "b", interval_relation(F.lit(1), F.lit(5), F.col("a"), F.col("b")).alias("r")).collect()} == want
