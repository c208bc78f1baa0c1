"""Counter algebra on values computed by hand."""

import math

from tessellex.functions import counters as C


def make(spark, **values):
    return spark.createDataFrame([(k, float(v)) for k, v in values.items()], "key string, value double")


def read(frame):
    return {r.key: r.value for r in frame.collect()}


def test_binary_operators(spark):
    a, b = make(spark, x=1, y=4, z=0), make(spark, y=2, z=0, w=3)
    got = read(C.division(a, b))
    assert got["x"] == math.inf and got["y"] == 2 and math.isnan(got["z"]) and got["w"] == 0
    assert read(C.division_defined(a, b)) == {"y": 2, "w": 0}
    assert read(C.absolute_difference(a, b)) == {"x": 1, "y": 2, "w": 3}
    assert {r.key: r.order for r in C.compare(a, b).collect()} == {"x": 1, "y": 1, "z": 0, "w": -1}
    assert C.equals(a, a).collect()[0].equal and not C.equals(a, b).collect()[0].equal
    zero = C.similarities(make(spark, x=0), b).collect()[0]
    assert zero.cosine == 0.0 and zero.dot == 0.0
    assert read(C.keys_below(a, 1.0).withColumnRenamed("key", "key").selectExpr("key", "1.0 value")) == {"x": 1, "z": 1}
    assert read(C.tf_log(a))["z"] == 0


def test_divergences(spark):
    a, b = make(spark, x=1, y=1), make(spark, x=1, y=3)
    got = C.divergences(a, b).collect()[0]
    assert abs(got.kl - (0.5 * math.log2(2) + 0.5 * math.log2(2 / 3))) < 1e-9
    assert C.divergences(a, make(spark, x=1)).collect()[0].kl == math.inf
    assert abs(C.cross_entropy(a, b).collect()[0].cross_entropy - (math.log2(0.25) + math.log2(0.75))) < 1e-9
    assert C.cross_entropy(a, make(spark, x=1)).collect()[0].cross_entropy == -math.inf


def test_sampling_and_good_turing(spark, tmp_path):
    c = make(spark, a=1, b=3, c=0)
    got = [r.key for r in C.sample(c, 4000).collect()]
    assert len(got) == 4000 and set(got) == {"a", "b"} and 0.7 < got.count("b") / 4000 < 0.8
    assert C.sample(c.limit(0), 5).count() == 0
    words = make(spark, **{f"w{i}": v for i, v in enumerate([1] * 20 + [2] * 8 + [3] * 4 + [5, 9])})
    rows = C.good_turing(words).collect()
    total = sum(r.value * r["keys"] for r in rows)
    assert abs(rows[0].unseen - 20 / total) < 1e-9
    assert abs(sum(r.smoothed * r["keys"] for r in rows) / total + rows[0].unseen - 1) < 1e-9
    assert C.good_turing(words.limit(0)).count() == 0
    C.save_counter(c, str(tmp_path / "c"))
    assert read(C.load_counter(spark, str(tmp_path / "c"))) == read(c)
