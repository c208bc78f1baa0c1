"""Tree edits and the streaming form of the windows."""

import pytest

from tessellex.operators.tree_edits import edit_trees
from tessellex.streaming.windows import hourly_counts

TREE = "(S (NP (DT the) (NN cat)) (VP (VBD sat)))"


@pytest.mark.parametrize(
    "pattern, edits, want",
    [
        ("DT=d > NP", ["delete d"], "(S (NP (NN cat)) (VP (VBD sat)))"),
        ("VBD=v", ["prune v"], "(S (NP (DT the) (NN cat)))"),
        ("NP=n", ["excise n"], "(S (DT the) (NN cat) (VP (VBD sat)))"),
        ("NN=n", ["relabel n NNS"], "(S (NP (DT the) (NNS cat)) (VP (VBD sat)))"),
        ("NN=n", ["relabel n /N(.)/X\\1/"], "(S (NP (DT the) (XN cat)) (VP (VBD sat)))"),
        ("NN=n", ["insert (JJ big) $+ n"], "(S (NP (DT the) (JJ big) (NN cat)) (VP (VBD sat)))"),
        ("VP=v", ["insert (RB well) >-1 v"], "(S (NP (DT the) (NN cat)) (VP (VBD sat) (RB well)))"),
        ("NP=n $+ VP=v", ["move n $- v"], "(S (VP (VBD sat)) (NP (DT the) (NN cat)))"),
        ("DT=d $+ NN=n", ["delete d", "relabel n X"], "(S (NP (X cat)) (VP (VBD sat)))"),
        ("S=s", ["delete s"], None),
        ("JJ=j", ["delete j"], TREE),
    ],
)
def test_edits(spark, pattern, edits, want):
    rows = spark.createDataFrame([("1", TREE), ("2", "(broken")], "graph string, bracket string")
    got = {r.graph: r.bracket for r in edit_trees(rows, pattern, edits).collect()}
    assert got == {"1": want, "2": None}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_seconds(id * 900) as ts, if(id % 3 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(40)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = hourly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly_counts(rows).collect()))
