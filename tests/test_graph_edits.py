"""Graph edits on one small sentence, and an edit repeated until it has no place."""

import pytest

from tessellex.operators import graph_edits as D

# ate(2) -> Bill(1) nsubj, muffins(4) obj -> blue(3) amod, .(5) punct
NODES = [("s", 1, "Bill", "NNP"), ("s", 2, "ate", "VBD"), ("s", 3, "blue", "JJ"), ("s", 4, "muffins", "NNS"), ("s", 5, ".", ".")]
EDGES = [("s", 2, 1, "nsubj"), ("s", 2, 4, "obj"), ("s", 4, 3, "amod"), ("s", 2, 5, "punct")]


@pytest.fixture
def g(spark):
    return D.Graph(spark.createDataFrame(NODES, "graph string, idx int, form string, xpos string"), spark.createDataFrame(EDGES, "graph string, gov int, dep int, reln string"))


def words(g):
    return " ".join(r.form or "_" for r in sorted(g.nodes.collect(), key=lambda r: r.idx))


def edges(g):
    return sorted((r.gov, r.dep, r.reln) for r in g.edges.collect())


def place(spark, **named):
    return spark.createDataFrame([("s", *named.values()), ("other", *named.values())], "graph string, " + ", ".join(f"{n} int" for n in named))


def test_edges(spark, g):
    at = place(spark, a=2, b=4)
    assert (4, 2, "x") in edges(D.add_edge(g, at, "b", "a", "x")) and edges(D.add_edge(g, at, "a", "b", "obj")) == edges(g)
    assert edges(D.add_edge(g, place(spark, a=2, b=77), "a", "b", "x")) == edges(g)
    assert (2, 4, "obj") not in edges(D.remove_edge(g, at, "a", "b")) and len(edges(D.remove_edge(g, at, "a"))) == 1
    assert edges(D.remove_edge(g, at, "a", "b", "nsubj")) == edges(g)
    assert (2, 4, "dobj") in edges(D.relabel_edge(g, at, "a", "b", "dobj"))
    assert (1, 3, "amod") in edges(D.reattach_edge(g, place(spark, a=4, b=3, c=1), "a", "b", new_gov="c"))
    assert (2, 4, "obj") not in edges(D.kill_incoming(g, at, "b"))


def test_nodes(spark, g):
    assert words(D.delete_below(g, place(spark, x=4), "x")) == "Bill ate ."
    assert words(D.delete_leaf(g, place(spark, x=4), "x")) == words(g) and words(D.delete_leaf(g, place(spark, x=3), "x")) == "Bill ate muffins ."
    cut = D.kill_incoming(g, place(spark, x=4), "x")
    assert words(D.kill_unreachable(D.set_roots(cut, place(spark, x=2), "x"))) == "Bill ate ."
    assert {r.idx for r in cut.root_nodes().collect()} == {2, 4}
    edited = D.edit_node(g, place(spark, x=3), "x", form="red", xpos=None)
    assert words(edited) == "Bill ate red muffins ." and {r.xpos for r in edited.nodes.where("idx = 3").collect()} == {None}
    assert {r.form: r.lemma for r in D.lemmatize(g, place(spark, x=2), "x").nodes.collect()}["ate"] == "eat"
    assert words(D.add_node(g, place(spark, x=1), form="so")) == "Bill ate blue muffins . so"


def test_numbers(spark, g):
    for where, want in {"first": "two Bill ate blue muffins .", "last": "Bill ate blue muffins . two", "before": "Bill ate blue two muffins .", "after": "Bill ate blue muffins two ."}.items():
        out = D.add_dep(g, place(spark, x=4), "x", "nummod", where, form="two")
        assert words(out) == want and len(edges(out)) == 5
        heads = {r.idx: r.form for r in out.nodes.collect()}
        assert {(heads[a], heads[b]) for a, b, r in edges(out) if r == "nummod"} == {("muffins", "two")}
        assert ("muffins", "blue", "amod") in {(heads[a], heads[b], r) for a, b, r in edges(out)}
    gap = D.delete_leaf(g, place(spark, x=1), "x")
    assert edges(D.reindex(gap)) == [(1, 3, "obj"), (1, 4, "punct"), (3, 2, "amod")]
    merged = D.merge_nodes(g, place(spark, a=4, b=3), "a", "b")
    assert words(merged) == "Bill ate bluemuffins ." and edges(merged) == [(2, 1, "nsubj"), (2, 4, "obj"), (2, 5, "punct")]
    assert words(D.collapse_below(g, place(spark, a=4), "a")) == "Bill ate bluemuffins ."
    assert {r.idx: (r.mwt_text, r.mwt_first) for r in D.mark_words(g, place(spark, a=3, b=4), "a", "b").nodes.collect() if r.mwt_text} == {3: ("bluemuffins", True), 4: ("bluemuffins", False)}
    split = D.split_word(g, place(spark, a=4), "a", ["(muf).*", "muf(fins)"], head=1, reln="goes")
    assert words(split) == "Bill ate blue muf fins ." and edges(split) == [(2, 1, "nsubj"), (2, 5, "obj"), (2, 6, "punct"), (5, 3, "amod"), (5, 4, "goes")]
    headed = D.set_phrase_head(g, place(spark, a=3, b=4), "a", "b", reln="head")
    assert edges(headed) == [(2, 1, "nsubj"), (2, 3, "obj"), (2, 5, "punct"), (3, 4, "head")]


def test_repeated_until_stable(spark, g):
    done = D.until_stable(g, "{}=a >/nsubj|obj/ {}=b", lambda g, at: D.relabel_edge(g, at, "a", "b", "arg"))
    assert edges(done) == [(2, 1, "arg"), (2, 4, "arg"), (2, 5, "punct"), (4, 3, "amod")]
    with pytest.raises(ValueError):
        D.until_stable(g, "{}=a >nsubj {}=b", lambda g, at: g, most_rounds=2)
