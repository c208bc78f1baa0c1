"""Graph and tree patterns against brute force, and literals."""

import itertools
import random

import pytest

from tessellex.operators.patterns import GraphPatterns, PatternError, TreePatterns, bracket, number_nodes, parse_bracket, tree_nodes

NODES = [("g", 1, "he", "PRP"), ("g", 2, "ate", "VBD"), ("g", 3, "the", "DT"), ("g", 4, "cake", "NN"), ("g", 5, "with", "IN"), ("g", 6, "joy", "NN")]
EDGES = [("g", 2, 1, "nsubj"), ("g", 2, 4, "obj"), ("g", 4, 3, "det"), ("g", 2, 6, "nmod"), ("g", 6, 5, "case")]


@pytest.fixture(scope="module")
def graphs(spark):
    return GraphPatterns(spark.createDataFrame(NODES, "graph string, idx int, word string, tag string"), spark.createDataFrame(EDGES, "graph string, gov int, dep int, reln string"))


def found(patterns, text, *names):
    rows = (tuple(r[n] for n in ("node", *names)) for r in patterns.find(text).collect())
    return sorted(rows, key=lambda t: tuple((x is None, x or 0) for x in t))


@pytest.mark.parametrize(
    "pattern, names, want",
    [
        ("{tag:/NN.*/}", (), [(4,), (6,)]),
        ("{tag:VBD} >nsubj {}=s >obj {}=o", ("s", "o"), [(2, 1, 4)]),
        ("{} >/nsubj|nmod/ {}=x", ("x",), [(2, 1), (2, 6)]),
        ("{tag:NN} !>case {}", (), [(4,)]),
        ("{tag:NN} ?>det {}=d", ("d",), [(4, 3), (6, None)]),
        ("{$}", (), [(2,)]),
        ("{word:with} <<nmod {}=x", ("x",), [(5, 2)]),
        ("{} >>case {}=x", ("x",), [(2, 5), (6, 5)]),
        ("{word:with} 2,2<< {}=x", ("x",), [(5, 2)]),
        ("{tag:NN}=a $++ {tag:NN}=b", ("a", "b"), [(4, 4, 6)]),
        ("{tag:DT} . {}=n", ("n",), [(3, 4)]),
        ("{tag:VBD} [ >obj {}=x | >nmod {}=x ]", ("x",), [(2, 4), (2, 6)]),
        ("{} >obj ({}=o >det {}=d)", ("o", "d"), [(2, 4, 3)]),
        ("{tag:VBD}=v >obj ({} < {}=v)", ("v",), [(2, 2)]),
        ("{tag!:NN} <> {word:cake}", (), [(2,), (3,)]),
    ],
)
def test_graph_patterns(graphs, pattern, names, want):
    order = lambda t: tuple((x is None, x or 0) for x in t)
    assert found(graphs, pattern, *names) == sorted(want, key=order)


def test_errors(graphs):
    for bad in ("{", "{} >", "!{}=n", "{} !> {}=n", "{} > {} )"):
        with pytest.raises(PatternError):
            graphs.find(bad)


def random_tree(rng, depth=0):
    label = rng.choice("ABC")
    if depth > 3 or rng.random() < 0.3:
        return [label, [rng.choice("xyz")]]
    return [label, *(random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 4)))]


def brute(rows, op):
    by = {r[0]: r for r in rows}
    anc = lambda x, y: x[0] < y[0] and y[1] < x[1]
    tests = {
        "<": lambda a, b: b[2] == a[0],
        "<<": anc,
        ">>": lambda a, b: anc(b, a),
        "$++": lambda a, b: a[2] is not None and a[2] == b[2] and b[3] > a[3],
        "$+": lambda a, b: a[2] is not None and a[2] == b[2] and b[3] == a[3] + 1,
        "..": lambda a, b: a[8] <= b[7],
        ",": lambda a, b: b[8] == a[7],
        "<-": lambda a, b: b[2] == a[0] and b[3] == a[4],
        "<:": lambda a, b: b[2] == a[0] and a[4] == 1,
        "<2": lambda a, b: b[2] == a[0] and b[3] == 2,
        ">-1": lambda a, b: a[2] == b[0] and a[3] == by[b[0]][4],
    }
    return {(a[0], b[0]) for a, b in itertools.product(rows, rows) if a[9] == "A" and b[9] == "B" and tests[op](a, b)}


def test_tree_relations_match_brute_force(spark):
    rng = random.Random(4)
    trees = [random_tree(rng) for _ in range(40)]
    texts = [(str(i), bracket(t)) for i, t in enumerate(trees)]
    assert [parse_bracket(t)[0] for _, t in texts] == trees
    nodes = tree_nodes(spark.createDataFrame(texts, "graph string, bracket string")).cache()
    patterns = TreePatterns(nodes)
    for op in ("<", "<<", ">>", "$++", "$+", "..", ",", "<-", "<:", "<2", ">-1"):
        got = {(r.graph, r.node, r.b) for r in patterns.find(f"A {op} B=b").collect()}
        want = {(str(i), x, y) for i, t in enumerate(trees) for x, y in brute(number_nodes(t), op)}
        assert got == want, op


def test_tree_patterns(spark):
    texts = [("1", "(S (NP (DT the) (NN cat)) (VP (VBD sat)))"), ("2", "(S (NP-SBJ (PRP he)) (VP (VBD ate) (NP (NN cake))))"), ("3", "(broken"), ("4", None), ("5", "")]
    patterns = TreePatterns(tree_nodes(spark.createDataFrame(texts, "graph string, bracket string")))
    rows = lambda p: sorted(r.graph for r in patterns.find(p).collect())
    assert rows("NP < (NN $- DT)") == ["1"]
    assert rows("@NP $+ VP") == ["1", "2"] and rows("NP $+ VP") == ["1"]
    assert rows("/^NP/ !< DT") == ["2", "2"] and rows("VP <<, VBD !<< NP") == ["1"]
    assert rows("S <1 /NP/=n <2 VP") == ["1", "2"] and rows("NN|PRP >: __") == ["2", "2"]


def test_deep_chains_keep_all_pairs_and_cycles_end(spark):
    chain = [("deep", i, i + 1, "x") for i in range(63)] + [("loop", 1, 2, "x"), ("loop", 2, 3, "y"), ("loop", 3, 2, "z")]
    ends = sorted({(g, n) for g, a, b, _ in chain for n in (a, b)})
    patterns = GraphPatterns(spark.createDataFrame(ends, "graph string, idx int").coalesce(1), spark.createDataFrame(chain, "graph string, gov int, dep int, reln string").coalesce(1))
    pairs = {(r.graph, r.a, r.b) for r in patterns.closure().select("graph", "a", "b").distinct().collect()}
    assert pairs == {("deep", i, j) for i in range(64) for j in range(i + 1, 64)} | {("loop", 1, 2), ("loop", 1, 3), ("loop", 2, 3), ("loop", 3, 2)}


def test_graph_rounds_run_to_the_end_or_raise(spark):
    from tessellex.operators.graphs import components, descendants

    edges = spark.createDataFrame([(i, i + 1) for i in range(102)], "src int, dst int").coalesce(1)
    starts = spark.createDataFrame([(0,)], "node int")
    assert descendants(edges, starts).count() == 102
    with pytest.raises(ValueError):
        descendants(edges, starts, 3)
    with pytest.raises(ValueError):
        components(edges, 1)
