"""Edits of dependency graphs at the places a pattern found.

A ``Graph`` holds ``nodes`` (graph, idx, attributes), ``edges`` (graph, gov,
dep, reln) and, where they are set by hand, ``roots`` (graph, idx). Every edit
takes a graph and a table of places (``graph`` and the pattern's named nodes)
and gives a new graph; edits are joins on the graph's key, so graphs stay
where they are once partitioned by it. Places that name no node of the graph
change nothing. Edits that move word numbers take the first place of a graph
(by its named node); ``until_stable`` repeats an edit while its pattern matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellex.operators.patterns import GraphPatterns
from tessellex.operators.tokenize import lemma as lemma_of
from tessellex.session import cut_lineage


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame | None = None

    def find(self, pattern: str) -> DataFrame:
        return GraphPatterns(self.nodes, self.edges).find(pattern)

    def root_nodes(self) -> DataFrame:
        """The roots set by hand, else the nodes without an incoming edge."""
        if self.roots is not None:
            return self.roots
        heads = self.edges.select("graph", F.col("dep").alias("idx")).distinct()
        return self.nodes.select("graph", "idx").join(heads, ["graph", "idx"], "left_anti")

    def below(self) -> DataFrame:
        """``graph, a, b``: every node with every one it dominates."""
        return GraphPatterns(self.nodes, self.edges).closure().select("graph", "a", "b").distinct()


def _named(at: DataFrame, **columns: str) -> DataFrame:
    return at.select("graph", *(F.col(f"`{c}`").cast("int").alias(n) for n, c in columns.items())).distinct()


def _first(at: DataFrame, column: str, *more: str) -> DataFrame:
    """One place per graph: the one with the least node."""
    names = [column, *more]
    best = F.min(F.struct(*(F.col(f"`{n}`").cast("int").alias(f"c{i}") for i, n in enumerate(names))))
    return at.groupBy("graph").agg(best.alias("s")).select("graph", *(F.col(f"s.c{i}").alias(n) for i, n in enumerate(names)))


def add_edge(g: Graph, at: DataFrame, gov: str, dep: str, reln: str) -> Graph:
    """An edge between two named nodes; one that is there already isn't doubled."""
    known = g.nodes.select("graph", F.col("idx"))
    new = _named(at, gov=gov, dep=dep)
    for end in ("gov", "dep"):
        new = new.join(known.withColumnRenamed("idx", end), ["graph", end], "left_semi")
    new = new.select("graph", "gov", "dep", F.lit(reln).alias("reln")).join(g.edges, ["graph", "gov", "dep", "reln"], "left_anti")
    return replace(g, edges=g.edges.select("graph", "gov", "dep", "reln").unionByName(new))


def remove_edge(g: Graph, at: DataFrame, gov: str | None = None, dep: str | None = None, reln: str | None = None) -> Graph:
    """Edges between the named ends (any where none is named) with that label."""
    ends = {k: v for k, v in (("gov", gov), ("dep", dep)) if v}
    gone = _named(at, **ends)
    hit = g.edges.where(F.lit(True) if reln is None else F.col("reln") == reln).join(gone, ["graph", *ends], "left_semi").select("graph", "gov", "dep", "reln").distinct()
    return replace(g, edges=g.edges.join(hit, ["graph", "gov", "dep", "reln"], "left_anti"))


def relabel_edge(g: Graph, at: DataFrame, gov: str, dep: str, reln: str, old: str | None = None) -> Graph:
    """Another label for the edges between two named nodes."""
    hit = _named(at, gov=gov, dep=dep).withColumn("_hit", F.lit(True))
    new = F.when(F.col("_hit") & (F.lit(True) if old is None else F.col("reln") == old), reln).otherwise(F.col("reln"))
    return replace(g, edges=g.edges.join(hit, ["graph", "gov", "dep"], "left").select("graph", "gov", "dep", new.alias("reln")).distinct())


def reattach_edge(g: Graph, at: DataFrame, gov: str, dep: str, new_gov: str | None = None, new_dep: str | None = None) -> Graph:
    """Moves the ends of the edges between two named nodes."""
    moved = _named(at, gov=gov, dep=dep, g2=new_gov or gov, d2=new_dep or dep).dropDuplicates(["graph", "gov", "dep"])
    rows = g.edges.join(moved, ["graph", "gov", "dep"], "left")
    return replace(g, edges=rows.select("graph", F.coalesce("g2", "gov").alias("gov"), F.coalesce("d2", "dep").alias("dep"), "reln").distinct())


def add_node(g: Graph, at: DataFrame, **attributes: str) -> Graph:
    """A free node after the last word of every graph with a place."""
    last = g.nodes.groupBy("graph").agg((F.max("idx") + 1).alias("idx"))
    new = last.join(at.select("graph").distinct(), "graph", "left_semi")
    cells = [F.lit(attributes.get(c)).cast(g.nodes.schema[c].dataType).alias(c) for c in g.nodes.columns if c not in ("graph", "idx")]
    return replace(g, nodes=g.nodes.unionByName(new.select("graph", "idx", *cells)))


def _shift(g: Graph, cuts: DataFrame, by: Column) -> Graph:
    """Moves the numbers from ``cut`` on."""
    move = lambda c: F.col(c) + F.when(F.col(c) >= F.col("cut"), by).otherwise(0)
    nodes = g.nodes.join(cuts, "graph", "left").withColumn("idx", move("idx").cast("int")).select(*g.nodes.columns)
    edges = g.edges.join(cuts, "graph", "left").select("graph", move("gov").cast("int").alias("gov"), move("dep").cast("int").alias("dep"), "reln")
    roots = g.roots.join(cuts, "graph", "left").select("graph", move("idx").cast("int").alias("idx")) if g.roots is not None else None
    return Graph(nodes, edges, roots)


def add_dep(g: Graph, at: DataFrame, gov: str, reln: str, place: str = "after", **attributes: str) -> Graph:
    """A new word under a named node: ``first``, ``last``, ``before`` or ``after`` it."""
    size = g.nodes.groupBy("graph").agg(F.max("idx").alias("top"))
    cut = {"first": F.lit(1), "last": F.col("top") + 1, "before": F.col("gov"), "after": F.col("gov") + 1}[place]
    known = g.nodes.select("graph", F.col("idx").alias("gov"))
    spot = cut_lineage(_first(at, gov).select("graph", F.col(f"`{gov}`").alias("gov")).join(known, ["graph", "gov"]).join(size, "graph").select("graph", "gov", cut.alias("cut")))
    moved = _shift(g, spot.select("graph", "cut"), F.lit(1))
    cells = [F.lit(attributes.get(c)).cast(g.nodes.schema[c].dataType).alias(c) for c in g.nodes.columns if c not in ("graph", "idx")]
    nodes = moved.nodes.unionByName(spot.select("graph", F.col("cut").cast("int").alias("idx"), *cells))
    above = F.when(F.col("gov") >= F.col("cut"), F.col("gov") + 1).otherwise(F.col("gov"))
    edges = moved.edges.unionByName(spot.select("graph", above.cast("int").alias("gov"), F.col("cut").cast("int").alias("dep"), F.lit(reln).alias("reln")))
    return replace(moved, nodes=nodes, edges=edges)


def _without(g: Graph, gone: DataFrame) -> Graph:
    """The graph without nodes (``graph, idx``) and what touches them."""
    nodes = g.nodes.join(gone, ["graph", "idx"], "left_anti")
    edges = g.edges
    for end in ("gov", "dep"):
        edges = edges.join(gone.withColumnRenamed("idx", end), ["graph", end], "left_anti")
    roots = g.roots.join(gone, ["graph", "idx"], "left_anti") if g.roots is not None else None
    return Graph(nodes, edges.select("graph", "gov", "dep", "reln"), roots)


def delete_below(g: Graph, at: DataFrame, node: str) -> Graph:
    """A named node with all it dominates."""
    tops = _named(at, a=node)
    return _without(g, g.below().join(tops, ["graph", "a"]).select("graph", F.col("b").alias("idx")).unionByName(tops.withColumnRenamed("a", "idx")).distinct())


def delete_leaf(g: Graph, at: DataFrame, node: str) -> Graph:
    """A named node, if nothing hangs on it."""
    inner = g.edges.select("graph", F.col("gov").alias("idx"))
    return _without(g, _named(at, idx=node).join(inner, ["graph", "idx"], "left_anti"))


def edit_node(g: Graph, at: DataFrame, node: str, **attributes: str | None) -> Graph:
    """Sets attributes of a named node (None empties one)."""
    rows = g.nodes.join(_named(at, idx=node).withColumn("_hit", F.lit(True)), ["graph", "idx"], "left")
    cells = [F.when(F.col("_hit"), F.lit(attributes[c]).cast(g.nodes.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in attributes else F.col(c) for c in g.nodes.columns]
    return replace(g, nodes=rows.select(*cells))


def lemmatize(g: Graph, at: DataFrame, node: str, word: str = "form", tag: str = "xpos", lemma: str = "lemma") -> Graph:
    """Sets the lemma of a named node from its word and tag, in Arrow batches."""
    def run(words: pd.Series, tags: pd.Series) -> pd.Series:
        return pd.Series([None if w is None else lemma_of(w, t or "") for w, t in zip(words, tags)], dtype=object)

    udf = F.pandas_udf(run, "string")
    rows = g.nodes.join(_named(at, idx=node).withColumn("_hit", F.lit(True)), ["graph", "idx"], "left")
    own = F.col(lemma) if lemma in g.nodes.columns else F.lit(None).cast("string")
    out = rows.withColumn(lemma, F.when(F.col("_hit"), udf(word, tag)).otherwise(own))
    return replace(g, nodes=out.select(*dict.fromkeys([*g.nodes.columns, lemma])))


def kill_incoming(g: Graph, at: DataFrame, node: str) -> Graph:
    """All edges into a named node."""
    return replace(g, edges=g.edges.join(_named(at, dep=node), ["graph", "dep"], "left_anti").select("graph", "gov", "dep", "reln"))


def kill_unreachable(g: Graph) -> Graph:
    """Nodes that no root reaches."""
    tops = g.root_nodes()
    reached = tops.unionByName(g.below().join(tops.withColumnRenamed("idx", "a"), ["graph", "a"]).select("graph", F.col("b").alias("idx")))
    return _without(g, g.nodes.select("graph", "idx").join(reached.distinct(), ["graph", "idx"], "left_anti"))


def set_roots(g: Graph, at: DataFrame, *nodes: str) -> Graph:
    """The named nodes as the only roots of their graphs; other graphs keep theirs."""
    new = at.select("graph", F.explode(F.array(*(F.col(f"`{n}`").cast("int") for n in nodes))).alias("idx")).distinct()
    kept = g.root_nodes().join(at.select("graph").distinct(), "graph", "left_anti").select("graph", "idx")
    return replace(g, roots=kept.unionByName(new))


def _merge(g: Graph, groups: DataFrame, word: str) -> Graph:
    """Nodes (``graph, idx, head``) as one, under the head's number: words joined in order."""
    rows = g.nodes.join(groups, ["graph", "idx"], "left").withColumn("_to", F.coalesce("head", "idx"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(word).alias("w")))), lambda x: x["w"]), "")
    own = F.col("idx") == F.col("_to")
    others = [F.first(F.when(own, F.col(c)), ignorenulls=True).alias(c) for c in g.nodes.columns if c not in ("graph", "idx", word)]
    nodes = rows.groupBy("graph", F.col("_to").alias("idx")).agg(text.alias(word), *others).select(*g.nodes.columns)
    to = groups.select("graph", F.col("idx"), "head")
    edges = g.edges
    for end in ("gov", "dep"):
        edges = edges.join(to.select("graph", F.col("idx").alias(end), F.col("head").alias("_to")), ["graph", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return replace(g, nodes=nodes, edges=edges.where("gov <> dep").select("graph", "gov", "dep", "reln").distinct())


def merge_nodes(g: Graph, at: DataFrame, head: str, *others: str, word: str = "form") -> Graph:
    """Named nodes as one word under the head's number."""
    one = _first(at, head, *others)
    return _merge(g, one.select("graph", F.explode(F.array(*(F.col(f"`{n}`") for n in (head, *others)))).alias("idx"), F.col(f"`{head}`").alias("head")).distinct(), word)


def collapse_below(g: Graph, at: DataFrame, node: str, word: str = "form") -> Graph:
    """A named node and all below it as one word."""
    top = _first(at, node).select("graph", F.col(f"`{node}`").alias("a"))
    inside = g.below().join(top, ["graph", "a"]).where("b <> a").select("graph", F.col("b").alias("idx"), F.col("a").alias("head"))
    return _merge(g, inside.unionByName(top.select("graph", F.col("a").alias("idx"), F.col("a").alias("head"))).distinct(), word)


def reindex(g: Graph) -> Graph:
    """Words numbered 1 to n in their order."""
    new = g.nodes.select("graph", "idx", F.row_number().over(Window.partitionBy("graph").orderBy("idx")).alias("_to"))
    nodes = g.nodes.join(new, ["graph", "idx"]).withColumn("idx", F.col("_to")).select(*g.nodes.columns)
    edges = g.edges
    for end in ("gov", "dep"):
        edges = edges.join(new.withColumnRenamed("idx", end), ["graph", end]).withColumn(end, F.col("_to")).drop("_to")
    roots = g.roots.join(new, ["graph", "idx"]).select("graph", F.col("_to").alias("idx")) if g.roots is not None else None
    return Graph(nodes, edges.select("graph", "gov", "dep", "reln"), roots)


def mark_words(g: Graph, at: DataFrame, *nodes: str, text: str | None = None, word: str = "form") -> Graph:
    """Named nodes as one written word: adds ``mwt_text`` and ``mwt_first``."""
    one = _first(at, *nodes)
    rows = one.select("graph", F.explode(F.array(*(F.col(f"`{n}`") for n in nodes))).alias("idx"))
    words = rows.join(g.nodes, ["graph", "idx"]).groupBy("graph").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col(word).alias("w")))), lambda x: x["w"]), "").alias("_own"), F.min("idx").alias("_first"))
    hit = rows.join(words, "graph").select("graph", "idx", (F.col("_own") if text is None else F.lit(text)).alias("_text"), (F.col("idx") == F.col("_first")).alias("_is"))
    out = g.nodes.join(hit, ["graph", "idx"], "left")
    old = [F.col(c) if c in g.nodes.columns else F.lit(None) for c in ("mwt_text", "mwt_first")]
    kept = [c for c in g.nodes.columns if c not in ("mwt_text", "mwt_first")]
    return replace(g, nodes=out.select(*kept, F.coalesce("_text", old[0].cast("string")).alias("mwt_text"), F.coalesce("_is", old[1].cast("boolean")).alias("mwt_first")))


def split_word(g: Graph, at: DataFrame, node: str, pieces: list[str], head: int = 0, reln: str = "dep", word: str = "form") -> Graph:
    """A named node as several: piece k is group 1 of pattern k over its word.

    Piece ``head`` keeps the node's edges and attributes, the others hang on
    it. A word that some pattern doesn't match isn't split.
    """
    one = _first(at, node).select("graph", F.col(f"`{node}`").alias("idx")).join(g.nodes, ["graph", "idx"])
    parts = F.array(*(F.regexp_extract(word, f"^(?:{p})$", 1) for p in pieces))
    spot = cut_lineage(one.where(F.forall(parts, lambda x: x != "")).withColumn("_parts", parts))
    n = len(pieces)
    moved = _shift(g, spot.select("graph", (F.col("idx") + 1).alias("cut")), F.lit(n - 1))
    # the node's own edges move to the head piece
    to = spot.select("graph", F.col("idx").alias("_old"))
    stay = moved.nodes.join(to.withColumnRenamed("_old", "idx"), ["graph", "idx"], "left_anti")
    piece = spot.select("*", F.posexplode("_parts").alias("_k", "_w"))
    cells = [F.col("_w").alias(c) if c == word else (F.col("idx") + F.col("_k")).cast("int").alias(c) if c == "idx" else F.col(c) if c == "graph" else F.when(F.col("_k") == head, F.col(c)).alias(c) for c in g.nodes.columns]
    edges = moved.edges.join(to, "graph", "left")
    own = lambda c: F.when(F.col(c) == F.col("_old"), F.col(c) + head).otherwise(F.col(c)).cast("int").alias(c)
    edges = edges.select("graph", own("gov"), own("dep"), "reln")
    hang = piece.where(F.col("_k") != head).select("graph", (F.col("idx") + head).cast("int").alias("gov"), (F.col("idx") + F.col("_k")).cast("int").alias("dep"), F.lit(reln).alias("reln"))
    return replace(moved, nodes=stay.unionByName(piece.select(*cells)), edges=edges.unionByName(hang))


def set_phrase_head(g: Graph, at: DataFrame, head: str, *members: str, reln: str = "dep") -> Graph:
    """One of the named nodes as the head of the others.

    Edges among them go; edges between them and the rest of the graph move to
    the head; the other members hang on it.
    """
    one = _first(at, head, *members)
    group = one.select("graph", F.explode(F.array(*(F.col(f"`{n}`") for n in (head, *members)))).alias("idx"), F.col(f"`{head}`").alias("head")).distinct()
    group = group.join(g.nodes, ["graph", "idx"], "left_semi")
    edges = g.edges
    for end in ("gov", "dep"):
        edges = edges.join(group.select("graph", F.col("idx").alias(end), F.col("head").alias(f"_{end}")), ["graph", end], "left")
    inside = F.col("_gov").isNotNull() & F.col("_dep").isNotNull()
    kept = edges.where(~inside).select("graph", F.coalesce("_gov", "gov").alias("gov"), F.coalesce("_dep", "dep").alias("dep"), "reln").distinct()
    hang = group.where("idx <> head").select("graph", F.col("head").alias("gov"), F.col("idx").alias("dep"), F.lit(reln).alias("reln"))
    return replace(g, edges=kept.unionByName(hang))


def until_stable(g: Graph, pattern: str, edit: Callable[[Graph, DataFrame], Graph], most_rounds: int = 100) -> Graph:
    """Repeats an edit while its pattern matches; raises where that doesn't end."""
    for _ in range(most_rounds):
        at = cut_lineage(g.find(pattern))
        if at.isEmpty():
            return g
        g = edit(g, at)
        g = Graph(cut_lineage(g.nodes), cut_lineage(g.edges), cut_lineage(g.roots) if g.roots is not None else None)
    raise ValueError(f"the pattern still matches after {most_rounds} rounds")
