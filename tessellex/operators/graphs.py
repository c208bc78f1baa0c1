"""Graph and hierarchy operators over edge tables.

Iterations keep only the frontier, are cut by checkpoints so that plans stay
short and lost executors don't restart them, and end when nothing changes;
``most_rounds``, if given, raises where that takes more rounds.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.session import cut_lineage


def roots(edges: DataFrame) -> DataFrame:
    """Nodes with an edge out but none in: ``node``."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("children"))


def siblings(edges: DataFrame) -> DataFrame:
    """``node, siblings``: how many other children its parent has; counted, not paired."""
    per = edges.groupBy("src").agg(F.count("*").alias("n"))
    return edges.join(per, "src").select(F.col("dst").alias("node"), (F.col("n") - 1).alias("siblings"))


def _within(done: int, most_rounds: int | None) -> None:
    if most_rounds is not None and done >= most_rounds:
        raise ValueError(f"not finished after {most_rounds} rounds")


def descendants(edges: DataFrame, starts: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``root, node, depth`` of everything below the given ``node`` rows; least depth."""
    frontier = starts.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    found = frontier
    for depth in count(1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut_lineage(step.join(found.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        _within(depth, most_rounds)
        found = cut_lineage(found.unionByName(frontier)) if depth % 5 == 0 else found.unionByName(frontier)
    return found.where("depth > 0")


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """``node, component``: least node of each undirected component.

    Labels spread over edges and jump to their own label's label each round,
    so rounds grow with the logarithm of the diameter, and the label of a hub
    reaches its neighbours by partially aggregated minima.
    """
    both = cut_lineage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    for done in count(1):
        spread = both.join(labels.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(spread, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old")
        step = cut_lineage(step)
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            break
        _within(done, most_rounds)
    return labels


def shortest_paths(edges: DataFrame, start, most_rounds: int | None = None) -> DataFrame:
    """``node, distance`` in edges from one node (breadth first)."""
    first = edges.sparkSession.createDataFrame([(start,)], edges.select(F.col("src").alias("node")).schema)
    found = descendants(edges, first, most_rounds)
    return first.select("node", F.lit(0).alias("distance")).unionByName(found.select("node", F.col("depth").alias("distance")))


def number_tree(edges: DataFrame, root_column: str = "root") -> DataFrame:
    """Path order of a forest: ``node, parent, depth, path`` with zero-padded
    child numbers, so that ancestors are prefixes and siblings sort in order.

    ``edges``: src (parent), dst (child), ord (place among the siblings); a
    cycle below a root raises.
    """
    frontier = roots(edges).select("node", F.lit(None).cast(edges.schema["src"].dataType).alias("parent"), F.lit(0).alias("depth"), F.lpad(F.dense_rank().over(_all_by_node()).cast("string"), 8, "0").alias("path"))
    found = frontier
    most = None
    for depth in count(1):
        step = frontier.select(F.col("node").alias("src"), "path").join(edges, "src")
        frontier = cut_lineage(step.select(F.col("dst").alias("node"), F.col("src").alias("parent"), F.lit(depth).alias("depth"), F.concat("path", F.lit("."), F.lpad(F.col("ord").cast("string"), 8, "0")).alias("path")))
        if frontier.isEmpty():
            break
        if depth >= 200:  # deeper than there are children: a cycle
            most = edges.select("dst").distinct().count() if most is None else most
            if depth > most:
                raise ValueError("number_tree: the edges hold a cycle")
        found = cut_lineage(found.unionByName(frontier)) if depth % 20 == 0 else found.unionByName(frontier)
    return found


def _all_by_node():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy("node")
