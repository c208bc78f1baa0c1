"""Edits of trees found by tree patterns, over bracketed trees.

An edit names nodes a pattern bound. Trees are small and edits change them in
place, so a tree is edited whole within its row; rows stay independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.operators.patterns import PatternError, TreePatterns, bracket, parse_bracket, tree_nodes


def _index(tree: list) -> tuple[list[list], dict[int, list]]:
    """Nodes in pre-order, and the parent of each by identity."""
    nodes, parents, stack = [], {}, [(tree, None)]
    while stack:
        node, parent = stack.pop()
        nodes.append(node)
        if parent is not None:
            parents[id(node)] = parent
        stack.extend((c, node) for c in reversed(node[1:]))
    return nodes, parents


def _place(parent: list, node: list) -> int:
    return next(i for i, c in enumerate(parent) if c is node)


def apply_edit(tree: list, edit: str, bound: dict[str, int]) -> list | None:
    """The tree after one edit; None if nothing is left.

    ``delete n``, ``prune n`` (and ancestors left empty), ``excise n`` (its
    children take its place), ``relabel n label`` (or ``/re/to/``), ``insert
    (X y) $+ n | $- n | >k n``, ``move n $+ m | $- m | >k m``, ``replace n m``.
    """
    nodes, parents = _index(tree)
    at = lambda name: nodes[bound[name]]
    op, rest = edit.split(None, 1)

    def put(new: list, where: str) -> None:
        how, name = where.split()
        target = at(name)
        if how[0] == "$":
            parent = parents[id(target)]
            # $+ means the new node is the left sister of the target
            parent.insert(_place(parent, target) + (0 if how == "$+" else 1), new)
        else:
            k = int(how[1:])
            target.insert(k if k > 0 else len(target) + k + 1, new)

    if op in ("delete", "prune", "excise"):
        for name in rest.split():
            node = at(name)
            parent = parents.get(id(node))
            if parent is None:
                if op == "excise" and len(node) == 2:
                    return node[1]
                return None
            k = _place(parent, node)
            parent[k : k + 1] = node[1:] if op == "excise" else []
            while op == "prune" and len(parent) == 1:
                above = parents.get(id(parent))
                if above is None:
                    return None
                del above[_place(above, parent)]
                parent = above
    elif op == "relabel":
        name, label = rest.split(None, 1)
        change = re.fullmatch(r"/(.*?)/(.*)/", label)
        at(name)[0] = re.sub(change[1], change[2], at(name)[0]) if change else label
    elif op == "insert":
        new, where = re.fullmatch(r"(\(.*\))\s+(\S+\s+\w+)", rest).groups()
        put(parse_bracket(new)[0], where)
    elif op == "move":
        name, where = rest.split(None, 1)
        node = at(name)
        parent = parents[id(node)]
        del parent[_place(parent, node)]
        put(node, where)
    elif op == "replace":
        old, new = rest.split()
        node, fresh = at(old), at(new)
        parent = parents.get(id(node))
        if parent is None:
            return fresh
        parent[_place(parent, node)] = fresh
    else:
        raise PatternError(f"unknown edit {op!r}")
    return tree


def edit_trees(trees: DataFrame, pattern: str, edits: list[str], id_column: str = "graph", text_column: str = "bracket") -> DataFrame:
    """``graph, bracket`` after the edits at each tree's first match of a pattern.

    Trees without a match stay as they are, trees edited away become null, and
    so do texts that aren't one tree. Ids should be unique.
    """
    compiler = TreePatterns(tree_nodes(trees, id_column, text_column))
    found = compiler.find(pattern)
    names = [c for c in found.columns if c not in ("graph", "node")]
    first = found.groupBy("graph").agg(F.min(F.struct("node", *names)).alias("m"))
    rows = trees.select(F.col(id_column).cast("string").alias("graph"), F.col(text_column).alias("text")).join(first, "graph", "left")
    rows = rows.select("graph", "text", *(F.col("m")[n].alias(f"n_{n}") for n in names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                try:
                    parsed = parse_bracket(r["text"] or "")
                except PatternError:
                    parsed = []
                tree = parsed[0] if len(parsed) == 1 else None
                bound = {n: int(r[f"n_{n}"]) for n in names if not pd.isna(r[f"n_{n}"])}
                for edit in edits if tree is not None and len(bound) == len(names) and names else []:
                    before = _index(tree)[0]
                    tree = apply_edit(tree, edit, bound)
                    if tree is None:
                        break
                    # names follow their nodes
                    now = {id(n): i for i, n in enumerate(_index(tree)[0])}
                    bound = {k: now[id(before[v])] for k, v in bound.items() if id(before[v]) in now}
                out.append((r["graph"], None if tree is None else bracket(tree)))
            yield pd.DataFrame(out, columns=["graph", "bracket"], dtype=object)

    return rows.mapInPandas(run, "graph string, bracket string")
