"""Patterns over dependency graphs and over trees, compiled to joins.

A pattern is a node description followed by relations, all relative to that
first node: ``{tag:/N.*/}=n >nsubj {word:he} !>neg {}`` over graphs,
``NP=n < /^NN/ $+ VP`` over trees. A relation becomes an inner join, a negated
one an anti join, an optional one an outer join, ``|`` a union; a name used
twice is one node. Catalyst picks the joins; every join has the graph's key,
so one hash partitioning serves the whole pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.session import cut_lineage

# ---------------------------------------------------------------- syntax


@dataclass
class Node:
    """A description, its name, and what must relate to the node."""

    text: str
    name: str | None = None
    negated: bool = False
    rest: Relations | None = None


@dataclass
class Relation:
    op: str
    label: str | None
    node: Node
    edge: str | None = None


@dataclass
class Relations:
    """Alternatives of conjunctions; an entry is (prefix, relation or group)."""

    choices: list[list[tuple[str, Relation | Relations]]] = field(default_factory=list)


class PatternError(ValueError):
    pass


class _Reader:
    def __init__(self, text: str, node: re.Pattern, relation: re.Pattern):
        self.text, self.at, self.node_re, self.relation_re = text, 0, node, relation

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self, what: str) -> bool:
        self.space()
        return self.text.startswith(what, self.at)

    def take(self, what: str) -> bool:
        if self.peek(what):
            self.at += len(what)
            return True
        return False

    def match(self, pattern: re.Pattern) -> re.Match | None:
        self.space()
        found = pattern.match(self.text, self.at)
        if found and found.end() > self.at:
            self.at = found.end()
            return found
        return None

    def pattern(self) -> Node:
        node = self.nested()
        self.space()
        if self.at < len(self.text):
            raise PatternError(f"unexpected {self.text[self.at:]!r}")
        return node

    def nested(self) -> Node:
        if self.take("("):
            node = self.nested()
            if not self.take(")"):
                raise PatternError("missing )")
            if self.starts_relation():
                extra = self.relations()
                node.rest = extra if node.rest is None else Relations([[("", node.rest), ("", extra)]])
            return node
        node = self.single()
        if self.starts_relation():
            node.rest = self.relations()
        return node

    def single(self) -> Node:
        negated = self.take("!")
        found = self.match(self.node_re)
        if not found:
            raise PatternError(f"node expected at {self.text[self.at:]!r}")
        name = self.match(re.compile(r"=(\w+)"))
        if name and negated:
            raise PatternError("a negated node can't be named")
        return Node(found[0], name[1] if name else None, negated)

    def starts_relation(self) -> bool:
        self.space()
        if self.at >= len(self.text) or self.text[self.at] in ")]|":
            return False
        here = self.at
        self.take("&")
        self.match(re.compile("[!?]"))
        ok = self.peek("[") or self.match(self.relation_re) is not None
        self.at = here
        return ok

    def relations(self) -> Relations:
        out = Relations([self.conjunction()])
        while self.take("|"):
            out.choices.append(self.conjunction())
        return out

    def conjunction(self) -> list[tuple[str, Relation | Relations]]:
        items = []
        while True:
            self.take("&")
            prefix = self.match(re.compile("[!?]"))
            if self.take("["):
                inner = self.relations()
                if not self.take("]"):
                    raise PatternError("missing ]")
                items.append((prefix[0] if prefix else "", inner))
            else:
                found = self.match(self.relation_re)
                if not found:
                    raise PatternError(f"relation expected at {self.text[self.at:]!r}")
                edge = self.match(re.compile(r"~(\w+)"))
                node = self.nested() if self.peek("(") else self.single()
                items.append((prefix[0] if prefix else "", Relation(found["op"], found.groupdict().get("label") or None, node, edge[1] if edge else None)))
            if not self.starts_relation():
                return items


def names_of(node: Node) -> set[str]:
    out = {node.name} - {None}

    def walk(rel: Relations) -> None:
        for choice in rel.choices:
            for prefix, item in choice:
                if isinstance(item, Relations):
                    walk(item)
                else:
                    inner = names_of(item.node)
                    if prefix == "!" and inner - out:
                        raise PatternError("no new names under a negation")
                    out.update(inner)

    if node.rest:
        walk(node.rest)
    return out


# ---------------------------------------------------------------- joins


class Compiler:
    """Turns a pattern into a plan; subclasses know nodes and relations."""

    key: tuple[str, ...] = ("graph",)

    def find(self, pattern: str) -> DataFrame:
        """Distinct matches: ``graph``, ``node`` (the first node) and the named nodes."""
        tree = self.parse(pattern)
        names = sorted(names_of(tree))
        self.fresh = (f"_n{i}" for i in count())
        frame, var = self.nodes(tree)
        for name in names:
            if f"={name}" not in frame.columns:
                frame = frame.withColumn(f"={name}", F.lit(None).cast(frame.schema[var].dataType))
        edges = [c for c in frame.columns if c.startswith("~")]
        return frame.select("graph", self.id(F.col(var)).alias("node"), *(self.id(F.col(f"`={n}`")).alias(n) for n in names), *(F.col(f"`{e}`").alias(e[1:]) for e in edges)).distinct()

    def nodes(self, node: Node) -> tuple[DataFrame, str]:
        var = next(self.fresh)
        frame = self.candidates(node.text, node.negated, var)
        if node.name:
            frame = frame.withColumn(f"={node.name}", F.col(var))
        if node.rest:
            frame = self.relate(frame, var, node.rest)
        return frame, var

    def relate(self, frame: DataFrame, var: str, rest: Relations) -> DataFrame:
        parts = [reduce(lambda f, item: self.one(f, var, *item), choice, frame) for choice in rest.choices]
        return parts[0] if len(parts) == 1 else reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).distinct()

    def one(self, frame: DataFrame, var: str, prefix: str, item: Relation | Relations) -> DataFrame:
        if isinstance(item, Relations):
            inner = self.relate(frame, var, item)
            if not prefix:
                return inner
            keys = inner.select("graph", self.id(F.col(var)).alias("_k")).distinct()
            marked = frame.withColumn("_k", self.id(F.col(var)))
            if prefix == "!":
                return marked.join(keys, ["graph", "_k"], "left_anti").drop("_k")
            rest = marked.join(keys, ["graph", "_k"], "left_anti").drop("_k")
            return inner.unionByName(rest, allowMissingColumns=True)
        right, other = self.nodes(item.node)
        shared = [c for c in right.columns if c.startswith("=") and c in frame.columns]
        right = right.select(F.col("graph").alias("_g"), other, *(F.col(f"`{c}`").alias(c + "'") for c in right.columns if c.startswith(("=", "~"))))
        pairs, condition = self.relation(item, var, other)
        if pairs is not None:
            right = right.join(pairs, (F.col("_g") == F.col("_pg")) & (self.id(F.col(other)) == F.col("_pb"))).drop("_pg", "_pb")
        on = (F.col("graph") == F.col("_g")) & condition
        for c in shared:
            on &= self.id(F.col(f"`{c}`")) == self.id(F.col(f"`{c}'`"))
        if prefix == "!":
            return frame.join(right, on, "left_anti")
        joined = frame.join(right, on, "left" if prefix == "?" else "inner")
        if item.edge and pairs is not None:
            joined = joined.withColumn(f"~{item.edge}", F.col("_reln"))
        keep = [F.col(f"`{c}`") for c in frame.columns] + ([F.col(f"`~{item.edge}`")] if item.edge and pairs is not None else [])
        keep += [F.col(f"`{c}`").alias(c[:-1]) for c in right.columns if c.endswith("'") and c[:-1] not in shared]
        return joined.select(*keep)


class GraphPatterns(Compiler):
    """Patterns over dependency graphs.

    ``nodes``: graph, idx and attribute columns; ``edges``: graph, gov, dep,
    reln. Node: ``{attr:value;attr:/regex/}`` (regexes match whole values,
    ``!:`` negates), ``{$}`` for roots. Relations: ``> < >> << <> $+ $- $++
    $-- . - .. -- >++ >-- <++ <-- ==``, each with a label or ``/regex/``;
    ``2,3>>`` bounds the distance. With a label, ``>>`` looks at the last edge
    and ``<<`` at the first one.
    """

    _NODE = re.compile(r"\{[^{}]*\}")
    _RELATION = re.compile(r"(?P<op>(?:\d+,\d+)?(?:>>|<<)|>\+\+|>--|<\+\+|<--|<>|\$\+\+|\$--|\$\+|\$-|==|\.\.|--|>|<|\.|-)(?P<label>/(?:[^/\\]|\\.)*/|[\w:]+)?")

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.all_nodes, self.edges = nodes, edges
        self._closure: DataFrame | None = None

    def parse(self, pattern: str) -> Node:
        return _Reader(pattern, self._NODE, self._RELATION).pattern()

    def id(self, node: Column) -> Column:
        return node["idx"]

    @staticmethod
    def _value(column: Column, value: str) -> Column:
        if value == "//":
            return column.isNull() | (column == "")
        if value.startswith("/"):
            return column.rlike(f"^(?:{value[1:-1]})$")
        return column == value.strip('"')

    def candidates(self, text: str, negated: bool, var: str) -> DataFrame:
        test, frame = F.lit(True), self.all_nodes
        body = text[1:-1].strip()
        if body == "$":
            heads = self.edges.select("graph", F.col("dep").alias("idx")).distinct()
            frame = frame.join(heads, ["graph", "idx"], "left_anti")
        else:
            for part in filter(None, (p.strip() for p in re.split(r";(?=(?:[^/]*/[^/]*/)*[^/]*$)", body))):
                name, value = part.split(":", 1)
                if name.endswith("!"):
                    name, own = name[:-1], False
                else:
                    own = not value.startswith("!")
                one = F.coalesce(self._value(F.col(name.strip()).cast("string"), value.lstrip("!").strip()), F.lit(False))
                test &= one if own else ~one
        return frame.where(~test if negated else test).select("graph", F.struct("idx").alias(var))

    def closure(self, most: int = 60) -> DataFrame:
        """``graph, a, b, dist, first, last``: paths from governor to descendant.

        From ``most`` edges on, only paths with at most one edge more than their
        graph has nodes: all pairs with their first and last edges are found by
        then, and cycles end.
        """
        if self._closure is None:
            step = self.edges.select("graph", F.col("gov").alias("a"), F.col("dep").alias("b"), F.lit(1).alias("dist"), F.col("reln").alias("first"), F.col("reln").alias("last"))
            found = step
            ends = self.edges.select("graph", F.explode(F.array("gov", "dep")).alias("node"))
            nodes = ends.groupBy("graph").agg(F.countDistinct("node").alias("nodes"))
            for d in count(2):
                nxt = step.select("graph", "a", F.col("b").alias("gov"), "first").join(self.edges, ["graph", "gov"])
                if d >= most:
                    nxt = nxt.join(nodes.where(F.col("nodes") >= d - 1).select("graph"), "graph", "left_semi")
                step = cut_lineage(nxt.where("a <> dep").select("graph", "a", F.col("dep").alias("b"), F.lit(d).alias("dist"), "first", F.col("reln").alias("last")).distinct())
                if step.isEmpty():
                    break
                found = cut_lineage(found.unionByName(step)) if d % 20 == 0 else found.unionByName(step)
            self._closure = cut_lineage(found)
        return self._closure

    def relation(self, rel: Relation, var: str, other: str) -> tuple[DataFrame | None, Column]:
        op, label = rel.op, rel.label
        a, b = self.id(F.col(var)), self.id(F.col(other))
        order = {".": b == a + 1, "-": b == a - 1, "..": a < b, "--": a > b, "==": a == b}
        if op in order:
            return None, order[op]
        test = (lambda c: F.lit(True)) if label is None else (lambda c: F.col(c).rlike(f"^(?:{label[1:-1]})$") if label.startswith("/") else F.col(c) == label)
        e = self.edges
        down = e.where(test("reln")).select("graph", F.col("gov").alias("a"), F.col("dep").alias("b"), "reln")
        up = e.where(test("reln")).select("graph", F.col("dep").alias("a"), F.col("gov").alias("b"), "reln")
        if op in (">", ">++", ">--"):
            pairs = down
        elif op in ("<", "<++", "<--"):
            pairs = up
        elif op == "<>":
            pairs = down.unionByName(up)
        elif op.startswith("$"):
            left, right = e.select("graph", "gov", F.col("dep").alias("a")), e.where(test("reln")).select("graph", "gov", F.col("dep").alias("b"), "reln")
            pairs = left.join(right, ["graph", "gov"]).where("a <> b").drop("gov")
            pairs = pairs.where({"$+": F.col("b") == F.col("a") + 1, "$-": F.col("b") == F.col("a") - 1, "$++": F.col("b") > F.col("a"), "$--": F.col("b") < F.col("a")}[op])
        else:
            bounds = re.match(r"(\d+),(\d+)", op)
            paths = self.closure()
            if bounds:
                paths = paths.where(F.col("dist").between(int(bounds[1]), int(bounds[2])))
            if op.endswith(">>"):
                pairs = paths.where(test("last")).select("graph", "a", "b", F.col("last").alias("reln"))
            else:
                pairs = paths.where(test("first")).select("graph", F.col("b").alias("a"), F.col("a").alias("b"), F.col("first").alias("reln"))
            pairs = pairs.distinct()
        if op.endswith("++") and not op.startswith("$"):
            pairs = pairs.where("b > a")
        elif op.endswith("--") and not op.startswith("$"):
            pairs = pairs.where("b < a")
        pairs = pairs.select(F.col("graph").alias("_pg"), F.col("a").alias("_pa"), F.col("b").alias("_pb"), F.col("reln").alias("_reln"))
        return pairs, a == F.col("_pa")


class TreePatterns(Compiler):
    """Patterns over constituency trees as node tables (see ``tree_nodes``).

    Node: a label, ``A|B``, ``/regex/`` (found anywhere in the label), ``__``
    (any), ``@A`` (basic category). Relations: ``< > << >> <<< $ $+ $- $++ $--
    . , .. ,, <, <- <1 <-1 >1 >: <: <<: >>: <<, <<- >>, >>- <= ==``. All are
    comparisons of pre-order, post-order and span numbers.
    """

    _NODE = re.compile(r"/(?:[^/\\]|\\.)*/|@?[A-Za-z_0-9\-$.`']+(?:\|@?[A-Za-z_0-9\-$.`']+)*")
    _RELATION = re.compile(r"(?P<op><<<|<<:|>>:|<<,|<<-|>>,|>>-|<<|>>|<:|>:|<=|==|<-\d+|>-\d+|<\d+|>\d+|<,|<-|>,|>-|<|>|\$\+\+|\$--|\$\+|\$-|\$|\.\.|,,|\.|,)")

    def __init__(self, nodes: DataFrame):
        self.all_nodes = nodes

    def parse(self, pattern: str) -> Node:
        return _Reader(pattern, self._NODE, self._RELATION).pattern()

    def id(self, node: Column) -> Column:
        return node["pre"]

    def candidates(self, text: str, negated: bool, var: str) -> DataFrame:
        label = F.col("label")
        if text == "__":
            test = F.lit(True)
        elif text.startswith("/"):
            test = label.rlike(text[1:-1])
        else:
            basic = F.regexp_extract(label, r"^([^\-=|#^~_]*)", 1)
            test = reduce(lambda a, b: a | b, [(basic if p.startswith("@") else label) == p.lstrip("@") for p in text.split("|")])
        fields = F.struct("pre", "post", "parent", "child_ix", "n_children", "siblings", "lo", "hi")
        return self.all_nodes.where(~test if negated else test).select("graph", fields.alias(var))

    def relation(self, rel: Relation, var: str, other: str) -> tuple[None, Column]:
        a, b, op = F.col(var), F.col(other), rel.op
        inside = lambda x, y: (x["pre"] < y["pre"]) & (y["post"] < x["post"])
        sister = (a["parent"] == b["parent"]) & (a["pre"] != b["pre"])
        unary = (a["lo"] == b["lo"]) & (a["hi"] == b["hi"])
        table = {
            "<": b["parent"] == a["pre"],
            ">": a["parent"] == b["pre"],
            "<<": inside(a, b),
            ">>": inside(b, a),
            "<<<": inside(a, b) & (b["n_children"] == 0),
            "$": sister,
            "$+": sister & (b["child_ix"] == a["child_ix"] + 1),
            "$-": sister & (b["child_ix"] == a["child_ix"] - 1),
            "$++": sister & (b["child_ix"] > a["child_ix"]),
            "$--": sister & (b["child_ix"] < a["child_ix"]),
            ".": a["hi"] == b["lo"],
            ",": b["hi"] == a["lo"],
            "..": a["hi"] <= b["lo"],
            ",,": b["hi"] <= a["lo"],
            "<:": (b["parent"] == a["pre"]) & (a["n_children"] == 1),
            ">:": (a["parent"] == b["pre"]) & (b["n_children"] == 1),
            "<<:": inside(a, b) & unary,
            ">>:": inside(b, a) & unary,
            "<<,": inside(a, b) & (b["lo"] == a["lo"]),
            "<<-": inside(a, b) & (b["hi"] == a["hi"]),
            ">>,": inside(b, a) & (b["lo"] == a["lo"]),
            ">>-": inside(b, a) & (b["hi"] == a["hi"]),
            "<=": (b["parent"] == a["pre"]) | (a["pre"] == b["pre"]),
            "==": a["pre"] == b["pre"],
            "<,": (b["parent"] == a["pre"]) & (b["child_ix"] == 1),
            "<-": (b["parent"] == a["pre"]) & (b["child_ix"] == a["n_children"]),
            ">,": (a["parent"] == b["pre"]) & (a["child_ix"] == 1),
            ">-": (a["parent"] == b["pre"]) & (a["child_ix"] == b["n_children"]),
        }
        if op in table:
            return None, table[op]
        n = int(re.sub("[<>]", "", op))
        child, above = (b, a) if op[0] == "<" else (a, b)
        place = child["child_ix"] == n if n > 0 else child["child_ix"] == above["n_children"] + 1 + n
        return None, (child["parent"] == above["pre"]) & place


# ---------------------------------------------------------------- trees

NODE_SCHEMA = "graph string, pre int, post int, parent int, child_ix int, n_children int, siblings int, depth int, lo int, hi int, label string"


def parse_bracket(text: str) -> list[list]:
    """A bracketed tree as nested lists ``[label, child, ...]``."""
    stack: list[list] = [[]]
    for token in re.findall(r"\(|\)|[^\s()]+", text):
        if token == "(":
            stack.append([])
        elif token == ")":
            if len(stack) < 2:
                raise PatternError("unbalanced )")
            done = stack.pop()
            stack[-1].append(done if done and isinstance(done[0], str) else ["", *done])
        elif stack[-1] or len(stack) == 1:
            stack[-1].append([token])
        else:
            stack[-1].append(token)
    if len(stack) != 1:
        raise PatternError("unbalanced (")
    return stack[0]


def bracket(tree: list) -> str:
    return tree[0] if len(tree) == 1 else f"({tree[0]} {' '.join(map(bracket, tree[1:]))})" if tree[0] else f"({' '.join(map(bracket, tree[1:]))})"


def number_nodes(tree: list) -> list[tuple]:
    """Pre- and post-order, parent, place, spans over leaves, of every node."""
    rows: list[list] = []
    posts, leaves = count(), count()

    def visit(node: list, parent: int | None, ix: int, siblings: int, depth: int) -> tuple[int, int]:
        pre = len(rows)
        row = [pre, 0, parent, ix, len(node) - 1, siblings, depth, 0, 0, node[0]]
        rows.append(row)
        spans = [visit(c, pre, i, len(node) - 1, depth + 1) for i, c in enumerate(node[1:], 1)]
        if spans:
            lo, hi = spans[0][0], spans[-1][1]
        else:
            lo = next(leaves)
            hi = lo + 1
        row[1], row[7], row[8] = next(posts), lo, hi
        return lo, hi

    visit(tree, None, 1, 1, 0)
    return [tuple(r) for r in rows]


def tree_nodes(trees: DataFrame, id_column: str = "graph", text_column: str = "bracket") -> DataFrame:
    """Node table of bracketed trees; text that isn't one balanced tree gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for graph, text in zip(batch["graph"], batch["text"]):
                try:
                    found = parse_bracket(text or "")
                except PatternError:
                    continue
                if len(found) == 1:
                    rows.extend((graph, *r) for r in number_nodes(found[0]))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return trees.select(F.col(id_column).cast("string").alias("graph"), F.col(text_column).alias("text")).mapInPandas(run, NODE_SCHEMA)
