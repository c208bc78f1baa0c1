"""Token-sequence patterns: parser, matcher, and selection among many rules.

``[{tag:/NN.*/; ner:PERSON} | !{lemma:be}]{1,3} (?$v /the/ []*?) \\1``: nodes
test token attributes, strings and regexes test the word; groups, names,
greedy and reluctant quantifiers, alternation, conjunction ``&`` over one
span, anchors and back references. Sentences are rows; rules run over Arrow
batches of whole sentences, candidates are found by a trigger word first.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Token = dict
#: A matcher takes (tokens, position, groups, next) and calls next(position, groups).
Matcher = Callable[[list, int, dict, Callable[[int, dict], bool]], bool]


class SequenceError(ValueError):
    pass


def _attribute(name: str, op: str, value: str, insensitive: bool) -> Callable[[Token], bool]:
    if op in (">=", "<=", ">", "<", "=="):
        bound = float(value)

        def number(token: Token) -> bool:
            try:
                x = float(token.get(name))
            except (TypeError, ValueError):
                return False
            return {">=": x >= bound, "<=": x <= bound, ">": x > bound, "<": x < bound, "==": x == bound}[op]

        return number
    if value in ("IS_NIL", "NOT_EXISTS"):
        return lambda t: t.get(name) in (None, "")
    if value in ("NOT_NIL", "EXISTS"):
        return lambda t: t.get(name) not in (None, "")
    if value == "IS_NUM":
        return lambda t: re.fullmatch(r"[-+]?\d+(?:\.\d+)?", str(t.get(name) or "")) is not None
    if value.startswith("/"):
        found = re.compile(value[1:-1], re.I if insensitive else 0)
        return lambda t: t.get(name) is not None and found.fullmatch(str(t[name])) is not None
    plain = value[1:-1] if value[:1] == '"' else value
    if insensitive:
        return lambda t: t.get(name) is not None and str(t[name]).lower() == plain.lower()
    return lambda t: t.get(name) is not None and str(t[name]) == plain


class _Parser:
    """Recursive descent; every construct becomes a continuation matcher."""

    _WORD = re.compile(r'"(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)*/')
    _TEST = re.compile(r'\s*([\w.]+)\s*(!)?\s*(:|>=|<=|==|>|<)\s*("(?:[^"\\]|\\.)*"|/(?:[^/\\]|\\.)*/|[^\s;,}]+)\s*')

    def __init__(self, text: str, insensitive: bool, macros: dict[str, str]):
        for name, body in macros.items():
            text = re.sub(rf"\${re.escape(name)}\b", lambda m, body=body: f"(?: {body} )", text)
        self.text, self.at, self.insensitive, self.groups = text, 0, insensitive, 0
        self.names: list[str] = []

    def space(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def take(self, what: str) -> bool:
        self.space()
        if self.text.startswith(what, self.at):
            self.at += len(what)
            return True
        return False

    def all(self) -> Matcher:
        m = self.alternatives()
        self.space()
        if self.at < len(self.text):
            raise SequenceError(f"unexpected {self.text[self.at:]!r}")
        return m

    def alternatives(self) -> Matcher:
        parts = [self.both()]
        while self.take("|"):
            parts.append(self.both())
        if len(parts) == 1:
            return parts[0]

        def either(ts, i, g, k):  # no generator: it would use up the interpreter's own stack
            for p in parts:
                if p(ts, i, g, k):
                    return True
            return False

        return either

    def both(self) -> Matcher:
        parts = [self.row()]
        while self.take("&"):
            parts.append(self.row())
        if len(parts) == 1:
            return parts[0]

        def conj(ts, i, g, k):
            def rest(n):
                return lambda j, h: k(j, h) if n == len(parts) else parts[n](ts, i, h, lambda j2, h2: j2 == j and rest(n + 1)(j, h2))

            return parts[0](ts, i, g, rest(1))

        return conj

    def row(self) -> Matcher:
        items = []
        while True:
            self.space()
            if self.at >= len(self.text) or self.text[self.at] in ")|&":
                break
            items.append(self.quantified())
        if not items:
            raise SequenceError("empty pattern")

        def seq(ts, i, g, k, n=0):
            if n == len(items):
                return k(i, g)
            return items[n](ts, i, g, lambda j, h: seq(ts, j, h, k, n + 1))

        return seq

    def quantified(self) -> Matcher:
        m = self.atom()
        found = re.compile(r"(\*|\+|\?|\{(\d+)(,(\d*))?\})(\?)?").match(self.text, self.at)
        if not found:
            return m
        self.at = found.end()
        low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(found[1], (None, None))
        if low is None:
            low = int(found[2])
            high = low if found[3] is None else int(found[4]) if found[4] else None
        lazy = found[5] is not None
        test = getattr(m, "single", None)
        if test is not None:  # one token a time: counted, not recursed

            def run(ts, i, g, k):
                end = len(ts) if high is None else min(len(ts), i + high)
                j = i
                while j < end and test(ts[j]):
                    j += 1
                stops = range(i + low, j + 1) if lazy else range(j, i + low - 1, -1)
                for stop in stops:
                    if k(stop, g):
                        return True
                return False

            return run

        def loop(ts, i, g, k, n=0):
            def more():
                return (high is None or n < high) and m(ts, i, g, lambda j, h: (j > i or n < low) and loop(ts, j, h, k, n + 1))

            done = lambda: n >= low and k(i, g)
            return (done() or more()) if lazy else (more() or done())

        return loop

    def atom(self) -> Matcher:
        if self.take("^"):
            return lambda ts, i, g, k: i == 0 and k(i, g)
        if self.take("(?:"):
            return self.closed(None)
        if self.take("(?$"):
            name = re.compile(r"\w+").match(self.text, self.at)
            self.at = name.end()
            self.names.append(name[0])
            return self.closed(name[0])
        if self.take("("):
            return self.closed(True)
        if self.take("["):
            test = self.node_or()
            if not self.take("]"):
                raise SequenceError("missing ]")
            return self.one(test)
        found = re.compile(r"\\(\d+)").match(self.text, self.at)
        if found:
            self.at = found.end()
            n = int(found[1])

            def back(ts, i, g, k):
                a, b = g.get(n, (0, 0))
                same = [t.get("word") for t in ts[a:b]] == [t.get("word") for t in ts[i : i + b - a]]
                return same and k(i + b - a, g)

            return back
        word = self._WORD.match(self.text, self.at)
        if word:
            self.at = word.end()
            return self.one(_attribute("word", ":", word[0], self.insensitive))
        if self.take("$"):
            return lambda ts, i, g, k: i == len(ts) and k(i, g)
        bare = re.compile(r"[^\s()\[\]{}|&*+?^$/\\]+").match(self.text, self.at)
        if bare:
            self.at = bare.end()
            return self.one(_attribute("word", ":", bare[0], self.insensitive))
        raise SequenceError(f"unexpected {self.text[self.at:]!r}")

    def closed(self, group) -> Matcher:
        if group is not None:
            self.groups += 1
        n = self.groups
        inner = self.alternatives()
        if not self.take(")"):
            raise SequenceError("missing )")
        if group is None:
            return inner

        def grouped(ts, i, g, k):
            return inner(ts, i, g, lambda j, h: k(j, h | {n: (i, j)} | ({group: (i, j)} if group is not True else {})))

        return grouped

    @staticmethod
    def one(test) -> Matcher:
        def step(ts, i, g, k):
            return i < len(ts) and test(ts[i]) and k(i + 1, g)

        step.single = test
        return step

    def node_or(self):
        parts = [self.node_and()]
        while self.take("|"):
            parts.append(self.node_and())
        return parts[0] if len(parts) == 1 else lambda t: any(p(t) for p in parts)

    def node_and(self):
        parts = [self.node_one()]
        while self.take("&"):
            parts.append(self.node_one())
        return parts[0] if len(parts) == 1 else lambda t: all(p(t) for p in parts)

    def node_one(self):
        if self.take("!"):
            inner = self.node_one()
            return lambda t: not inner(t)
        if self.take("("):
            inner = self.node_or()
            if not self.take(")"):
                raise SequenceError("missing )")
            return inner
        self.space()
        if self.text.startswith("]", self.at):
            return lambda t: True
        if self.take("{"):
            tests = []
            while not self.take("}"):
                found = self._TEST.match(self.text, self.at)
                if not found:
                    raise SequenceError(f"test expected at {self.text[self.at:]!r}")
                self.at = found.end()
                test = _attribute(found[1], found[3], found[4], self.insensitive)
                tests.append((lambda t, f=test: not f(t)) if found[2] else test)
                self.take(";") or self.take(",")
            return lambda t: all(f(t) for f in tests)
        word = self._WORD.match(self.text, self.at)
        if word:
            self.at = word.end()
            return _attribute("word", ":", word[0], self.insensitive)
        raise SequenceError(f"node expected at {self.text[self.at:]!r}")


class SequencePattern:
    """A compiled pattern."""

    def __init__(self, text: str, insensitive: bool = False, macros: dict[str, str] | None = None):
        parser = _Parser(text, insensitive, macros or {})
        self.text, self._match = text, parser.all()
        self.names = tuple(parser.names)

    def at(self, tokens: list[Token], start: int) -> tuple[int, dict] | None:
        """End and groups of the match that begins at a token."""
        found: list = []
        # a repeated group goes a few calls deeper for every token it takes
        limit = sys.getrecursionlimit()
        needed = 1000 + 40 * (len(tokens) - start)
        if needed > limit:
            sys.setrecursionlimit(needed)
        try:
            self._match(tokens, start, {}, lambda j, g: found.append((j, g)) or True)
        finally:
            sys.setrecursionlimit(limit)
        return found[0] if found else None

    def find(self, tokens: list[Token], overlapping: bool = False) -> list[tuple[int, int, dict]]:
        out, i = [], 0
        while i <= len(tokens):
            hit = self.at(tokens, i)
            if hit and hit[0] > i:
                out.append((i, hit[0], hit[1]))
                i = i + 1 if overlapping else hit[0]
            else:
                i += 1
        return out

    def matches(self, tokens: list[Token]) -> bool:
        return bool(self._match(tokens, 0, {}, lambda j, g: j == len(tokens)))


@dataclass
class Rule:
    """A pattern and what a match says; ``trigger`` is a word it can't do without."""

    name: str
    pattern: str
    priority: float = 0.0
    weight: float = 0.0
    result: str | None = None
    trigger: str | None = None
    stage: int = 1
    macros: dict[str, str] = field(default_factory=dict)


def select_matches(matches: list[tuple]) -> list[tuple]:
    """Greedy by priority, length, start, rule order; none overlaps a kept one.

    A match is (rule number, priority, begin, end, ...).
    """
    kept: list[tuple] = []
    for m in sorted(matches, key=lambda m: (-m[1], -(m[3] - m[2]), m[2], m[0])):
        if all(m[3] <= k[2] or m[2] >= k[3] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def best_scoring(matches: list[tuple]) -> list[tuple]:
    """Non-overlapping matches of greatest total priority (weighted scheduling)."""
    order = sorted(matches, key=lambda m: (m[3], m[2], m[0]))
    best: list[tuple[float, list]] = [(0.0, [])]
    ends = [m[3] for m in order]
    for i, m in enumerate(order):
        k = i
        while k > 0 and ends[k - 1] > m[2]:
            k -= 1
        take = (best[k][0] + m[1], best[k][1] + [m])
        best.append(max(best[i], take, key=lambda x: x[0]))
    return best[-1][1]


MATCH_SCHEMA = "sentence_key string, rule string, begin_token int, end_token int, text string, result string, groups map<string,string>"


def match_rules(sentences: DataFrame, rules: list[Rule], key: str = "sentence_key", tokens: str = "tokens", select: Callable[[list], list] | None = select_matches) -> DataFrame:
    """Matches of many rules in sentences (``key``, array of token structs).

    ``select`` resolves overlaps (None keeps all). Stages run in order; a
    match writes its result to the ``ner`` attribute later stages see. Null
    token arrays and empty sentences match nothing.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(n, r, SequencePattern(r.pattern, macros=r.macros)) for n, r in enumerate(rules)]
        for batch in batches:
            rows = []
            for sentence, array in zip(batch["key"], batch["tokens"]):
                ts = [dict(t) for t in array] if array is not None else []
                words = {t.get("word") for t in ts}
                for stage in sorted({r.stage for r in rules}):
                    hits = [(n, r.priority, a, b, g, r) for n, r, p in compiled if r.stage == stage and (r.trigger is None or r.trigger in words) for a, b, g in p.find(ts, select is None)]
                    for _, _, a, b, g, r in select(hits) if select else hits:
                        text = lambda i, j: " ".join(str(t.get("word")) for t in ts[i:j])
                        rows.append((sentence, r.name, a, b, text(a, b), r.result, {str(k): text(*v) for k, v in g.items()}))
                        if r.result is not None:
                            for t in ts[a:b]:
                                t["ner"] = r.result
            yield pd.DataFrame(rows, columns=["sentence_key", "rule", "begin_token", "end_token", "text", "result", "groups"], dtype=object)

    return sentences.select(F.col(key).cast("string").alias("key"), F.col(tokens).alias("tokens")).mapInPandas(run, MATCH_SCHEMA)
