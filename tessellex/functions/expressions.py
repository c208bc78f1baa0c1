"""Expressions of rules, compiled to native columns.

``compile_expression('Concat(Uppercase(form), "/", Select(feats, "Case"))')``
gives a column. There are numbers, strings in double quotes, ``/regexes/``,
names of columns, lists ``[a, b]``, ``x[i]`` (from 0), calls ``F(a, b)``,
method calls ``x.F(b)`` and ``if(test, a, b)`` / ``case(test, a, test, b, else)``.
Tags are kept in a map from strings to strings; null where one is missing.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(?P<number>-?\d+(?:\.\d+)?)|"(?P<string>(?:[^"\\]|\\.)*)"|/(?P<regex>(?:[^/\\]|\\.)*)/|(?P<name>[A-Za-z_$]\w*)|(?P<sign>[\[\](),.]))')


def _fold(step: Callable[[Column, Column], Column]) -> Callable[..., Column]:
    return lambda *a: reduce(step, a)


def _untag(tags: Column, name: Column) -> Column:
    return F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != name)


def _tag(tags: Column, name: Column, value: Column) -> Column:
    return F.map_concat(_untag(tags, name), F.create_map(name, value.cast("string")))


def _text(value: object) -> str:
    if not isinstance(value, str):
        raise ValueError("a constant string is needed here")
    return value


def create_regex(words: list[str]) -> str:
    """One pattern for any of the words, longest first."""
    return "(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + ")"


#: Functions of columns, by name.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "Add": _fold(lambda a, b: a + b),
    "Subtract": lambda a, b: a - b,
    "Multiply": _fold(lambda a, b: a * b),
    "Divide": lambda a, b: a / F.nullif(b, F.lit(0)),
    "Mod": lambda a, b: a % F.nullif(b, F.lit(0)),
    "Min": lambda *a: F.least(*a) if len(a) > 1 else F.array_min(a[0]),
    "Max": lambda *a: F.greatest(*a) if len(a) > 1 else F.array_max(a[0]),
    "Pow": lambda a, b: F.pow(a, b),
    "Negate": lambda a: -a,
    "And": _fold(lambda a, b: a & b),
    "Or": _fold(lambda a, b: a | b),
    "Not": lambda a: ~a,
    "Concat": lambda *a: F.concat(*a),
    "Join": lambda glue, *a: F.concat_ws(_text(glue), *a),
    "Lowercase": lambda a: F.lower(a),
    "Uppercase": lambda a: F.upper(a),
    "Match": lambda text, pattern: text.rlike(f"^(?:{_text(pattern)})$"),
    "Replace": lambda text, pattern, new: F.regexp_replace(text, _text(pattern), _text(new)),
    "Split": lambda text, pattern: F.split(text, _text(pattern)),
    "GE": lambda a, b: a >= b,
    "GT": lambda a, b: a > b,
    "LE": lambda a, b: a <= b,
    "LT": lambda a, b: a < b,
    "EQ": lambda a, b: a.eqNullSafe(b),
    "NE": lambda a, b: ~a.eqNullSafe(b),
    "VTag": _tag,
    "GetVTag": lambda tags, name: F.try_element_at(tags, name),
    "RemoveVTag": _untag,
    "Tag": _tag,
    "GetTag": lambda tags, name: F.try_element_at(tags, name),
    "RemoveTag": _untag,
    "Annotate": _tag,
    "Select": lambda value, name: F.try_element_at(value, name),
    "ListSelect": lambda items, at: F.get(items, at.cast("int")),
    "Keys": lambda value: F.array_sort(F.map_keys(value)),
    "Set": _tag,
    "Get": lambda value, name: F.try_element_at(value, name),
    "Print": lambda a: a,
}
#: Functions that take text constants as they stand.
_CONSTANTS = {"Join": {0}, "Match": {1}, "Replace": {1, 2}, "Split": {1}, "Format": {0}, "Map": {1}, "Aggregate": {1}, "Call": {0}}


def apply(name: str, args: list) -> Column:
    """A function by name; ``Map``, ``Aggregate`` and ``Call`` take another one's name."""
    kept = _CONSTANTS.get(name, set())
    cells = [a if isinstance(a, Column) or i in kept else F.lit(a) for i, a in enumerate(args)]
    if name == "Format":
        return F.format_string(_text(cells[0]), *(F.lit(c) if not isinstance(c, Column) else c for c in cells[1:]))
    if name == "Map":
        return F.transform(cells[0], lambda x: apply(_text(cells[1]), [x, *args[2:]]))
    if name == "Aggregate":
        return F.aggregate(cells[0], cells[2], lambda s, x: apply(_text(cells[1]), [s, x]))
    if name == "Call":
        return apply(_text(cells[0]), args[1:])
    if name not in FUNCTIONS:
        raise ValueError(f"unknown function {name}")
    return FUNCTIONS[name](*cells)


def compile_expression(text: str, variables: dict[str, Column | str | list[str]] | None = None) -> Column:
    """The column of an expression; ``variables`` stand before columns of that name.

    ``CreateRegex(words)`` takes a variable or list of constant words.
    """
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"can't read {text[at:at + 20]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    known, place = variables or {}, 0

    def peek() -> tuple[str | None, str]:
        return tokens[place] if place < len(tokens) else (None, "")

    def take(sign: str | None = None) -> tuple[str, str]:
        nonlocal place
        token = peek()
        if token[0] is None or sign and token != ("sign", sign):
            raise ValueError(f"{sign or 'more'} expected in {text!r}")
        place += 1
        return token

    def arguments(close: str) -> list:
        out = []
        while peek() != ("sign", close):
            out.append(value())
            if peek() == ("sign", ","):
                take(",")
        take(close)
        return out

    def call(name: str, args: list):
        if name == "CreateRegex":
            return create_regex(args[0] if isinstance(args[0], list) else args)
        if name == "if":
            return F.when(args[0], args[1]).otherwise(args[2])
        if name == "case":
            out = F
            for test, result in zip(args[:-1:2], args[1::2]):
                out = out.when(test, result)
            return out.otherwise(args[-1]) if len(args) % 2 else out
        return apply(name, [F.array(*(F.lit(x) for x in a)) if isinstance(a, list) else a for a in args])

    def value():
        kind, got = take()
        if kind == "number":
            out = F.lit(float(got) if "." in got else int(got))
        elif kind == "string":
            out = re.sub(r"\\(.)", r"\1", got)
        elif kind == "regex":
            out = got.replace("\\/", "/")
        elif kind == "name":
            if peek() == ("sign", "("):
                take("(")
                out = call(got, arguments(")"))
            else:
                name = got.lstrip("$")
                out = {"true": F.lit(True), "false": F.lit(False), "nil": F.lit(None)}.get(name, known.get(name, F.col(name)))
        elif got == "[":
            items = arguments("]")
            out = items if all(isinstance(i, str) for i in items) else F.array(*(F.lit(i) if not isinstance(i, Column) else i for i in items))
        else:
            raise ValueError(f"unexpected {got!r} in {text!r}")
        while peek() in (("sign", "["), ("sign", ".")):
            if take()[1] == "[":
                own = F.array(*(F.lit(x) for x in out)) if isinstance(out, list) else out
                out = apply("ListSelect", [own, value()])
                take("]")
            else:
                name = take()[1]
                take("(")
                out = call(name, [out, *arguments(")")])
        return out

    result = value()
    if place < len(tokens):
        raise ValueError(f"{text!r} goes on after its end")
    if isinstance(result, list):
        return F.array(*(F.lit(x) for x in result))
    return result if isinstance(result, Column) else F.lit(result)
