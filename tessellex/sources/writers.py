"""Documents and sentences as text: JSON, XML, inline XML, CoNLL-U, tables.

All are columns over nested rows, built in the JVM; write them with
``frame.write.text``. A sentence is an array of token structs in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.sources.conll import CONLLU


def escape_xml(text: Column) -> Column:
    """The five signs of XML as entities; signs XML can't hold are left out."""
    text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(sign), F.lit(f"&{name};"))
    return text


def json_line(frame: DataFrame, *columns: str) -> Column:
    """One JSON object of the columns in that order; nulls are left out."""
    return F.to_json(F.struct(*(F.col(c) for c in columns or frame.columns)))


def element(name: str, body: Column, **attributes: Column) -> Column:
    """``<name a="..">body</name>``; the body is XML already, null attributes are left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f' {k}="'), escape_xml(v.cast("string")), F.lit('"'))).otherwise(F.lit("")) for k, v in attributes.items()]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit(">"), F.coalesce(body, F.lit("")), F.lit(f"</{name}>"))


def xml_tokens(tokens: Column, *fields: str) -> Column:
    """A sentence's tokens as XML, numbered from 1; empty fields are left out."""

    def one(token: Column, i: Column) -> Column:
        cells = [F.when(token[f].isNotNull(), element(f, escape_xml(token[f].cast("string")))).otherwise(F.lit("")) for f in fields]
        return element("token", F.concat(*cells), id=(i + 1).cast("string"))

    return element("tokens", F.array_join(F.transform(tokens, one), ""))


def inline_xml(text: Column, spans: Column) -> Column:
    """Text with its spans (structs ``begin, end, label`` in code points, in
    order, not overlapping) as elements; a span that begins before the last
    one ended is left out."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        lead = F.substring(text, state["at"] + 1, span["begin"] - state["at"])
        inner = F.substring(text, span["begin"] + 1, span["end"] - span["begin"])
        marked = F.concat(state["out"], escape_xml(lead), F.lit("<"), span["label"], F.lit(">"), escape_xml(inner), F.lit("</"), span["label"], F.lit(">"))
        fits = (span["begin"] >= state["at"]) & (span["end"] > span["begin"]) & (span["end"] <= F.length(text))
        return F.when(fits, F.struct(span["end"].cast("int").alias("at"), marked.alias("out"))).otherwise(state)

    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], escape_xml(F.substring(text, s["at"] + 1, 1 << 30))))


def conllu_line(**cells: Column) -> Column:
    """The ten tab-separated fields; a map of features is written sorted, nulls and empty values as ``_``."""
    out = []
    for name in CONLLU:
        value = cells.get(name, F.lit(None).cast("string"))
        out.append(F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("_")))
    return F.concat_ws("\t", *out)


def feature_string(features: Column) -> Column:
    """``A=b|C=d`` of a map, by name without regard to case, then by name; null if there is none."""
    pairs = F.transform(F.map_entries(features), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("key"), e["value"].alias("value")))
    return F.nullif(F.array_join(F.transform(F.array_sort(pairs), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "|"), F.lit(""))


def conllu_order(ident: Column) -> Column:
    """Sorts ``3-4`` before ``3`` and ``3.1`` after it."""
    first = F.regexp_extract(ident, r"^(\d+)", 1).try_cast("int")
    inside = F.when(ident.contains("-"), F.lit(-1)).otherwise(F.coalesce(F.regexp_extract(ident, r"\.(\d+)$", 1).try_cast("int"), F.lit(0)))
    return F.struct(first.alias("first"), inside.alias("inside"))


def conllu_sentences(rows: DataFrame, group: list[str]) -> DataFrame:
    """``group.., block``: the lines of a sentence with its ``sent_id`` as a comment."""
    line = conllu_line(**{c: feature_string(F.col("feats")) if c == "feats" else F.col(c) for c in CONLLU})
    unit = F.struct(conllu_order(F.col("id")).alias("o"), line.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set(unit)), lambda u: u["line"]), "\n")
    return rows.groupBy(*group).agg(F.concat(F.lit("# sent_id = "), F.first("sent_id"), F.lit("\n"), body, F.lit("\n")).alias("block"))


def html_table(frame: DataFrame, group: list[str], order: str, *columns: str) -> DataFrame:
    """One HTML table of the columns per group."""
    row = F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), F.coalesce(escape_xml(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in columns), F.lit("</tr>"))
    head = "<table><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda x: x["r"])
    return frame.groupBy(*group).agg(F.concat(F.lit(head), F.array_join(cells, ""), F.lit("</table>")).alias("html"))


def graph_text(edges: DataFrame, group: list[str]) -> DataFrame:
    """``reln(gov, dep)`` lines of a graph's edges, by dependent; ``gov``, ``dep``, ``reln``."""
    line = F.concat("reln", F.lit("("), F.col("gov").cast("string"), F.lit(", "), F.col("dep").cast("string"), F.lit(")"))
    return edges.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep", "gov", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def graph_dot(edges: DataFrame, group: list[str]) -> DataFrame:
    """A graph in the dot language."""
    line = F.concat(F.lit("  N_"), F.col("gov").cast("string"), F.lit(" -> N_"), F.col("dep").cast("string"), F.lit(' [label="'), F.col("reln"), F.lit('"];'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dep", "gov", line.alias("l")))), lambda x: x["l"]), "\n")
    return edges.groupBy(*group).agg(F.concat(F.lit("digraph {\n"), body, F.lit("\n}")).alias("dot"))
