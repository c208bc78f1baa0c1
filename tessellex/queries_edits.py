"""Queries of graph edits, expressions, chunks, scores and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.functions.expressions import compile_expression as E
from tessellex.operators import chunks as K
from tessellex.operators import graph_edits as D
from tessellex.queries import query
from tessellex.queries_patterns import GRAPH, graphs
from tessellex.session import table
from tessellex.sources import writers as W

# ---------------------------------------------------------------- graph edits


def graph(spark: SparkSession, folder: str) -> D.Graph:
    found = graphs(spark, folder)
    return D.Graph(found.all_nodes, found.edges)


def edit(name: str, pattern: str, run, sql: str) -> None:
    """An edit at all places of a pattern; its nodes or edges are the result."""

    def go(spark: SparkSession, folder: str) -> DataFrame:
        g = graph(spark, folder)
        return run(g, g.find(pattern).withColumnRenamed("node", "_node"))

    query(f"graph_edit_{name}", f"WITH {GRAPH} " + sql)(go)


IS = "EXISTS (SELECT 1 FROM n WHERE n.graph = e.graph AND n.idx = e.{0}{1})"
VERB_ABOVE = IS.format("gov", " AND n.upos = 'VERB'") + " AND " + IS.format("dep", "")
edit("remove_edge", "{upos:VERB}=v >punct {}=p", lambda g, at: D.remove_edge(g, at, "v", "p", "punct").edges, f"SELECT * FROM e WHERE NOT (reln = 'punct' AND {VERB_ABOVE})")
edit("relabel_edge", "{upos:VERB}=v >obj {}=o", lambda g, at: D.relabel_edge(g, at, "v", "o", "dobj", "obj").edges, f"SELECT DISTINCT graph, gov, dep, CASE WHEN reln = 'obj' AND {VERB_ABOVE} THEN 'dobj' ELSE reln END AS reln FROM e")
edit("add_edge", "{upos:VERB}=v >nsubj {}=s", lambda g, at: D.add_edge(g, at, "s", "v", "subject_of").edges, f"SELECT * FROM e UNION ALL SELECT DISTINCT graph, dep AS gov, gov AS dep, 'subject_of' AS reln FROM e WHERE reln = 'nsubj' AND {VERB_ABOVE}")
edit("kill_incoming", "{upos:PUNCT}=p", lambda g, at: D.kill_incoming(g, at, "p").edges, "SELECT * FROM e WHERE NOT " + IS.format("dep", " AND n.upos = 'PUNCT'"))
edit("delete_leaf", "{upos:PUNCT}=p", lambda g, at: D.delete_leaf(g, at, "p").nodes, "SELECT * FROM n WHERE (graph, idx) NOT IN (SELECT (graph, idx) FROM n WHERE upos = 'PUNCT' AND (graph, idx) NOT IN (SELECT (graph, gov) FROM e))")
edit("node", "{upos:NUM}=x", lambda g, at: D.edit_node(g, at, "x", upos="NUMBER").nodes, "SELECT graph, idx, form, CASE WHEN (graph, idx) IN (SELECT (graph, idx) FROM n WHERE upos = 'NUM') THEN 'NUMBER' ELSE upos END AS upos FROM n")
query("graph_roots", f"WITH {GRAPH} SELECT DISTINCT graph, idx FROM n WHERE (graph, idx) NOT IN (SELECT (graph, dep) FROM e)")(lambda s, f: graph(s, f).root_nodes().distinct())


@query("graph_edit_delete_below", f"WITH RECURSIVE {GRAPH}, d(graph, idx) AS (SELECT graph, idx FROM n WHERE upos = 'NOUN' UNION SELECT e.graph, e.dep FROM d JOIN e ON e.graph = d.graph AND e.gov = d.idx) SELECT * FROM n WHERE (graph, idx) NOT IN (SELECT (graph, idx) FROM d)")
def graph_edit_delete_below(spark: SparkSession, folder: str) -> DataFrame:
    g = graph(spark, folder)
    return D.delete_below(g, g.find("{upos:NOUN}=x"), "x").nodes


@query("graph_text", f"WITH {GRAPH} SELECT graph, string_agg(reln || '(' || gov || ', ' || dep || ')', chr(10) ORDER BY dep, gov, reln) AS text FROM e WHERE reln IS NOT NULL GROUP BY 1")
def graph_text(spark: SparkSession, folder: str) -> DataFrame:
    return W.graph_text(graph(spark, folder).edges.where("reln is not null"), ["graph"])


# ---------------------------------------------------------------- expressions


def expressions(name: str, source: str, key: str, cells: dict[str, str], sql: dict[str, str]) -> None:
    def go(spark: SparkSession, folder: str) -> DataFrame:
        return table(spark, folder, source).select(key, *(E(text).alias(n) for n, text in cells.items()))

    query(name, f"SELECT {key}, " + ", ".join(f"{text} AS {n}" for n, text in sql.items()) + f" FROM {source}")(go)


expressions(
    "expr_numbers",
    "lineitem",
    "l_orderkey",
    {"sums": "Add(l_linenumber, l_orderkey, 2)", "less": "Subtract(l_orderkey, l_linenumber)", "times": "Multiply(l_linenumber, 3)", "parts": "Divide(l_orderkey, 4.0)", "rest": "Mod(l_orderkey, 7)", "least_one": "Min(l_linenumber, 3)", "greatest_one": "Max(l_linenumber, 3)", "squared": "Pow(l_linenumber, 2)", "negative": "Negate(l_linenumber)"},
    {"sums": "l_linenumber + l_orderkey + 2", "less": "l_orderkey - l_linenumber", "times": "l_linenumber * 3", "parts": "l_orderkey / 4.0::DOUBLE", "rest": "l_orderkey % 7", "least_one": "least(l_linenumber, 3)", "greatest_one": "greatest(l_linenumber, 3)", "squared": "pow(l_linenumber, 2)", "negative": "-l_linenumber"},
)
expressions(
    "expr_logic",
    "lineitem",
    "l_orderkey",
    {"two": 'And(GE(l_linenumber, 3), EQ(l_returnflag, "A"))', "any_one": 'Or(LT(l_linenumber, 2), GT(l_linenumber, 5))', "none": 'Not(LE(l_linenumber, 4))', "other": 'NE(l_linestatus, "O")', "chosen": 'if(GT(l_linenumber, 3), "late", "early")', "stepped": 'case(EQ(l_linenumber, 1), "one", EQ(l_linenumber, 2), "two", "more")'},
    {"two": "l_linenumber >= 3 AND l_returnflag = 'A'", "any_one": "l_linenumber < 2 OR l_linenumber > 5", "none": "NOT l_linenumber <= 4", "other": "l_linestatus <> 'O'", "chosen": "CASE WHEN l_linenumber > 3 THEN 'late' ELSE 'early' END", "stepped": "CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'more' END"},
)
expressions(
    "expr_strings",
    "part",
    "p_partkey",
    {"both": 'Concat(p_brand, "/", p_type)', "joined": 'Join("-", p_brand, p_name)', "low": "Lowercase(p_brand)", "high": "p_name.Uppercase()", "brand_like": "Match(p_brand, /Brand.*/)", "changed": 'Replace(p_name, /[aeiou]+/, "*")', "first_word": 'Split(p_name, / /)[0]', "shown": 'Format("%s:%d", p_brand, p_size)', "listed": 'Match(p_brand, CreateRegex(["Brand#12", "Brand#1", "Brand#2"]))', "called": 'Call("Lowercase", p_type)', "seen": "Print(p_name)"},
    {"both": "p_brand || '/' || p_type", "joined": "p_brand || '-' || p_name", "low": "lower(p_brand)", "high": "upper(p_name)", "brand_like": "regexp_full_match(p_brand, 'Brand.*')", "changed": "regexp_replace(p_name, '[aeiou]+', '*', 'g')", "first_word": "split_part(p_name, ' ', 1)", "shown": "p_brand || ':' || p_size", "listed": "p_brand IN ('Brand#12', 'Brand#1', 'Brand#2')", "called": "lower(p_type)", "seen": "p_name"},
)
FEATS = "WITH t AS (SELECT DISTINCT doc_id, sent_id, id, feats::VARCHAR AS shown, feats FROM conllu_tokens WHERE feats IS NOT NULL) "


@query("expr_maps", FEATS + "SELECT doc_id, sent_id, id, feats['Number'] AS number_of, array_to_string(list_sort(map_keys(feats)), ',') AS names, len(map_keys(feats)) + CASE WHEN feats['Seen'] IS NULL THEN 1 ELSE 0 END AS tagged, len(map_keys(feats)) - CASE WHEN feats['Number'] IS NULL THEN 0 ELSE 1 END AS untagged, 'yes' AS tag, list_sort(map_keys(feats))[1] AS first_name, upper(array_to_string(list_sort(map_keys(feats)), '+')) AS upper_names FROM t")
def expr_maps(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "feats").where("feats is not null")
    return rows.select(
        "doc_id",
        "sent_id",
        "id",
        E('Select(feats, "Number")').alias("number_of"),
        E('Join(",", Keys(feats))').alias("names"),
        F.size(E('Tag(feats, "Seen", "yes")')).cast("bigint").alias("tagged"),
        F.size(E('RemoveTag(feats, "Number")')).cast("bigint").alias("untagged"),
        E('GetTag(Annotate(feats, "Seen", "yes"), "Seen")').alias("tag"),
        E("ListSelect(Keys(feats), 0)").alias("first_name"),
        E('Join("+", Map(Keys(feats), "Uppercase"))').alias("upper_names"),
    ).distinct()


# ---------------------------------------------------------------- chunks and scores

CHUNKS = "k AS (SELECT graph, idx, min(form) AS form, CASE WHEN min(upos) IN ('NOUN', 'PROPN', 'ADJ') THEN 'I-N' WHEN min(upos) IN ('VERB', 'AUX') THEN 'I-V' ELSE 'O' END AS label FROM n GROUP BY 1, 2)"
EDGES = "s AS (SELECT *, label <> 'O' AND label IS DISTINCT FROM lag(label) OVER (PARTITION BY graph ORDER BY idx) AS b, label <> 'O' AND label IS DISTINCT FROM lead(label) OVER (PARTITION BY graph ORDER BY idx) AS l FROM k)"


def chunk_tokens(spark: SparkSession, folder: str) -> DataFrame:
    upos = F.min("upos")
    label = F.when(upos.isin("NOUN", "PROPN", "ADJ"), "I-N").when(upos.isin("VERB", "AUX"), "I-V").otherwise("O")
    return graph(spark, folder).nodes.groupBy("graph", "idx").agg(F.min("form").alias("form"), label.alias("label"))


for _scheme, _case in {
    "iob2": "CASE WHEN label = 'O' THEN 'O' WHEN b THEN 'B' || substr(label, 2) ELSE label END",
    "bilou": "CASE WHEN label = 'O' THEN 'O' WHEN b AND l THEN 'U' || substr(label, 2) WHEN b THEN 'B' || substr(label, 2) WHEN l THEN 'L' || substr(label, 2) ELSE label END",
    "ioe2": "CASE WHEN label = 'O' THEN 'O' WHEN l THEN 'E' || substr(label, 2) ELSE label END",
}.items():
    query(f"labels_{_scheme}", f"WITH {GRAPH}, {CHUNKS}, {EDGES} SELECT graph, idx, {_case} AS converted FROM s")(lambda s, f, scheme=_scheme: K.convert_labels(chunk_tokens(s, f), ["graph"], "idx", "label", scheme).select("graph", "idx", "converted"))

SPANS = f"{CHUNKS}, {EDGES}, g AS (SELECT *, sum(b::INTEGER) OVER (PARTITION BY graph ORDER BY idx) AS c FROM s)"


@query("labelled_spans", f'WITH {GRAPH}, {SPANS} SELECT graph, substr(label, 3) AS type, min(idx)::INTEGER AS begin, (max(idx) + 1)::INTEGER AS "end" FROM g WHERE label <> \'O\' GROUP BY graph, c, label')
def labelled_spans(spark: SparkSession, folder: str) -> DataFrame:
    return K.labelled_spans(chunk_tokens(spark, folder), ["graph"], "idx", "label")


@query("aggregate_chunks", f"WITH {GRAPH}, {CHUNKS} SELECT graph, arg_min(form, idx) AS first_form, arg_max(form, idx) AS last_form, count(form) AS forms, min(idx) AS least, max(idx) AS most, sum(idx)::BIGINT AS total, string_agg(form, ' ' ORDER BY idx) AS text FROM k WHERE form IS NOT NULL GROUP BY 1")
def aggregate_chunks(spark: SparkSession, folder: str) -> DataFrame:
    how = {"first_form": ("form", "FIRST_NON_NIL"), "last_form": ("form", "LAST_NON_NIL"), "forms": ("form", "COUNT"), "least": ("idx", "MIN"), "most": ("idx", "MAX"), "total": ("idx", "SUM"), "text": ("form", "CONCAT_TEXT")}
    return K.aggregate_chunks(chunk_tokens(spark, folder).where("form is not null"), ["graph"], "idx", how)


SCORED = "r AS (SELECT o_orderkey, o_orderstatus AS gold, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS guess FROM orders)"


def scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    return rows.select("o_orderkey", F.col("o_orderstatus").alias("gold"), F.when(F.col("o_orderkey") % 5 == 0, "F").otherwise(F.col("o_orderstatus")).alias("guess"))


@query("class_scores", f"WITH {SCORED}, l AS (SELECT DISTINCT gold AS label FROM r UNION SELECT guess FROM r), c AS (SELECT label, count(*) FILTER (gold = label AND guess = label) AS tp, count(*) FILTER (gold <> label AND guess = label) AS fp, count(*) FILTER (gold = label AND guess <> label) AS fn FROM l, r GROUP BY 1) SELECT label, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def class_scores(spark: SparkSession, folder: str) -> DataFrame:
    out = K.class_scores(scored(spark, folder), "gold", "guess")
    return out.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("accuracy", f"WITH {SCORED} SELECT round(avg((gold = guess)::INTEGER), 6) AS accuracy, count(*) AS n FROM r")
def accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return K.accuracy(scored(spark, folder), "gold", "guess").select(F.round("accuracy", 6).alias("accuracy"), "n")


@query("precision_recall_curve", "WITH c AS (SELECT round(c_acctbal / 500)::BIGINT AS score, c_mktsegment = 'BUILDING' AS k FROM customer), p AS (SELECT score, count(*) AS n, count(*) FILTER (k) AS k FROM c GROUP BY 1), s AS (SELECT score, (sum(n) OVER (ORDER BY score DESC))::BIGINT AS found, (sum(k) OVER (ORDER BY score DESC))::BIGINT AS hits FROM p) SELECT score, found, hits, round(hits / found, 6) AS precision, round(hits / (SELECT sum(k) FROM p), 6) AS recall FROM s")
def precision_recall_curve(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer", "c_acctbal", "c_mktsegment").select(F.round(F.col("c_acctbal") / 500).cast("bigint").alias("score"), (F.col("c_mktsegment") == "BUILDING").alias("k"))
    return K.precision_recall_curve(rows, "score", "k").select("score", "found", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("information_gain", "WITH c AS (SELECT o_orderpriority AS f, o_orderstatus AS l, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2), f AS (SELECT f, sum(c) AS nf FROM c GROUP BY 1), l AS (SELECT l, sum(c) AS nl FROM c GROUP BY 1), g AS (SELECT f.f, nf, nl, coalesce(c.c, 0) AS c, (SELECT sum(c) FROM c) AS n FROM f CROSS JOIN l LEFT JOIN c ON c.f = f.f AND c.l = l.l) SELECT f AS feature, round(sum(CASE WHEN c > 0 THEN c / n * log2(c * n / (nl * nf)) ELSE 0 END + CASE WHEN nl > c THEN (nl - c) / n * log2((nl - c) * n / (nl * (n - nf))) ELSE 0 END), 6) AS gain FROM g GROUP BY 1")
def information_gain(spark: SparkSession, folder: str) -> DataFrame:
    out = K.information_gain(table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderpriority", "o_orderstatus", "o_orderkey")
    return out.select("feature", F.round("gain", 6).alias("gain"))


# ---------------------------------------------------------------- writers


@query("json_lines", "SELECT p_partkey, to_json({'p_partkey': p_partkey, 'p_name': p_name, 'p_size': p_size})::VARCHAR AS line FROM part")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_size")
    return part.select("p_partkey", W.json_line(part, "p_partkey", "p_name", "p_size").alias("line"))


def _escaped(column: str) -> str:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("''", "apos")):
        column = f"replace({column}, '{sign}', '&{name};')"
    return column


@query("xml_tokens", f"WITH {GRAPH}, {CHUNKS}, o AS (SELECT *, row_number() OVER (PARTITION BY graph ORDER BY idx) AS i FROM k) SELECT graph, '<tokens>' || string_agg('<token id=\"' || i || '\">' || CASE WHEN form IS NULL THEN '' ELSE '<form>' || {_escaped('form')} || '</form>' END || '<label>' || label || '</label></token>', '' ORDER BY i) || '</tokens>' AS xml FROM o GROUP BY 1")
def xml_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_tokens(spark, folder).groupBy("graph").agg(F.array_sort(F.collect_list(F.struct("idx", "form", "label"))).alias("tokens"))
    return rows.select("graph", W.xml_tokens(F.col("tokens"), "form", "label").alias("xml"))


_CELL = "coalesce(nullif({0}, ''), '_')"
_FEATS = "array_to_string(list_transform(list_sort(list_transform(map_entries(feats), lambda e: {'k': lower(e.key), 'key': e.key, 'value': e.value})), lambda e: e.key || '=' || coalesce(e.value, '')), '|')"
_LINE = " || chr(9) || ".join(_CELL.format(c) for c in ("id", "form", "lemma", "upos", "xpos", _FEATS, "head::VARCHAR", "deprel", "deps", "misc"))


@query("conllu_lines", f"WITH l AS (SELECT DISTINCT doc_id, sent_id, id, {_LINE} AS line FROM conllu_tokens WHERE sent_id IS NOT NULL), o AS (SELECT *, try_cast(regexp_extract(id, '^(\\d+)', 1) AS INTEGER) AS a, CASE WHEN contains(id, '-') THEN -1 ELSE coalesce(try_cast(nullif(regexp_extract(id, '\\.(\\d+)$', 1), '') AS INTEGER), 0) END AS i FROM l) SELECT doc_id, sent_id, '# sent_id = ' || sent_id || chr(10) || string_agg(line, chr(10) ORDER BY a, i, line) || chr(10) AS block FROM o GROUP BY 1, 2")
def conllu_lines(spark: SparkSession, folder: str) -> DataFrame:
    return W.conllu_sentences(table(spark, folder, "conllu_tokens").where("sent_id is not null"), ["doc_id", "sent_id"])


@query("html_tables", "SELECT n_regionkey, '<table><tr><th>n_nationkey</th><th>n_name</th></tr>' || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>', '' ORDER BY n_nationkey) || '</table>' AS html FROM nation GROUP BY 1")
def html_tables(spark: SparkSession, folder: str) -> DataFrame:
    return W.html_table(table(spark, folder, "nation"), ["n_regionkey"], "n_nationkey", "n_nationkey", "n_name")
