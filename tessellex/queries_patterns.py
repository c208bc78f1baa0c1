"""Queries of the pattern languages over the dependency tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellex.operators.patterns import GraphPatterns, TreePatterns, tree_nodes
from tessellex.queries import query
from tessellex.session import table

GRAPH = "t AS (SELECT DISTINCT doc_id, sent_id, id, form, lemma, upos, xpos, head, deprel FROM conllu_tokens WHERE regexp_matches(id, '^[0-9]+$') AND sent_id IS NOT NULL), n AS (SELECT DISTINCT doc_id || '/' || sent_id AS graph, id::INTEGER AS idx, form, upos FROM t), e AS (SELECT DISTINCT doc_id || '/' || sent_id AS graph, head AS gov, id::INTEGER AS dep, deprel AS reln FROM t WHERE head > 0)"


def graphs(spark: SparkSession, folder: str) -> GraphPatterns:
    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "form", "upos", "head", "deprel").where(F.col("id").rlike("^[0-9]+$") & F.col("sent_id").isNotNull())
    rows = rows.select(F.concat_ws("/", F.col("doc_id").cast("string"), "sent_id").alias("graph"), F.col("id").cast("int").alias("idx"), "form", "upos", "head", "deprel")
    edges = rows.where("head > 0").select("graph", F.col("head").alias("gov"), F.col("idx").alias("dep"), F.col("deprel").alias("reln")).distinct()
    return GraphPatterns(rows.select("graph", "idx", "form", "upos").distinct(), edges)


def graph_pattern(name: str, pattern: str, sql: str) -> None:
    query(name, f"WITH {GRAPH} " + sql)(lambda spark, folder: graphs(spark, folder).find(pattern))


graph_pattern(
    "graph_pattern_subject_object",
    "{upos:VERB} >nsubj {}=s >obj {}=o",
    "SELECT DISTINCT n.graph, n.idx AS node, a.dep AS o, b.dep AS s FROM n JOIN e a ON a.graph = n.graph AND a.gov = n.idx AND a.reln = 'obj' JOIN e b ON b.graph = n.graph AND b.gov = n.idx AND b.reln = 'nsubj' JOIN n x ON x.graph = n.graph AND x.idx = a.dep JOIN n y ON y.graph = n.graph AND y.idx = b.dep WHERE n.upos = 'VERB'",
)
graph_pattern(
    "graph_pattern_negation",
    "{upos:/NOUN|PROPN/} !>det {}",
    "SELECT DISTINCT graph, idx AS node FROM n WHERE regexp_full_match(upos, 'NOUN|PROPN') AND NOT EXISTS (SELECT 1 FROM e JOIN n d ON d.graph = e.graph AND d.idx = e.dep WHERE e.graph = n.graph AND e.gov = n.idx AND e.reln = 'det')",
)
graph_pattern(
    "graph_pattern_adjacent",
    "{upos:ADJ} . {upos:NOUN}=n",
    "SELECT DISTINCT n.graph, n.idx AS node, b.idx AS n FROM n JOIN n b ON b.graph = n.graph AND b.idx = n.idx + 1 AND b.upos = 'NOUN' WHERE n.upos = 'ADJ'",
)
graph_pattern(
    "graph_pattern_sisters",
    "{upos:NOUN} $++ {upos:PUNCT}=a",
    "SELECT DISTINCT n.graph, n.idx AS node, b.idx AS a FROM n JOIN e x ON x.graph = n.graph AND x.dep = n.idx JOIN e y ON y.graph = n.graph AND y.gov = x.gov AND y.dep > x.dep JOIN n b ON b.graph = n.graph AND b.idx = y.dep AND b.upos = 'PUNCT' WHERE n.upos = 'NOUN'",
)
graph_pattern(
    "graph_pattern_optional_edge",
    "{upos:VERB} ?>/nsubj|obj/~r {}=x",
    "SELECT DISTINCT n.graph, n.idx AS node, p.dep AS x, p.reln AS r FROM n LEFT JOIN (SELECT e.* FROM e JOIN n d ON d.graph = e.graph AND d.idx = e.dep WHERE regexp_full_match(e.reln, 'nsubj|obj')) p ON p.graph = n.graph AND p.gov = n.idx WHERE n.upos = 'VERB'",
)


@query("graph_pattern_transitive", f"WITH RECURSIVE {GRAPH}, c(graph, a, b) AS (SELECT graph, gov, dep FROM e UNION SELECT c.graph, c.a, e.dep FROM c JOIN e ON e.graph = c.graph AND e.gov = c.b WHERE c.a <> e.dep) SELECT DISTINCT n.graph, n.idx AS node, c.b AS d FROM n JOIN c ON c.graph = n.graph AND c.a = n.idx JOIN n m ON m.graph = n.graph AND m.idx = c.b AND m.upos = 'NUM' WHERE n.upos = 'VERB'")
def graph_pattern_transitive(spark: SparkSession, folder: str) -> DataFrame:
    return graphs(spark, folder).find("{upos:VERB} >> {upos:NUM}=d")


TREE = "t AS (SELECT DISTINCT doc_id || '/' || sent_id AS graph, id::INTEGER AS idx, upos FROM conllu_tokens WHERE regexp_matches(id, '^[0-9]+$') AND sent_id IS NOT NULL AND regexp_matches(upos, '^[A-Z]+$')), f AS (SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY idx, upos) AS k, upos FROM t)"


def trees(spark: SparkSession, folder: str) -> TreePatterns:
    """Sentences as flat trees: a root over tags over words."""
    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "upos").where(F.col("id").rlike("^[0-9]+$") & F.col("sent_id").isNotNull() & F.col("upos").rlike("^[A-Z]+$"))
    rows = rows.select(F.concat_ws("/", F.col("doc_id").cast("string"), "sent_id").alias("graph"), F.struct(F.col("id").cast("int").alias("idx"), "upos").alias("u")).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda u: F.concat(F.lit("("), u["upos"], F.lit(" w)"))), " ")
    return TreePatterns(tree_nodes(rows.groupBy("graph").agg(F.concat(F.lit("(ROOT "), text, F.lit(")")).alias("bracket"))))


def tree_pattern(name: str, pattern: str, sql: str) -> None:
    query(name, f"WITH {TREE} " + sql)(lambda spark, folder: trees(spark, folder).find(pattern).groupBy("graph").agg(F.count("*").alias("n")))


tree_pattern("tree_pattern_sisters", "NOUN $+ VERB=v", "SELECT a.graph, count(*) AS n FROM f a JOIN f b ON b.graph = a.graph AND b.k = a.k + 1 AND b.upos = 'VERB' WHERE a.upos = 'NOUN' GROUP BY 1")
tree_pattern("tree_pattern_precedes", "ADJ .. PUNCT=p", "SELECT a.graph, count(*) AS n FROM f a JOIN f b ON b.graph = a.graph AND b.k > a.k AND b.upos = 'PUNCT' WHERE a.upos = 'ADJ' GROUP BY 1")
tree_pattern("tree_pattern_dominates", "ROOT << VERB=v !<< ADV", "SELECT graph, count(*) AS n FROM f WHERE upos = 'VERB' AND graph NOT IN (SELECT graph FROM f WHERE upos = 'ADV') GROUP BY 1")
