"""Queries over counters, text functions, joins, windows, sets, graphs and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellex.functions import counters as C
from tessellex.functions import text as T
from tessellex.operators import graphs as G
from tessellex.operators import spans as S
from tessellex.queries import query
from tessellex.session import broadcast_checked, table

TOKENS = r"tok AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents)"
AB = f"WITH {TOKENS}, a AS (SELECT word AS key, count(*)::DOUBLE AS value FROM tok WHERE lang = 'en' GROUP BY 1), b AS (SELECT word AS key, count(*)::DOUBLE AS value FROM tok WHERE lang = 'de' GROUP BY 1) "
J = "FROM a FULL JOIN b USING (key)"


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    return T.words(table(spark, folder, "documents", "doc_id", "lang", "source", "text"), keep=("doc_id", "lang", "source"))


def two_counters(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Word counts of the texts labelled en and de."""
    docs = table(spark, folder, "documents", "doc_id", "lang", "text")
    count = lambda code: C.counter(T.words(docs.where(F.col("lang") == code)), "word")
    return count("en"), count("de")


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in frame.columns))


def binary(name: str, run, sql: str):
    def go(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(run(*two_counters(spark, folder)), "value")

    query(name, AB + sql)(go)


def unary(name: str, run, sql: str, *columns: str):
    def go(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(run(two_counters(spark, folder)[0]), *(columns or ("value",)))

    query(name, AB + sql)(go)


binary("counter_union", C.union, "SELECT key, round(coalesce(a.value, 0) + coalesce(b.value, 0), 6) AS value " + J)
binary("counter_intersection_min", C.intersection, "SELECT key, round(least(a.value, b.value), 6) AS value FROM a JOIN b USING (key)")
binary("counter_product", C.product, "SELECT key, round(a.value * b.value, 6) AS value FROM a JOIN b USING (key)")
binary("counter_division", C.division, "SELECT key, CASE WHEN b.value IS NULL THEN 'Infinity'::DOUBLE ELSE round(coalesce(a.value, 0) / b.value, 6) END AS value " + J)
binary("counter_division_defined", C.division_defined, "SELECT key, round(coalesce(a.value, 0) / b.value, 6) AS value FROM a RIGHT JOIN b USING (key)")
binary("counter_average", C.average, "SELECT key, (coalesce(a.value, 0) + coalesce(b.value, 0)) / 2 AS value " + J)
query("counter_compare", AB + 'SELECT key, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y, sign(coalesce(a.value, 0) - coalesce(b.value, 0))::INTEGER AS "order" ' + J)(lambda s, f: C.compare(*two_counters(s, f)))
query("counter_retain_keys", AB + "SELECT key, value FROM a WHERE key IN (SELECT key FROM b)")(lambda s, f: C.retain_keys(*two_counters(s, f)))
query("counter_remove_keys", AB + "SELECT key, value FROM a WHERE key NOT IN (SELECT key FROM b)")(lambda s, f: C.remove_keys(*two_counters(s, f)))
query("counter_equals", AB + "SELECT coalesce(max(abs(coalesce(a.value, 0) - coalesce(b.value, 0))), 0) <= 0 AS equal " + J)(lambda s, f: C.equals(*two_counters(s, f)))
query("counter_good_turing")(lambda s, f: C.good_turing(two_counters(s, f)[0]))
query("counter_sample")(lambda s, f: C.sample(two_counters(s, f)[0], 1000))
binary("counter_absdiff", C.absolute_difference, "SELECT key, round(abs(coalesce(a.value, 0) - coalesce(b.value, 0)), 6) AS value " + J + " WHERE coalesce(a.value, 0) <> coalesce(b.value, 0)")
binary("counter_linear_comb", lambda a, b: C.linear_combination(a, 0.5, b, -0.25), "SELECT key, round(0.5 * coalesce(a.value, 0) - 0.25 * coalesce(b.value, 0), 6) AS value " + J)
unary("counter_normalize", C.normalize, "SELECT key, round(value / (SELECT sum(value) FROM a), 6) AS value FROM a")
unary("counter_l2_normalize", C.l2_normalize, "SELECT key, round(value / (SELECT sqrt(sum(value * value)) FROM a), 6) AS value FROM a")
unary("counter_entropy", C.entropy, "SELECT round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT value / (SELECT sum(value) FROM a) AS p FROM a)", "entropy")
unary("counter_mean_std", C.total, "SELECT sum(value) AS total, count(*) AS size, max(value) AS greatest, min(value) AS least, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation FROM a", "mean", "deviation")
unary("counter_retain_top", lambda a: C.retain_top(a, 50), "SELECT key, value FROM a ORDER BY value DESC, key LIMIT 50")
unary("counter_retain_above", lambda a: C.retain_above(a, 10.0), "SELECT key, value FROM a WHERE value >= 10")
unary("counter_keys_below", lambda a: C.keys_below(a, 3.0), "SELECT key FROM a WHERE value <= 3")
unary("counter_keys_above", lambda a: C.keys_above(a, 3.0), "SELECT key FROM a WHERE value >= 3")
unary("counter_keys_at", lambda a: C.keys_at(a, 3.0), "SELECT key FROM a WHERE value = 3")
unary("counter_retain_below", lambda a: C.retain_below(a, 10.0), "SELECT key, value FROM a WHERE value <= 10")
unary("counter_argmax", C.argmax, "SELECT key, value FROM a ORDER BY value DESC, key LIMIT 1")
unary("counter_rank", lambda a: C.ranks(a).select("key", "rank"), "SELECT key, row_number() OVER (ORDER BY value DESC, key) AS rank FROM a")
unary("counter_tied_rank", lambda a: C.ranks(a).select("key", "tied_rank"), "SELECT key, rank() OVER (ORDER BY value DESC) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS tied_rank FROM a")
unary("counter_count_counts", C.count_counts, "SELECT value, count(*) AS keys FROM a GROUP BY value")
unary("counter_hindex", C.h_index, "SELECT max(least(value, r))::BIGINT AS h_index FROM (SELECT value, row_number() OVER (ORDER BY value DESC) AS r FROM a)")
unary("counter_tflog", C.tf_log, "SELECT key, CASE WHEN value > 0 THEN round(1 + ln(value), 6) ELSE 0 END AS value FROM a")
unary("counter_scale_pow", lambda a: C.scale_power(a, 2.0, 0.5), "SELECT key, round(2 * sqrt(value), 6) AS value FROM a")


@query("counter_similarities", AB + "SELECT round(coalesce(sum(x * y), 0), 6) AS dot, round(CASE WHEN sum(x * x) = 0 OR sum(y * y) = 0 THEN 0 ELSE sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) END, 6) AS cosine, round(sum(least(x, y)) / sum(greatest(x, y)), 6) AS jaccard, round(count(*) FILTER (ax AND ay) / count(*), 6) AS key_jaccard FROM (SELECT coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y, a.value IS NOT NULL AS ax, b.value IS NOT NULL AS ay " + J + ")")
def counter_similarities(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.similarities(*two_counters(spark, folder)), "dot", "cosine", "jaccard", "key_jaccard")


INFORMATION = "CASE WHEN {0} <= 0 THEN 0 WHEN {1} <= 0 THEN 'Infinity'::DOUBLE ELSE {0} * log2({0} / {1}) END"


@query(
    "counter_divergences",
    AB
    + ", n AS (SELECT coalesce(a.value, 0) / (SELECT sum(value) FROM a) AS p, coalesce(b.value, 0) / (SELECT sum(value) FROM b) AS q "
    + J
    + f"), m AS (SELECT p, q, (p + q) / 2 AS m, 0.99 * q + 0.01 * p AS s FROM n) SELECT sum({INFORMATION.format('p', 'q')}) AS kl, round(sum({INFORMATION.format('p', 'm')} + {INFORMATION.format('q', 'm')}) / 2, 6) AS js, round(sum({INFORMATION.format('p', 's')}), 6) AS skew FROM m",
)
def counter_divergences(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(C.divergences(*two_counters(spark, folder)), "js", "skew")


# the first counter within both, so that the divergence is finite
@query("counter_kl", AB + f", u AS (SELECT key, coalesce(a.value, 0) AS x, coalesce(a.value, 0) + coalesce(b.value, 0) AS y {J}), n AS (SELECT x / (SELECT sum(x) FROM u) AS p, y / (SELECT sum(y) FROM u) AS q FROM u) SELECT round(sum({INFORMATION.format('p', 'q')}), 6) AS kl FROM n")
def counter_kl(spark: SparkSession, folder: str) -> DataFrame:
    a, b = two_counters(spark, folder)
    return rounded(C.divergences(a, C.union(a, b)).select("kl"), "kl")


@query("counter_cross_entropy", AB + f", u AS (SELECT key, coalesce(a.value, 0) AS x, coalesce(a.value, 0) + coalesce(b.value, 0) AS y {J}) SELECT round(sum(CASE WHEN x <> 0 THEN x * log2(y / (SELECT sum(y) FROM u)) ELSE 0 END), 4) AS cross_entropy FROM u")
def counter_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    a, b = two_counters(spark, folder)
    return rounded(C.cross_entropy(a, C.union(a, b)), "cross_entropy", digits=4)


def pair_counter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "lang", "source")
    return docs.where("lang is not null").groupBy(F.col("lang").alias("k1"), F.col("source").alias("k2")).agg(F.count("*").cast("double").alias("value"))


PAIR = "WITH p AS (SELECT lang AS k1, source AS k2, count(*)::DOUBLE AS value FROM documents WHERE lang IS NOT NULL GROUP BY 1, 2) "
query("counter2d_row_sum", PAIR + "SELECT k1 AS key, sum(value) AS value FROM p GROUP BY 1")(lambda s, f: C.row_sums(pair_counter(s, f)))
query("counter2d_col_sum", PAIR + "SELECT k2 AS key, sum(value) AS value FROM p GROUP BY 1")(lambda s, f: C.column_sums(pair_counter(s, f)))
query("counter2d_flatten", PAIR + "SELECT k1 || '/' || k2 AS key, value FROM p")(lambda s, f: pair_counter(s, f).select(F.concat_ws("/", "k1", "k2").alias("key"), "value"))
query("counter2d_pivot", PAIR + "SELECT k1, sum(CASE WHEN k2 = 'halden_wire' THEN value ELSE 0 END) AS halden_wire, sum(CASE WHEN k2 = 'tobar_wire' THEN value ELSE 0 END) AS tobar_wire FROM p GROUP BY 1")(lambda s, f: C.pivot(pair_counter(s, f), ["halden_wire", "tobar_wire"]))
query("counter_pmi", PAIR + "SELECT k1, k2, round(log2(value * (SELECT sum(value) FROM p) / ((SELECT sum(value) FROM p x WHERE x.k1 = p.k1) * (SELECT sum(value) FROM p x WHERE x.k2 = p.k2))), 6) AS value FROM p")(lambda s, f: rounded(C.pmi(pair_counter(s, f)), "value"))

# ---------------------------------------------------------------- text


@query("tokenize_ws_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) AS n FROM documents")
def tokenize_ws_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.size(T.whitespace_tokens(F.col("text"))).cast("bigint").alias("n"))


@query("tokenize_regex_counts", f"WITH {TOKENS} SELECT lang, word, count(*) AS n FROM tok GROUP BY 1, 2")
def tokenize_regex_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens(spark, folder).groupBy("lang", "word").agg(F.count("*").alias("n"))


@query("flagship_top_words", f"WITH {TOKENS}, c AS (SELECT lang, word, count(*) AS n FROM tok WHERE lang IS NOT NULL GROUP BY 1, 2) SELECT lang, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20")
def flagship_top_words(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens(spark, folder).where("lang is not null").groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("place", place).where("place <= 20").drop("place")


@query("ngram_word_topk", r"WITH t AS (SELECT regexp_extract_all(text, '[^ \t\r\n]+') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 100")
def ngram_word_topk(spark: SparkSession, folder: str) -> DataFrame:
    # the tokens are a column of their own, else each n-gram would find them again
    rows = table(spark, folder, "documents", "text").select(T.whitespace_tokens(F.col("text")).alias("w"))
    grams = rows.select(F.explode(T.ngrams(F.col("w"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(100)


@query("ngram_char_topk", "WITH g AS (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 100")
def ngram_char_topk(spark: SparkSession, folder: str) -> DataFrame:
    grams = table(spark, folder, "part", "p_name").select(F.explode(T.char_ngrams(F.col("p_name"), 3)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(100)


@query("wordshape_dan1", r"WITH t AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}]+')) AS w FROM documents) SELECT CASE WHEN regexp_matches(w, '^\p{Nd}*$') THEN 'ALL-DIGITS' WHEN regexp_matches(w, '^\p{Lu}+$') THEN 'ALL-UPPER' WHEN regexp_matches(w, '^\p{Ll}+$') THEN 'ALL-LOWER' WHEN regexp_matches(w, '^\p{Lu}\p{Ll}+$') THEN 'MIXED-CASE' ELSE 'OTHER' END AS shape, count(*) AS n FROM t GROUP BY 1")
def wordshape_dan1(spark: SparkSession, folder: str) -> DataFrame:
    found = T.words(table(spark, folder, "documents", "doc_id", "text"), r"[\p{L}\p{Nd}]+")
    return found.select(T.shape_dan1(F.col("word")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("wordshape_chris", r"WITH t AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents) SELECT regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g'), 'X{4,}', 'XXXX', 'g'), 'x{4,}', 'xxxx', 'g'), 'd{4,}', 'dddd', 'g') AS shape, count(*) AS n FROM t GROUP BY 1")
def wordshape_chris(spark: SparkSession, folder: str) -> DataFrame:
    found = T.words(table(spark, folder, "documents", "doc_id", "text"), "[A-Za-z0-9]+")
    return found.select(T.char_shape(F.col("word")).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))


@query("string_functions", "SELECT p_partkey, upper(substring(p_name, 1, 1)) || substring(p_name, 2) AS cap, CASE WHEN length(p_name) > 12 THEN substring(p_name, 1, 12) ELSE rpad(p_name, 12, ' ') END AS padded, levenshtein(p_name, p_brand) AS edits, regexp_matches(p_brand, '^[A-Za-z]+$') AS alphabetic FROM part")
def string_functions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part", "p_partkey", "p_name", "p_brand")
    return part.select("p_partkey", T.capitalize(F.col("p_name")).alias("cap"), T.pad_or_truncate(F.col("p_name"), 12).alias("padded"), F.levenshtein("p_name", "p_brand").cast("bigint").alias("edits"), F.col("p_brand").rlike("^[A-Za-z]+$").alias("alphabetic"))


@query("ascii_quotes", "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[“”„«»]', '\"', 'g'), '[‘’‚]', '''', 'g')) AS digest FROM documents")
def ascii_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text").select("doc_id", F.md5(T.ascii_quotes(F.col("text"))).alias("digest"))


@query("array_functions", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS squared, round(list_max(embedding)::DOUBLE, 5) AS greatest, list_position(embedding, list_max(embedding)) - 1 AS arg, round(list_sum(list_transform(embedding::DOUBLE[], lambda v: exp(v - list_max(embedding)::DOUBLE))), 4) AS mass FROM embeddings")
def array_functions(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("embedding")
    mass = F.aggregate(F.transform(e, lambda v: F.exp(v.cast("double") - F.array_max(e).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return table(spark, folder, "embeddings", "vec_id", "embedding").select("vec_id", F.round(T.dot(e, e), 4).alias("squared"), F.round(F.array_max(e).cast("double"), 5).alias("greatest"), (F.array_position(e, F.array_max(e)) - 1).cast("bigint").alias("arg"), F.round(mass, 4).alias("mass"))


# ---------------------------------------------------------------- joins, sets, windows


@query("join_hash", "SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def join_hash(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "customer", "c_nationkey", "c_acctbal").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


PHRASES = "ph AS (SELECT DISTINCT lower(trim(phrase)) AS word, min(label) AS label FROM phrase_table WHERE label IS NOT NULL AND trim(phrase) <> '' GROUP BY 1)"


def phrases(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "phrase_table").where("label is not null and trim(phrase) <> ''")
    return broadcast_checked(rows.groupBy(F.lower(F.trim("phrase")).alias("word")).agg(F.min("label").alias("label")), 100_000)


@query("join_lookup_left", f"WITH {TOKENS}, {PHRASES} SELECT coalesce(label, 'O') AS label, count(*) AS n FROM tok LEFT JOIN ph ON ph.word = lower(tok.word) GROUP BY 1")
def join_lookup_left(spark: SparkSession, folder: str) -> DataFrame:
    found = tokens(spark, folder).select(F.lower("word").alias("word")).join(phrases(spark, folder), "word", "left")
    return found.groupBy(F.coalesce("label", F.lit("O")).alias("label")).agg(F.count("*").alias("n"))


@query("join_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality >= 4)")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "source").join(table(spark, folder, "labels", "doc_id", "quality").where("quality >= 4").select("doc_id"), "doc_id", "left_semi")


@query("join_anti_stopwords", f"WITH {TOKENS}, stop AS (SELECT word FROM tok GROUP BY 1 ORDER BY count(*) DESC, word LIMIT 50) SELECT word, count(*) AS n FROM tok WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1")
def join_anti_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens(spark, folder).groupBy("word").agg(F.count("*").alias("n"))
    stop = F.broadcast(counts.orderBy(F.desc("n"), "word").limit(50).select("word"))  # 50 rows
    return counts.join(stop, "word", "left_anti")


SPANS = "a AS (SELECT doc_id, quality AS v, (doc_id % 97)::BIGINT AS lo, (doc_id % 97 + 5 + quality)::BIGINT AS hi FROM (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL))"


@query("join_range_overlap", f"WITH {SPANS} SELECT x.doc_id AS doc_id, y.doc_id AS doc_id_b FROM a x JOIN a y ON x.v = y.v AND x.lo < y.hi AND y.lo < x.hi AND x.doc_id < y.doc_id")
def join_range_overlap(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels", "doc_id", "quality").where("quality is not null").distinct()
    a = rows.select("doc_id", F.col("quality").alias("v"), (F.col("doc_id") % 97).alias("lo"), (F.col("doc_id") % 97 + 5 + F.col("quality")).alias("hi"))
    return S.overlap_join(a, a, ["v"], 16).where("doc_id < doc_id_b").select("doc_id", "doc_id_b")


@query("join_nearest_asof", "WITH c AS (SELECT DISTINCT conv_id, turn, role, text, sent_at FROM conversations) SELECT conv_id, turn, role, last_value(role IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, sent_at, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_role FROM c")
def join_nearest_asof(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text", "sent_at").distinct()
    order = [F.col("turn"), F.col("sent_at").asc_nulls_last(), F.col("text").asc_nulls_last()]
    return S.latest_before(rows, ["conv_id"], order, F.col("role"), "before_role").select("conv_id", "turn", "role", "before_role")


WORDSETS = f"WITH {TOKENS}, x AS (SELECT DISTINCT word FROM tok WHERE lang = 'en'), y AS (SELECT DISTINCT word FROM tok WHERE lang = 'fr') "


def word_sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents", "doc_id", "lang", "text")
    return T.words(docs.where("lang = 'en'")).select("word"), T.words(docs.where("lang = 'fr'")).select("word")


query("set_union", WORDSETS + "SELECT word FROM x UNION SELECT word FROM y")(lambda s, f: word_sets(s, f)[0].union(word_sets(s, f)[1]).distinct())
query("set_intersection", WORDSETS + "SELECT word FROM x INTERSECT SELECT word FROM y")(lambda s, f: word_sets(s, f)[0].intersect(word_sets(s, f)[1]))
query("set_diff", WORDSETS + "SELECT word FROM x EXCEPT SELECT word FROM y")(lambda s, f: word_sets(s, f)[0].subtract(word_sets(s, f)[1]))


@query("kfold_partition", "SELECT doc_id % 5 AS fold, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def kfold_partition(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "n_chars").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("window_context_lag_lead", "SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_context_lag_lead(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, folder, "events", "event_id", "user_id", "ts", "event_type", "value")
    return rows.select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"))


@query("topk_per_group", "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 10")
def topk_per_group(spark: SparkSession, folder: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, folder, "events", "event_type", "event_id", "value").withColumn("place", place).where("place <= 10").drop("place")


@query("gaps_islands_group", "WITH l AS (SELECT user_id, event_id, event_type, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), i AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM l) SELECT user_id, island::BIGINT AS island, event_type, count(*) AS n FROM i GROUP BY 1, 2, 3")
def gaps_islands_group(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events", "user_id", "event_id", "event_type", "ts")
    return S.islands(rows, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"))


@query("allen_relation", "WITH x AS (SELECT o_orderkey, (o_orderkey % 7)::BIGINT AS la, (o_orderkey % 7 + 3)::BIGINT AS ha, (o_custkey % 5)::BIGINT AS lb, (o_custkey % 5 + 4)::BIGINT AS hb FROM orders) SELECT o_orderkey, CASE WHEN ha < lb THEN 'before' WHEN la > hb THEN 'after' WHEN ha = lb THEN 'meets' WHEN la = hb THEN 'met_by' WHEN la = lb AND ha = hb THEN 'equal' WHEN la = lb AND ha < hb THEN 'starts' WHEN la = lb THEN 'started_by' WHEN ha = hb AND la > lb THEN 'finishes' WHEN ha = hb THEN 'finished_by' WHEN la > lb AND ha < hb THEN 'during' WHEN la < lb AND ha > hb THEN 'contains' WHEN la < lb THEN 'overlaps' ELSE 'overlapped_by' END AS relation FROM x")
def allen_relation(spark: SparkSession, folder: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey").select("o_orderkey", S.allen(o % 7, o % 7 + 3, c % 5, c % 5 + 4).alias("relation"))


@query("interval_relation", "WITH x AS (SELECT o_orderkey, o_orderkey % 7 AS la, o_orderkey % 7 + 3 AS ha, o_custkey % 5 AS lb, o_custkey % 5 + 1 + o_custkey % 3 AS hb FROM orders) SELECT o_orderkey, CASE WHEN la = lb AND ha = hb THEN 'EQUAL' WHEN la = lb THEN CASE WHEN ha < hb THEN 'INSIDE' ELSE 'CONTAIN' END WHEN ha = hb THEN CASE WHEN la < lb THEN 'CONTAIN' ELSE 'INSIDE' END WHEN la > lb AND ha < hb THEN 'INSIDE' WHEN la < lb AND ha > hb THEN 'CONTAIN' WHEN la > hb THEN 'AFTER' WHEN ha < lb THEN 'BEFORE' WHEN la = hb THEN 'BEGIN_MEET_END' WHEN ha = lb THEN 'END_MEET_BEGIN' ELSE 'OVERLAP' END AS relation FROM x")
def interval_relation(spark: SparkSession, folder: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, folder, "orders", "o_orderkey", "o_custkey").select("o_orderkey", S.interval_relation(o % 7, o % 7 + 3, c % 5, c % 5 + 1 + c % 3).alias("relation"))


# ---------------------------------------------------------------- dependency graphs

DEP = "tok AS (SELECT DISTINCT doc_id, sent_id, id, form, lemma, upos, head, deprel FROM conllu_tokens WHERE regexp_matches(id, '^[0-9]+$')), e AS (SELECT doc_id || '/' || sent_id || '/' || head AS src, doc_id || '/' || sent_id || '/' || id AS dst, deprel FROM tok WHERE head > 0 AND sent_id IS NOT NULL)"


def dependencies(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the CoNLL-U tables, repeated rows once: ``src, dst, deprel``."""
    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "form", "lemma", "upos", "head", "deprel").where(F.col("id").rlike("^[0-9]+$")).distinct()
    node = lambda c: F.concat(F.col("doc_id").cast("string"), F.lit("/"), "sent_id", F.lit("/"), F.col(c).cast("string"))
    return rows.where("head > 0 and sent_id is not null").select(node("head").alias("src"), node("id").alias("dst"), "deprel")


query("graph_children", f"WITH {DEP} SELECT src AS node, count(*) AS children FROM e GROUP BY 1")(lambda s, f: G.children(dependencies(s, f)))
query("graph_siblings", f"WITH {DEP} SELECT dst AS node, count(*) OVER (PARTITION BY src) - 1 AS siblings FROM e")(lambda s, f: G.siblings(dependencies(s, f)))
query("graph_roots", f"WITH {DEP} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")(lambda s, f: G.roots(dependencies(s, f)))
query("graph_relation_counts", f"WITH {DEP} SELECT deprel, count(*) AS n FROM e GROUP BY 1")(lambda s, f: dependencies(s, f).groupBy("deprel").agg(F.count("*").alias("n")))


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """region → nation → supplier as edges."""
    nation = table(spark, folder, "nation")
    supplier = table(spark, folder, "supplier", "s_suppkey", "s_nationkey")
    one = nation.select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").cast("bigint").alias("ord"))
    two = supplier.select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("s_suppkey").cast("bigint").alias("ord"))
    return one.unionByName(two)


HIER = "h AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS ord FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey FROM supplier)"
BELOW = f"WITH RECURSIVE {HIER}, d(root, node, depth) AS (SELECT src, dst, 1 FROM h WHERE src NOT IN (SELECT dst FROM h) UNION ALL SELECT root, h.dst, depth + 1 FROM d JOIN h ON h.src = d.node) "
query("graph_descendants", BELOW + "SELECT root, node, depth::INTEGER AS depth FROM d")(lambda s, f: G.descendants(hierarchy(s, f), G.roots(hierarchy(s, f))))
query("graph_components", BELOW + "SELECT node, (SELECT min(x) FROM (SELECT root AS x FROM d e WHERE e.root = d.root UNION ALL SELECT node FROM d e WHERE e.root = d.root)) AS component FROM d UNION SELECT root, (SELECT min(x) FROM (SELECT root AS x FROM d e WHERE e.root = d.root UNION ALL SELECT node FROM d e WHERE e.root = d.root)) FROM d")(lambda s, f: G.components(hierarchy(s, f)))
query("graph_shortest_path", f"WITH RECURSIVE {HIER}, d(node, distance) AS (SELECT 'r1', 0 UNION ALL SELECT h.dst, distance + 1 FROM d JOIN h ON h.src = d.node) SELECT node, distance::INTEGER AS distance FROM d")(lambda s, f: G.shortest_paths(hierarchy(s, f), "r1"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """The hierarchy numbered by paths: ancestors are prefixes, order is path order."""
    return G.number_tree(hierarchy(spark, folder))


query("tree_dominates", BELOW + "SELECT root AS above, count(*) AS below FROM d GROUP BY 1 UNION ALL SELECT src, count(*) FROM h WHERE src LIKE 'n%' GROUP BY 1")(
    lambda s, f: _dominates(tree(s, f))
)


def _dominates(nodes: DataFrame) -> DataFrame:
    """Counts of dominated nodes: every node counts for each prefix of its path."""
    parts = F.split("path", r"\.")
    up = nodes.where("depth > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("path"))
    counts = up.groupBy("path").agg(F.count("*").alias("below"))
    return counts.join(nodes.select("path", F.col("node").alias("above")), "path").select("above", "below")


@query("tree_sister_positions", f"WITH {HIER} SELECT dst AS node, row_number() OVER (PARTITION BY src ORDER BY ord) AS child_no, count(*) OVER (PARTITION BY src) = 1 AS only_child, lag(dst) OVER (PARTITION BY src ORDER BY ord) AS left_sister FROM h")
def tree_sister_positions(spark: SparkSession, folder: str) -> DataFrame:
    w = Window.partitionBy("src").orderBy("ord")
    every = Window.partitionBy("src")
    return hierarchy(spark, folder).select(F.col("dst").alias("node"), F.row_number().over(w).cast("bigint").alias("child_no"), (F.count("*").over(every) == 1).alias("only_child"), F.lag("dst").over(w).alias("left_sister"))


# ---------------------------------------------------------------- dates, classification, vectors


@query("temporal_arithmetic", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS next_month, (o_orderdate::DATE - INTERVAL 7 DAY)::DATE AS week_before, strftime(o_orderdate::DATE, '%G-W%V') AS iso_week, date_trunc('quarter', o_orderdate::DATE)::DATE AS quarter, isodow(o_orderdate::DATE)::BIGINT AS weekday FROM orders")
def temporal_arithmetic(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    week = F.weekofyear(d)
    # the ISO year is that of the week's Thursday
    year = F.year(F.date_add(d, 4 - F.weekday(d).cast("int") - 1))
    return table(spark, folder, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.add_months(d, 1).alias("next_month"), F.date_sub(d, 7).alias("week_before"), F.format_string("%d-W%02d", year, week).alias("iso_week"), F.trunc(d, "quarter").alias("quarter"), (F.weekday(d) + 1).cast("bigint").alias("weekday"))


@query("docdate_regex", r"SELECT doc_id, CASE WHEN regexp_matches(doc_date, '^[0-9]{4}-?[0-9]{2}-?[0-9]{2}$') THEN regexp_replace(doc_date, '^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$', '\1-\2-\3') ELSE regexp_replace(regexp_extract(doc_key, '_([0-9]{8})\.', 1), '^([0-9]{4})([0-9]{2})([0-9]{2})$', '\1-\2-\3') END AS day FROM documents")
def docdate_regex(spark: SparkSession, folder: str) -> DataFrame:
    """Document date: its own if complete, else the one in its key."""
    own = F.col("doc_date").rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}$")
    key = F.regexp_replace(F.regexp_extract("doc_key", r"_([0-9]{8})\.", 1), "^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    return table(spark, folder, "documents", "doc_id", "doc_date", "doc_key").select("doc_id", F.when(own, F.regexp_replace("doc_date", "^([0-9]{4})-?([0-9]{2})-?([0-9]{2})$", "$1-$2-$3")).otherwise(key).alias("day"))


@query("timex_iso_regex", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS value FROM documents) SELECT value, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t WHERE regexp_matches(value, '^(19|20)[0-9][0-9]$') GROUP BY 1")
def timex_iso_regex(spark: SparkSession, folder: str) -> DataFrame:
    """Years as TIMEX values."""
    found = T.words(table(spark, folder, "documents", "doc_id", "text"), "[0-9]+").where(F.col("word").rlike("^(19|20)[0-9][0-9]$"))
    return found.groupBy(F.col("word").alias("value")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("percent_normalize", r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+[.,][0-9]+ ?%')) AS m FROM documents) SELECT doc_id, m AS surface, '%' || round(replace(regexp_replace(m, ' ?%', ''), ',', '.')::DOUBLE, 2) AS value FROM t")
def percent_normalize(spark: SparkSession, folder: str) -> DataFrame:
    found = T.words(table(spark, folder, "documents", "doc_id", "text"), "[0-9]+[.,][0-9]+ ?%")
    number = F.round(F.translate(F.regexp_replace("word", " ?%", ""), ",", ".").cast("double"), 2)
    return found.select("doc_id", F.col("word").alias("surface"), F.concat(F.lit("%"), number.cast("string")).alias("value"))


@query("confusion_matrix", "WITH l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL) SELECT quality >= 3 AS gold, toxic = 1 AS guess, count(*) AS n FROM l GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels", "doc_id", "quality", "toxic").where("quality is not null").distinct()
    return rows.groupBy((F.col("quality") >= 3).alias("gold"), (F.col("toxic") == 1).alias("guess")).agg(F.count("*").alias("n"))


@query("precision_recall_f1", "WITH l AS (SELECT DISTINCT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL), s AS (SELECT count(*) FILTER (toxic = 1 AND quality <= 2) AS tp, count(*) FILTER (toxic = 1) AS guessed, count(*) FILTER (quality <= 2) AS gold FROM l) SELECT round(tp / guessed, 6) AS precision, round(tp / gold, 6) AS recall, round(2 * tp / (guessed + gold), 6) AS f1 FROM s")
def precision_recall_f1(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels", "doc_id", "quality", "toxic").where("quality is not null").distinct()
    s = rows.agg(F.count_if((F.col("toxic") == 1) & (F.col("quality") <= 2)).alias("tp"), F.count_if(F.col("toxic") == 1).alias("g"), F.count_if(F.col("quality") <= 2).alias("k"))
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return s.select(F.round(F.col("tp") / zero("g"), 6).alias("precision"), F.round(F.col("tp") / zero("k"), 6).alias("recall"), F.round(2 * F.col("tp") / F.nullif(F.col("g") + F.col("k"), F.lit(0)), 6).alias("f1"))


@query("nb_counts", f"WITH {TOKENS}, l AS (SELECT DISTINCT doc_id, toxic FROM labels), t AS (SELECT DISTINCT tok.doc_id, word, toxic FROM tok JOIN l USING (doc_id)) SELECT toxic, word, count(*) AS n, round(ln((count(*) + 1) / ((SELECT count(*) FROM t x WHERE x.toxic = t.toxic) + 1)), 6) AS log_weight FROM t GROUP BY 1, 2")
def nb_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Naive Bayes counts and smoothed log weights of words per class."""
    labels = table(spark, folder, "labels", "doc_id", "toxic").distinct()
    seen = tokens(spark, folder).select("doc_id", "word").join(labels, "doc_id").distinct()
    counts = seen.groupBy("toxic", "word").agg(F.count("*").alias("n"))
    sums = counts.groupBy("toxic").agg(F.sum("n").alias("t"))
    return counts.join(sums, "toxic").select("toxic", "word", "n", F.round(F.log((F.col("n") + 1) / (F.col("t") + 1)), 6).alias("log_weight"))


@query("knn_cosine_vote", "WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM n WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id, n.vec_id AS other, round(list_cosine_similarity(q.e, n.e), 5) AS sim, n.label FROM q JOIN n ON n.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.e, n.e), 5) DESC, n.vec_id) <= 5) SELECT vec_id, other, sim, label FROM s")
def knn_cosine_vote(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest 5 of every vector whose id is divisible by 50, against all.

    The queries are a stated set, taken in blocks to every vector.
    """
    from tessellex.operators.neighbours import nearest

    vectors = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    found = nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return found.join(vectors.select(F.col("vec_id").alias("other"), "label"), "other").select("vec_id", "other", "sim", "label")


@query("stream_window_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Event-time windows; the same plan runs on a stream (streaming/windows.py)."""
    from tessellex.streaming.windows import hourly_counts

    return hourly_counts(table(spark, folder, "events", "ts", "event_type", "value")).withColumn("total", F.round("total", 4))


@query("conll_lines", r"WITH t AS (SELECT DISTINCT doc_id, sent_id, id, form, lemma, xpos, head, deprel FROM conllu_tokens WHERE regexp_matches(id, '^[0-9]+$')) SELECT doc_id, sent_id, id, concat_ws(chr(9), id, coalesce(form, '_'), coalesce(nullif(lemma, ''), '_'), coalesce(nullif(xpos, ''), '_'), coalesce(CASE WHEN head < 0 THEN NULL ELSE head::VARCHAR END, '_'), coalesce(nullif(deprel, ''), '_')) AS line FROM t")
def conll_lines(spark: SparkSession, folder: str) -> DataFrame:
    from tessellex.sources.conll import conll_line

    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "form", "lemma", "xpos", "head", "deprel").where(F.col("id").rlike("^[0-9]+$")).distinct()
    return rows.select("doc_id", "sent_id", "id", conll_line("id", "form", "lemma", "xpos", "head", "deprel").alias("line"))


@query("tagged_lines", "WITH t AS (SELECT DISTINCT doc_id, sent_id, id::BIGINT AS k, form, xpos FROM conllu_tokens WHERE regexp_matches(id, '^[0-9]+$') AND sent_id IS NOT NULL) SELECT doc_id, sent_id, string_agg(coalesce(form, '_') || '_' || coalesce(nullif(xpos, ''), 'NONE'), ' ' ORDER BY k, coalesce(form, '_'), coalesce(nullif(xpos, ''), 'NONE')) AS line FROM t GROUP BY 1, 2")
def tagged_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conllu_tokens", "doc_id", "sent_id", "id", "form", "xpos").where(F.col("id").rlike("^[0-9]+$") & F.col("sent_id").isNotNull()).select("doc_id", "sent_id", F.col("id").cast("bigint").alias("k"), "form", "xpos").distinct()
    unit = F.struct("k", F.coalesce("form", F.lit("_")).alias("form"), F.coalesce(F.nullif("xpos", F.lit("")), F.lit("NONE")).alias("tag"))
    return rows.groupBy("doc_id", "sent_id").agg(F.array_sort(F.collect_list(unit)).alias("u")).select("doc_id", "sent_id", F.array_join(F.transform("u", lambda x: F.concat(x["form"], F.lit("_"), x["tag"])), " ").alias("line"))
