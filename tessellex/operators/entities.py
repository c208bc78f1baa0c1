"""Entities, quotations, sentiment and triples over token rows and texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellex.session import broadcast_checked, cut_lineage


#: Scripts that are written without spaces; each of their letters and digits is a word.
_UNSPACED = r"฀-໿က-႟ក-៿々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿ꧠ-꧿ꩠ-ꩿ豈-﫿ｦ-ﾟ\x{1aff0}-\x{1b16f}\x{20000}-\x{3ffff}"
_WORD = rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]][\p{{L}}\p{{N}}\p{{M}}&&[^{_UNSPACED}]]*+|[\p{{L}}\p{{N}}&&[{_UNSPACED}]]\p{{M}}*+"


def gazetteer_words(text: str | Column) -> Column:
    """Words of phrases and of texts alike: runs of letters and digits in lower
    case, single signs in scripts without spaces; other marks only part words."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def phrase_table(rows: DataFrame, phrase: str = "phrase", label: str = "label") -> DataFrame:
    """Cleaned gazetteer: ``key, n_words, label, conflict``; case, padding and
    marks between words don't matter, phrases without a letter or digit and
    null labels are dropped, the least label wins a conflict."""
    clean = rows.where(F.col(label).isNotNull()).select(gazetteer_words(phrase).alias("w"), F.col(label).alias("label")).where("size(w) > 0")
    clean = clean.select(F.array_join("w", " ").alias("key"), F.size("w").alias("n_words"), "label").distinct()
    return clean.groupBy("key").agg(F.min("label").alias("label"), (F.count("*") > 1).alias("conflict"), F.first("n_words").alias("n_words"))


def gazetteer_matches(docs: DataFrame, phrases: DataFrame, longest: int | None = None, id_column: str = "doc_id", text_column: str = "text", max_rows: int = 200_000) -> DataFrame:
    """Phrases found in texts as word n-grams: ``doc_id, begin_token, end_token, label``.

    Tokens are numbered as ``gazetteer_words`` gives them, in phrases and texts
    alike. One hash join of n-grams with the table, for each length that the
    table has (``longest`` leaves out longer ones); a match inside a longer one
    that begins at the same word is dropped.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), gazetteer_words(text_column).alias("w"))
    heads = F.collect_set(F.substring_index("key", " ", 1))
    lengths = phrases.groupBy(F.col("n_words").alias("n")).agg(F.when(F.size(heads) <= 1000, heads).alias("heads"))
    if longest is not None:
        lengths = lengths.where(F.col("n") <= longest)
    # few heads: only n-grams that begin with one of them are made
    sized = rows.crossJoin(F.broadcast(lengths)).where(F.size("w") >= F.col("n"))
    sized = sized.select("doc_id", "w", "n", F.array_intersect("w", "heads").alias("near")).where("near is null or size(near) > 0")
    starts = F.filter(F.sequence(F.lit(0), F.size("w") - F.col("n")), lambda i: F.col("near").isNull() | F.array_contains("near", F.get("w", i)))
    joined = F.transform(starts, lambda i: F.struct(i.alias("begin_token"), F.array_join(F.slice("w", i + 1, F.col("n")), " ").alias("key")))
    all_grams = sized.select("doc_id", "n", F.inline(joined))
    found = all_grams.join(broadcast_checked(phrases.select("key", "label"), max_rows), "key")
    best = F.row_number().over(Window.partitionBy("doc_id", "begin_token").orderBy(F.desc("n")))
    return found.withColumn("r", best).where("r = 1").select("doc_id", "begin_token", (F.col("begin_token") + F.col("n")).alias("end_token"), "label")


def entity_mentions(tokens: DataFrame, group: list[str], order: str, label: str, word: str, value: str | None = None) -> DataFrame:
    """Maximal runs of adjacent tokens with one label (and normalized value)."""
    window = Window.partitionBy(*group).orderBy(order)
    same = F.lag(label).over(window).eqNullSafe(F.col(label)) & (F.lag(order).over(window) == F.col(order) - 1)
    if value:
        same &= F.lag(value).over(window).eqNullSafe(F.col(value))
    rows = tokens.withColumn("_new", F.coalesce((~same).cast("int"), F.lit(1))).withColumn("mention", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where((F.col(label) != "O") & F.col(label).isNotNull())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, word))), lambda x: x[word]), " ")
    return rows.groupBy(*group, "mention", F.col(label).alias("label")).agg(F.min(order).alias("begin_token"), (F.max(order) + 1).alias("end_token"), text.alias("text"))


def overwrite(current: Column, new: Column, replaceable: tuple[str, ...] = ("O", "MISC")) -> Column:
    """A rule's label over the current one where that may be replaced."""
    return F.when(new.isNotNull() & (current.isNull() | current.isin(*replaceable)), new).otherwise(current)


def entity_links(mentions: DataFrame, dictionary: DataFrame, least_score: float = 0.0, text: str = "text") -> DataFrame:
    """Exact text to identifier; entries under the score are left out, the best wins."""
    best = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "link"))
    one = dictionary.where(F.col("score") >= least_score).withColumn("r", best).where("r = 1").select(F.col("text").alias(text), "link")
    return mentions.join(one, text, "left")


# ---------------------------------------------------------------- quotations

QUOTE_SCHEMA = "doc_id bigint, quote_id int, parent_id int, depth int, begin_char int, end_char int, text string, speaker string"
_PAIRS = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‘": "’", "‹": "›"}
_SAID = "said|says|asked|replied|answered|whispered|cried|shouted|added|told|wrote|noted|explained"
_AFTER = re.compile(rf"^[,\s]*(?:(?:{_SAID})\s+(?P<a>[A-Z]\w+(?:\s[A-Z]\w+)*|he|she|they)|(?P<b>[A-Z]\w+(?:\s[A-Z]\w+)*|[Hh]e|[Ss]he|[Tt]hey)\s+(?:{_SAID}))\b")
_BEFORE = re.compile(rf"(?P<b>[A-Z]\w+(?:\s[A-Z]\w+)*|[Hh]e|[Ss]he|[Tt]hey)\s+(?:{_SAID})[,:]?\s*$")


def find_quotes(text: str, longest: int | None = None) -> list[tuple[int, int, int | None, int, str | None]]:
    """(begin, end, parent number, depth, speaker) of matched quotations, outer first.

    Directed marks nest; straight ones pair in turn within a paragraph; a
    single mark between letters is an apostrophe. Quotations of more than
    ``longest`` characters are left out; by default there is no limit.
    """
    found, stack = [], []
    for m in re.finditer("[\"“”„«»‘’「」『』‹›]|\n\\s*\n", text):
        mark, at = m[0], m.start()
        if mark[0] == "\n":
            stack = []
            continue
        before, after = text[at - 1 : at], text[at + 1 : at + 2]
        if mark == "’" and before.isalnum() and after.isalnum():
            continue
        closes = next((k for k in range(len(stack) - 1, -1, -1) if mark in stack[k][0]), None)
        if closes is not None:
            begin = stack[closes][1]
            del stack[closes:]
            if longest is None or at + 1 - begin <= longest:
                found.append((begin, at + 1))
        elif mark in _PAIRS:
            stack.append((_PAIRS[mark], at))
        elif mark == '"':
            stack.append(('"', at))
    out: list[tuple[int, int, int | None, int, str | None]] = []
    open_: list[int] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while open_ and out[open_[-1]][1] <= a:
            open_.pop()
        parent = open_[-1] if open_ else None
        hit = _AFTER.match(text[b : b + 80]) or _BEFORE.search(text[max(0, a - 80) : a])
        speaker = next((g for g in hit.groups() if g), None) if hit else None
        out.append((a, b, parent, len(open_), speaker))
        open_.append(len(out) - 1)
    return out


def annotate_quotes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", longest: int | None = None) -> DataFrame:
    """Quotations with their nesting and the speaker a reporting clause names;
    none longer than ``longest`` characters, if that is given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                key = None if pd.isna(doc_id) else int(doc_id)
                rows.extend((key, n, parent, depth, a, b, text[a:b], who) for n, (a, b, parent, depth, who) in enumerate(find_quotes(text or "", longest)))
            yield pd.DataFrame(rows, columns=["doc_id", "quote_id", "parent_id", "depth", "begin_char", "end_char", "text", "speaker"], dtype=object)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, QUOTE_SCHEMA)


# ---------------------------------------------------------------- relations over dependency tables


def open_triples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Subject–verb–object triples of dependency graphs: ``graph, subject, relation, object``.

    Arguments are the heads with the words right below them, in word order. The
    tables and the arguments are checkpointed, so that plans stay short.
    """
    nodes, edges = cut_lineage(nodes.select("graph", "idx", "form", "upos")), cut_lineage(edges)
    near = edges.select("graph", F.col("gov").alias("head"), F.col("dep").alias("idx"), F.lit(False).alias("own")).unionByName(nodes.select("graph", F.col("idx").alias("head"), "idx", F.lit(True).alias("own")))
    words = near.join(nodes.select("graph", "idx", "form"), ["graph", "idx"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "form"))), lambda x: x["form"]), " ")
    phrase = words.groupBy("graph", F.col("head").alias("dep")).agg(text.alias("phrase"), F.bool_or("own").alias("own")).where("own").drop("own")
    subject, object_ = F.col("reln").rlike("^(?:nsubj.*)$"), F.col("reln").rlike("^(?:obj|obl|xcomp)$")
    ends = cut_lineage(edges.where(subject | object_).join(phrase, ["graph", "dep"]).select("graph", F.col("gov").alias("idx"), "reln", "phrase"))
    rows = ends.where(subject).select("graph", "idx", F.col("phrase").alias("subject")).join(ends.where(object_).select("graph", "idx", F.col("phrase").alias("object")), ["graph", "idx"])
    return rows.join(nodes.select("graph", "idx", F.col("form").alias("relation")), ["graph", "idx"]).select("graph", "subject", "relation", "object").distinct()


def truecase_table(tokens: DataFrame, word: str = "word") -> DataFrame:
    """The most frequent casing of every word, ties to the lesser form."""
    counts = tokens.groupBy(F.lower(word).alias("key"), F.col(word).alias("form")).agg(F.count("*").alias("n"))
    best = counts.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "form")).alias("b"))
    return best.select("key", F.col("b.form").alias("form"))


# ---------------------------------------------------------------- coreference


def name_chains(mentions: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Chains by two sieves: equal text, then a shorter name that ends (or
    begins) a longer one of the same document. ``doc_id, chain, representative``.

    Chains link distinct names, not mentions, so repeated names cost nothing.
    """
    names = mentions.where(F.col(text).isNotNull()).groupBy(F.col(doc).alias("doc_id"), F.col(text).alias("name")).agg(F.count("*").alias("mentions"))
    words = F.split("name", " ")
    # each name stands for itself and, where the document is known, for its ends; one aggregate instead of a join with itself
    ends = F.when(F.col("doc_id").isNull(), F.array("name")).otherwise(F.array_distinct(F.array(F.col("name"), F.element_at(words, -1), F.element_at(words, 1))))
    rows = names.select("doc_id", F.col("name").alias("long"), "mentions", F.explode(ends).alias("name"))
    own = F.col("long") == F.col("name")
    longest = F.min(F.when(~own, F.struct((-F.length("long")).alias("n"), "long")))["long"]
    out = rows.groupBy("doc_id", "name").agg(F.max(F.when(own, F.col("mentions"))).alias("mentions"), longest.alias("representative")).where("mentions IS NOT NULL")
    return out.select("doc_id", F.coalesce("representative", "name").alias("representative"), "name", "mentions")
