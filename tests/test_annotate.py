"""Numbers, times, quotations, entities and the pipeline."""

import datetime as dt

import pytest

from tessellex.operators.entities import annotate_quotes, entity_links, entity_mentions, find_quotes, gazetteer_matches, name_chains, open_triples, phrase_table, truecase_table
from tessellex.operators.normalize import annotate_times, find_times, normalize_money, parse_number
from tessellex.plans.pipeline import Pipeline, plan


@pytest.mark.parametrize("text, want", [("twenty-one", ("NUMBER", 21)), ("two hundred and five", ("NUMBER", 205)), ("one million two thousand", ("NUMBER", 1002000)), ("fourty second", ("ORDINAL", 42)), ("3rd", ("ORDINAL", 3)), ("1,234.5", ("NUMBER", 1234.5)), ("three quarters", None), ("two thirds", ("NUMBER", 2 / 3)), ("nineteen eighty four", ("NUMBER", 1984)), ("5 million", ("NUMBER", 5e6)), ("a dozen", ("NUMBER", 12)), ("cat", None), ("", None)])
def test_numbers(text, want):
    assert parse_number(text) == want


def test_money():
    assert normalize_money("$1.2 million") == "$1200000.0" and normalize_money("50 cents") == "$0.5" and normalize_money("7 euros") == "€7.0" and normalize_money("x") is None


REF = dt.date(2031, 3, 12)  # a Wednesday


@pytest.mark.parametrize(
    "text, want",
    [
        ("on 7 March 2030", [("DATE", "2030-03-07")]),
        ("March 3rd", [("DATE", "XXXX-03-03")]),
        ("2031-01-05", [("DATE", "2031-01-05")]),
        ("next Friday", [("DATE", "2031-03-14")]),
        ("last Wednesday", [("DATE", "2031-03-05")]),
        ("last month", [("DATE", "2031-02")]),
        ("this week", [("DATE", "2031-W11")]),
        ("three days ago", [("DATE", "2031-03-09")]),
        ("in 2 years", [("DATE", "2033")]),
        ("for six weeks", [("DURATION", "P6W")]),
        ("a 20-minute walk", [("DURATION", "PT20M")]),
        ("every day", [("SET", "P1D")]),
        ("at 4:30 p.m.", [("TIME", "2031-03-12T16:30")]),
        ("tomorrow", [("DATE", "2031-03-13")]),
        ("the 1990s", [("DATE", "199X")]),
        ("in 1987", [("DATE", "1987")]),
        ("nothing", []),
    ],
)
def test_times(text, want):
    assert [(t.kind, t.value) for t in find_times(text, REF)] == want


def test_open_times():
    assert [t.value for t in find_times("next Friday and three days ago")] == ["NEXT FRIDAY", "OFFSET P-3D"]


def test_quotes():
    text = "“Bo said ‘go’ twice,” replied Anna Kit. It's \"fine\". 「a『b』」"
    assert [(text[a:b], parent, who) for a, b, parent, _, who in find_quotes(text)] == [("“Bo said ‘go’ twice,”", None, "Anna Kit"), ("‘go’", 0, "Bo"), ('"fine"', None, None), ("「a『b』」", None, None), ("『b』", 3, None)]
    assert find_quotes("") == [] and find_quotes("“open") == []


def test_long_quotes_are_kept(spark):
    inner = "‘go’"
    text = f"“{'word ' * 4000}{inner} on,” said Bo."
    found = [(text[a:b], parent, depth) for a, b, parent, depth, _ in find_quotes(text)]
    assert found == [(text[: text.index("”") + 1], None, 0), (inner, 0, 1)]
    assert [text[a:b] for a, b, *_ in find_quotes(text, 10_000)] == [inner]
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert [(r.depth, r.speaker) for r in annotate_quotes(docs).collect()][0] == (0, "Bo") and annotate_quotes(docs, longest=100).count() == 1


def test_gazetteer_and_mentions(spark):
    raw = spark.createDataFrame([(" New  York ", "CITY"), ("new york", "CITY"), ("york", "TOWN"), ("", "X"), ("a", None), (None, "Y")], "phrase string, label string")
    phrases = phrase_table(raw)
    docs = spark.createDataFrame([(1, "In New York, York."), (2, None), (3, "")], "doc_id bigint, text string")
    got = {tuple(r) for r in gazetteer_matches(docs, phrases).collect()}
    assert got == {(1, 1, 3, "CITY"), (1, 2, 3, "TOWN"), (1, 3, 4, "TOWN")}
    tokens = spark.createDataFrame([(1, i, w, n) for i, (w, n) in enumerate([("Anna", "PER"), ("Kit", "PER"), ("saw", "O"), ("Bo", "PER"), ("Rome", "LOC"), ("x", None)])], "doc_id int, idx int, word string, ner string")
    found = {(r.text, r.label, r.begin_token, r.end_token) for r in entity_mentions(tokens, ["doc_id"], "idx", "ner", "word").collect()}
    assert found == {("Anna Kit", "PER", 0, 2), ("Bo", "PER", 3, 4), ("Rome", "LOC", 4, 5)}
    links = spark.createDataFrame([("Bo", "Q1", 0.9), ("Bo", "Q2", 0.5), ("Rome", "Q3", 0.1)], "text string, link string, score double")
    assert {(r.text, r.link) for r in entity_links(entity_mentions(tokens, ["doc_id"], "idx", "ner", "word"), links, 0.3).collect()} == {("Anna Kit", None), ("Bo", "Q1"), ("Rome", None)}
    chains = {(r.name, r.representative) for r in name_chains(spark.createDataFrame([(1, "Anna Kit"), (1, "Kit"), (1, "Anna"), (1, "Bo"), (2, "Kit")], "doc_id int, text string")).collect()}
    assert chains == {("Anna Kit", "Anna Kit"), ("Kit", "Anna Kit"), ("Anna", "Anna Kit"), ("Bo", "Bo"), ("Kit", "Kit")}
    assert {tuple(r) for r in truecase_table(tokens).where("key = 'anna'").collect()} == {("anna", "Anna")}


def test_gazetteer_reaches_marks_unspaced_scripts_and_long_phrases(spark):
    long = "the board of the old harbour of the town of velmark"
    raw = spark.createDataFrame([("Kelvar Bros. Inc.", "ORG"), ("萨戈·米萨米", "PER"), ("スター", "X"), ("हिन्दी", "LANG"), (long, "ORG"), ("...", "Y")], "phrase string, label string")
    phrases = phrase_table(raw)
    assert {(r.key, r.n_words) for r in phrases.collect()} == {("kelvar bros inc", 3), ("萨 戈 米 萨 米", 5), ("ス タ ー", 3), ("हिन्दी", 1), (long, 11)}
    docs = spark.createDataFrame([(1, "He left Kelvar Bros. Inc. then."), (2, "我见萨戈·米萨米了。"), (3, f"By {long.title()}!"), (4, "スターabc"), (5, "हिन्दी, हन्दी")], "doc_id bigint, text string")
    got = {tuple(r) for r in gazetteer_matches(docs, phrases).collect()}
    assert got == {(1, 2, 5, "ORG"), (2, 2, 7, "PER"), (3, 1, 12, "ORG"), (4, 0, 3, "X"), (5, 0, 1, "LANG")}
    assert {r.doc_id for r in gazetteer_matches(docs, phrases, longest=8).collect()} == {1, 2, 4, 5}
    many = phrase_table(raw.unionByName(spark.range(1500).selectExpr("concat('w', id) AS phrase", "'N' AS label")))
    assert {tuple(r) for r in gazetteer_matches(docs, many).collect()} == got


def test_chains_come_from_capitals_in_one_pass_over_the_texts(spark):
    texts = ["He met Anna Kit in Rome. Kit, “Anna” and May 2020 came.\n\nBo Anna Kit", "see Ab Cd\n\nEf Gh. In The Hall", None, ""]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id bigint, text string, doc_date string")
    out = Pipeline({"annotators": "coref"}).annotate(docs)
    mentions = {(r.doc_id, r.text) for r in out["mentions"].where("label = 'PERSON'").collect()}
    chains = {(r.doc_id, r.name): (r.representative, r.mentions) for r in out["chains"].collect()}
    assert set(chains) == mentions and chains[0, "Kit"] == ("Bo Anna Kit", 1) and (0, "May") not in chains
    nameless = spark.createDataFrame([(None, "Anna Kit"), (None, "Kit"), (1, "Kit")], "doc_id int, text string")
    assert {(r.doc_id, r.name, r.representative) for r in name_chains(nameless).collect()} == {(None, "Anna Kit", "Anna Kit"), (None, "Kit", "Kit"), (1, "Kit", "Kit")}
    plan = out["chains"]._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 2  # tokens and times; were read twice each


def test_triples_have_a_short_plan(spark):
    nodes = spark.createDataFrame([("g", 1, "Old", "ADJ"), ("g", 2, "Anna", "PROPN"), ("g", 3, "sees", "VERB"), ("g", 4, "it", "PRON"), ("h", 1, "go", "VERB")], "graph string, idx int, form string, upos string")
    edges = spark.createDataFrame([("g", 2, 1, "amod"), ("g", 3, 2, "nsubj:pass"), ("g", 3, 4, "obj"), ("g", 3, 9, "obl"), ("g", 9, 4, "det"), ("h", 1, 2, "nsubj")], "graph string, gov int, dep int, reln string")
    found = open_triples(nodes, edges)
    assert [tuple(r) for r in found.collect()] == [("g", "Old Anna", "sees", "it")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # one plan held all joins before


def test_plan():
    assert plan(["entitymentions"]) == ["tokenize", "pos", "lemma", "docdate", "time", "ner", "entitymentions"]
    with pytest.raises(ValueError):
        plan(["nothing"])


def test_pipeline(spark):
    docs = spark.createDataFrame([(1, "Yesterday Anna Kit opened 3 gates. “Go,” said Bo.", "2031-03-12"), (2, None, None)], "doc_id bigint, text string, doc_date string")
    out = Pipeline({"annotators": "coref, quote"}).annotate(docs)
    assert [(r.text, r.speaker) for r in out["quotes"].collect()] == [("“Go,”", "Bo")]
    assert [(r.type, r.value) for r in out["times"].collect()] == [("DATE", "2031-03-11")]
    mentions = {(r.text, r.label) for r in out["mentions"].collect()}
    assert {("Yesterday", "DATE"), ("Anna Kit", "PERSON"), ("3", "NUMBER")} <= mentions
    lemmas = {r.word: r.lemma for r in out["tokens"].collect()}
    assert lemmas["opened"] == "open" and lemmas["gates"] == "gate"
    assert out["sentences"].count() == 2
    assert annotate_times(docs.limit(0)).count() == 0
