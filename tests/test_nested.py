"""Nested records against a plain recursive reading of the parsed JSON."""

import json
import random

from tessellex.operators.nested import ANNOTATION_LEVELS, StructuralIndex, _Walker, distinct_links, flat_tables, nested_rows

KINDS = frozenset(x.kind for x in ANNOTATION_LEVELS)


def walk(texts, kinds=KINDS, fields=True):
    return _Walker(ANNOTATION_LEVELS, kinds, fields).run(list(range(len(texts))), [t.encode() for t in texts])


def fold(value):
    if isinstance(value, dict):
        return {k.replace("_", "").lower(): fold(v) for k, v in value.items()}
    if isinstance(value, list):
        return [fold(v) for v in value]
    if isinstance(value, str) and value[:1] in ("[", "{"):
        return fold(json.loads(value))
    return value


def rows_of(value):
    return [value] if isinstance(value, dict) else [v for v in value or [] if isinstance(v, dict)]


def brute(record, text):
    doc = fold(json.loads(text))
    doc = doc.get("document", doc)
    number = lambda v: 0 if v is None else int(v)
    chains = doc.get("corefchain")
    if isinstance(chains, dict) and chains and all(k.isdigit() for k in chains):
        chains = [v | {"chainid": v.get("chainid", k)} for k, v in chains.items()]
    out = set()
    for c in rows_of(chains):
        out |= {(record, "coref_mention", number(m.get("mentionid")), "chain", number(c.get("chainid"))) for m in rows_of(c.get("mention"))}
    out |= {(record, "entity_mention", number(m.get("entitymentionindex")), "sentence", number(m.get("sentenceindex"))) for m in rows_of(doc.get("mentions"))}
    for s in rows_of(doc.get("sentence")):
        out |= {(record, "entity_mention", number(m.get("entitymentionindex")), "sentence", number(s.get("sentenceindex"))) for m in rows_of(s.get("mentions"))}

    def quotes(q, parent):
        own = number(q.get("index"))
        out.add((record, "quote", own, *(("quote", parent) if parent is not None else ("sentence", number(q.get("sentencebegin"))))))
        for inner in rows_of(q.get("quote")):
            quotes(inner, own)

    for q in rows_of(doc.get("quote")):
        quotes(q, None)
    return out


def random_payload(rng):
    text = rng.choice(["plain", 'a "quoted" [x] {y}', "back\\slash", "\\\"", "日本:,"])
    mention = lambda i: {k: v for k, v in {"mentionID": rng.choice([i, str(i)]), "endIndex": 2}.items() if rng.random() < 0.8}
    chains = [{"chainID": i, "mention": rng.choice([[mention(1), mention(2)], mention(3)])} for i in range(rng.randrange(3))]
    if rng.random() < 0.3:
        chains = {str(c["chainID"] + 4): {"mention": c["mention"]} for c in chains} or []
    entity = lambda i: {k: v for k, v in {"entityMentionIndex": i, "sentenceIndex": rng.randrange(3), "timex": {"value": text}}.items() if rng.random() < 0.8}
    sentences = [{"sentenceIndex": i, "token": [{"word": text}], "mentions": [entity(9)]} for i in range(rng.randrange(1, 3))]
    quotes = [{"index": 1, "text": text, "sentenceBegin": 2, "quote": [{"index": 2, "quote": {"index": 3}}]}, {"text": "“x”"}]
    doc = {"text": text, "sentence": sentences, "corefChain": chains, "mentions": [entity(i) for i in range(rng.randrange(3))], "quote": rng.choice([quotes, None, quotes[0]])}
    for key in ("corefChain", "mentions", "quote"):
        if rng.random() < 0.2 and doc[key]:
            doc[key] = json.dumps(doc[key])
    if rng.random() < 0.3:
        doc = {"coref_chain": doc.pop("corefChain"), **doc}
    if rng.random() < 0.3:
        doc = {"document": doc}
    return json.dumps(doc, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": ")]))


def test_random_records_match_recursive_reading():
    rng = random.Random(7)
    texts = [random_payload(rng) for _ in range(400)]
    got = {r[:5] for r in walk(texts, frozenset(("coref_mention", "entity_mention", "quote")), False)}
    want = set().union(*(brute(i, t) for i, t in enumerate(texts)))
    assert got == want


def test_cut_off_payloads_are_incomplete():
    text = json.dumps({"text": 'say "x"', "quote": [{"index": 1}]})
    index = StructuralIndex.build([text[:i].encode() for i in range(len(text) + 1)])
    assert index.complete.tolist() == [False] * len(text) + [True]


def test_defined_results_for_odd_rows(spark):
    good = '{"sentence":[{"token":[{"word":"a","lemma":null}],"extra":1}],"quote":{"text":"q"}}'
    rows = [(1, None, 5), (2, "", 5), (3, "not json", 5), (None, good, 5), (4, good, 5), (4, good, 6), (5, "[]", 5), (6, "\ufeff" + good, 5)]
    source = spark.createDataFrame(rows, "record_id bigint, payload string, child_id int")
    out = nested_rows(source)
    links = {tuple(r) for r in distinct_links(out).collect()}
    assert {(r[0], r[1]) for r in links} == {(i, k) for i in (None, 4, 6) for k in ("sentence", "token", "quote")}
    assert out.where("record_id = 4").count() == 6
    tables = flat_tables(out)
    assert tables["token"].where("record_id = 4").collect()[0].word == "a"
    assert tables["token"].where("record_id = 4").collect()[0].lemma is None
    assert nested_rows(source.limit(0)).count() == 0


def test_long_record_is_indexed_whole():
    sentences = [{"sentenceIndex": i, "token": [{"word": "w" * 50}] * 20} for i in range(3000)]
    rows = walk([json.dumps({"sentence": sentences})], frozenset(("sentence",)), False)
    assert [r[2] for r in rows] == list(range(3000))


def test_fields_of_snake_case_entity_mentions():
    mention = {"token_start_in_sentence_inclusive": 3, "token-end-in-sentence-exclusive": 5, "NER": "PER", "__entity__mention__text__": "Anna Kit", "entityType": "X", "token_start": 9}
    rows = walk([json.dumps({"mentions": [mention]})], frozenset(("entity_mention",)))
    assert [r[6] for r in rows] == [{"tokenstartinsentenceinclusive": "3", "tokenendinsentenceexclusive": "5", "ner": "PER", "entitymentiontext": "Anna Kit", "entitytype": "X"}]
