"""Leaked passages against brute-force alignment, and defined results."""

import random

from tessellex.llm.leakage import Codes, compare, item_sentences, leaked_documents, leaked_sentences, learn_units

NOUNS = "anvil beacon urn walnut kiln ferry mortar sluice turbine ledger orchard pulley".split()
VERBS = "carved oiled tilted mended greased hoisted".split()
PLACES = ["beside the tannery", "above the ravine", "along the towpath"]


def item(rng, k):
    a, b = (f"{x}{k}la Mo{y}ri".replace(str(k), "aeiou"[k % 5] + "bdfgk"[k // 5 % 5]) for x, y in rng.sample([("Ta", "n"), ("Ze", "l"), ("Ko", "v"), ("Pi", "s")], 2))
    n = lambda: rng.choice(NOUNS)
    one = f"Long before {a} {rng.choice(VERBS)} the {n()}, {b} {rng.choice(VERBS)} a dusty {n()} and a gilded {n()} {rng.choice(PLACES)} for {rng.randrange(10, 999)} coins."
    two = f"When {b} {rng.choice(VERBS)} the velvet {n()} {rng.choice(PLACES)}, {a} {rng.choice(VERBS)} exactly {rng.randrange(10, 999)} woven {n()} and one {n()}."
    return f"Read the passage below with care.\n{one} {two}\nQuestion: what did {a} keep?"


def edits(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def make():
    rng = random.Random(2)
    items = [(i, item(rng, i)) for i in range(25)]
    docs = []
    filler = "The postman ate a warm bun before the rain. My aunt opened the green gate because it was late. "
    for d in range(200):
        i, text = rng.choice(items)
        sentence = rng.choice(text.split("\n")[1].split(". ")) + "."
        kind = d % 6
        if kind == 1:
            sentence = sentence.lower()
        elif kind == 2:
            words = sentence.split()
            words.insert(rng.randrange(1, len(words)), "indeed")
            sentence = " ".join(words)
        elif kind == 3:
            sentence = " ".join(sentence.split()[: len(sentence.split()) // 2])
        elif kind == 4:
            sentence = "Read the passage below with care. Question: what did Tala keep?"
        elif kind == 5:
            sentence = sentence.replace("’", "'").replace("a", "а").replace(",", "")
        docs.append((d, filler + sentence + " " + filler))
    return items, docs


def tokens(text):
    return [c >> 2 for c in Codes().of(text).tolist()]


def test_against_alignment_of_all_pairs(spark):
    items, docs = make()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    sentences = item_sentences(bench, 5).collect()
    assert len(sentences) == 50
    got = {(r.doc_id, r.item_id) for r in leaked_sentences(spark.createDataFrame(docs, "doc_id bigint, text string"), bench).collect() if r.how == "same"}
    want = set()
    for d, text in docs:
        words = tokens(text)
        for s in sentences:
            if edits([Codes()[w] >> 2 for w in s.words], words) <= int(0.18 * len(s.words)):
                want.add((d, s.item_id))
    assert got == want and len(want) > 100


def test_renamed_sentences_are_told_apart(spark):
    items, _ = make()
    sentence = items[0][1].split("\n")[1].split(". ")[0]
    names = {w.strip(",.") for w in sentence.split() if w[0].isupper() and w != "Long"}
    other = sentence
    for n in names:
        other = other.replace(n, "Xu" + n[::-1].capitalize())
    other = "".join("7" if c.isdigit() else c for c in other)
    corpus = spark.createDataFrame([(1, "It was so. " + other + ". The end."), (2, "It was so. " + sentence + ". The end.")], "doc_id bigint, text string")
    found = {(r.doc_id, r.how) for r in leaked_sentences(corpus, spark.createDataFrame(items[:1], "item_id bigint, text string")).collect()}
    assert found == {(1, "renamed"), (2, "same")}
    # the same name must become the same other name
    code = Codes()
    row, mixed = code.of("While Ana met Bo the old Ana saw a lamp"), code.of("While Eva met Jo the old Ida saw a lamp")
    assert compare(row, mixed) is None and compare(row, code.of("While Eva met Jo the old Eva saw a lamp")) == ("renamed", 0)


def test_passages_that_many_items_share(spark):
    items, docs = make()
    passage = items[0][1].split("\n")[1]
    for n in (1, 3, 300):
        bench = spark.createDataFrame([(k, f"Read it with care.\n{passage}\nWhat is number {k} called?") for k in range(n)], "item_id bigint, text string")
        corpus = spark.createDataFrame([(7, "So it was. " + passage), (8, "Read it with care.")], "doc_id bigint, text string")
        assert sorted(tuple(r) for r in leaked_documents(corpus, bench).collect()) == [(7, k) for k in range(n)]
    short = spark.createDataFrame([(1, "The red fox ran home. It did.")], "item_id bigint, text string")
    assert [tuple(r) for r in leaked_documents(spark.createDataFrame([(3, "Yes, the RED fox ran home now!"), (4, "It did.")], "doc_id bigint, text string"), short).collect()] == [(3, 1)]


def test_units_are_learned(spark):
    rows = [(1, ["she", "walked", str(n), "furlongs", "north"], 0) for n in (3, 8, 44)] + [(1, ["the", "north", "wind"], 0)]
    assert learn_units(spark.createDataFrame(rows, "item_id bigint, words array<string>, key bigint")) == {"furlongs"}


def test_defined_results(spark):
    items, docs = make()
    rows = [(i, t, 0) for i, t in docs] + [(None, docs[0][1], 0), (900, None, 0), (901, "", 0), (902, docs[0][1] * 2000, 0), (0, docs[0][1], 0)]
    corpus = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([*items, *items[:3], (99, None), (None, "x"), (98, "")], "item_id bigint, text string")
    got = [tuple(r) for r in leaked_documents(corpus, bench).collect()]
    assert len(got) == len(set(got)) and any(d == 902 for d, _ in got) and not any(d in (None, 900, 901) for d, _ in got)
    assert leaked_sentences(corpus.limit(0), bench).count() == 0
    assert leaked_sentences(corpus, bench.limit(0)).count() == 0
