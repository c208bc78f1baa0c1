"""Tokens, sentences, stems, lemmas and spelling."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tessellex.operators.tokenize import TokenOptions, americanize, annotate_tokens, detokenize, lemma, split_sentences, stem, token_batches, token_counts, tokenize


def words(text, **options):
    return [t[0] for t in tokenize(text, TokenOptions(**options))]


@pytest.mark.parametrize(
    "text, want",
    [
        ("I can't, won't do it.", ["I", "ca", "n't", ",", "wo", "n't", "do", "it", "."]),
        ("Dr. Kit's 3.5% of $5", ["Dr.", "Kit", "'s", "3.5", "%", "of", "$", "5"]),
        ("See www.a.example/x or me@b.example.", ["See", "www.a.example/x", "or", "me@b.example", "."]),
        ("the U.S. team -- well-known ...", ["the", "U.S.", "team", "--", "well-known", "..."]),
        ("I cannot", ["I", "can", "not"]),
        ("“Hi!?” (no)", ["“", "Hi", "!?", "”", "(", "no", ")"]),
    ],
)
def test_tokens(text, want):
    assert words(text) == want


def test_options():
    assert words("(a)", ptb3_escaping=True) == ["-LRB-", "a", "-RRB-"]
    assert words("“x”", ascii_quotes=True) == ['"', "x", '"']
    assert words("a-b", split_hyphenated=True) == ["a", "-", "b"]
    assert words("a\nb", keep_newlines=True) == ["a", "*NL*", "b"]
    assert words("colour", americanize=True) == ["color"]
    assert detokenize(["He", "did", "n't", "pay", "$", "5", "-LRB-", "yes", "-RRB-", "."]) == "He didn't pay $5 (yes)."


def test_sentences():
    cut = lambda text, policy="NEVER": [" ".join(t) for t in ([text.split()[i] for i in range(a, b)] for a, b in split_sentences(text.split(), policy))]
    assert cut("a b . c d ! ? e") == ["a b .", "c d ! ?", "e"]
    assert cut('" a . " b .') == ['" a . "', "b ."]
    assert cut("a . ) b") == ["a . )", "b"]
    assert cut("a *NL* b", "ALWAYS") == ["a", "b"]
    assert cut("a *NL* b *NL* *NL* c", "TWO_CONSECUTIVE")[-1] == "c"
    assert cut("") == []


def test_text_is_rebuilt(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(list("ab.,'’$%5 \n-<>é日“”@")) for _ in range(rng.randrange(60))) for _ in range(200)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "Hi there. You.", 1)], "doc_id bigint, text string, tokens int")
    for r in annotate_tokens(docs).collect():
        text = "Hi there. You." if r.doc_id is None else texts[r.doc_id]
        if text is None:
            assert r.tokens is None
            continue
        if r.tokens:
            assert r.tokens[0].before + "".join(text[t.begin_char : t.end_char] + t.after for t in r.tokens) == text
        assert all(0 <= s.begin_token < s.end_token <= len(r.tokens) for s in r.sentences)
    assert annotate_tokens(docs.limit(0)).count() == 0


def test_counts_are_the_sizes_of_the_arrays(spark):
    texts = ["Dr. Kit can't. “Go,” she said.\n\nNo end", "a\n\n\nb", "", None, "我去。你也去。"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "A b."), (0, "A b.")], "doc_id bigint, text string")
    size = lambda a: None if a is None else len(a)
    for options in (TokenOptions(ascii_quotes=True), TokenOptions(keep_newlines=True)):
        want = [(r.doc_id, size(r.tokens), size(r.sentences)) for r in annotate_tokens(docs, options).collect()]
        assert [tuple(r) for r in token_counts(docs, options).collect()] == want
    assert want[3] == (3, None, None) and want[2] == (2, 0, 0)


def test_workers_hold_few_tokens_at_a_time():
    text = "the gate by the old mill was shut. " * 60
    batch = pa.RecordBatch.from_arrays([pa.array(range(250), pa.int64()), pa.array([text] * 250)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        sizes = [(b.num_rows, len(b.column(1).values)) for b in token_batches(iter([batch]))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(n for n, _ in sizes) == 250 and sum(t for _, t in sizes) == 250 * 60 * 9
    assert max(t for _, t in sizes) < 51_000 and most < 40_000_000  # as dicts at once they took 52 MB


def test_stems_lemmas_spelling():
    assert [stem(w) for w in "caresses ponies cats agreed plastered motoring conflated hopping happy relational vietnamization triplicate hopeful revival adjustment probate controll".split()] == "caress poni cat agre plaster motor conflat hop happi relat vietnam triplic hope reviv adjust probat control".split()
    assert [lemma(*x) for x in (("went", "VBD"), ("stopped", "VBD"), ("tied", "VBD"), ("cities", "NNS"), ("boxes", "NNS"), ("running", "VBG"), ("hoped", "VBD"), ("happier", "JJR"), ("Rivers", "NNPS"), ("opened", "VBD"))] == ["go", "stop", "tie", "city", "box", "run", "hope", "happy", "Rivers", "open"]
    assert [americanize(w) for w in "colour Theatre organised analyse catalogue travelled defence hour wise four".split()] == "color Theater organized analyze catalog traveled defense hour wise four".split()
