"""Canonical form: splicing against whole-text normalization, and pairs."""

import itertools
import random
import unicodedata

from tessellex.llm.canonical import canonical_text, normalize_segments, reading_classes, reading_key, reading_keys, reading_pairs


def test_spliced_equals_whole_normalization():
    """Without compatibility forms the splice must equal NFC of the whole."""
    rng = random.Random(5)
    alphabet = ["a", "e", "́", "̈", "̧", "é", "क", "़", "्", "क़", "ᄀ", "ᅡ", "ᆨ", "가", " ", "̈́", "ẛ̣"[1], "う", "゙", "ا", "ٔ", "Å"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert normalize_segments(text) == unicodedata.normalize("NFC", text)


def test_forms_that_read_the_same():
    same = [
        ("Ｆｉｇ １２", "Fig 12"),
        ("café\u00a0x", "café x"),
        ("so\u200bft\u00adly\u2060", "softly"),
        ("ﬁne ﬃ", "fine ffi"),
        ("⼈⼤", "人大"),
        ("كﻻ", "كلا"),
        ("pаper Тhe", "paper The"),
        ("Маma", "Mama"),
        ("King", "King"),
        ("が", "が"),
    ]
    for a, b in same:
        assert reading_key(a) == reading_key(b) and canonical_text(a) == canonical_text(b) == b, (a, b)
    assert canonical_text("Mаленькая cоседка") == "Маленькая соседка"


def test_forms_that_stay_apart():
    apart = ["The", "the", "café", "cafe", "“x”", '"x"', "x2", "x²", "a b", "b a", "l1", "11", "Straße", "Strasse", "ещё", "еще"]
    for a, b in itertools.combinations(apart, 2):
        assert reading_key(a) != reading_key(b), (a, b)


def test_emoji_joiners_stay():
    family = "\U0001f468\u200d\U0001f469"
    assert normalize_segments("x\u200dy " + family) == "xy " + family


def test_pairs_against_all_pairs(spark):
    rng = random.Random(9)
    base = ["one two", "The cat", "Мама мыла", "café"]
    change = [lambda t: t, lambda t: t.replace(" ", "\u2009"), lambda t: unicodedata.normalize("NFD", t), lambda t: t.replace("a", "а"), lambda t: t + "\u200b", str.upper]
    texts = [rng.choice(change)(rng.choice(base)) for _ in range(80)] + [None, "", ""]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, key string")
    got = [tuple(r) for r in reading_pairs(docs, part_rows=3, part_texts=2).collect()]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and reading_key(texts[a]) == reading_key(texts[b])}
    assert len(got) == len(set(got)) and set(got) == want and want
    assert reading_pairs(docs.limit(0)).count() == 0 and reading_classes(docs.limit(0)).count() == 0
    classes = [tuple(r) for r in reading_classes(docs).collect()]
    members = {}
    for d, c, _ in classes:
        members.setdefault(c, set()).add(d)
    assert {(a, b) for m in members.values() for a, b in itertools.combinations(sorted(m), 2) if texts[a] != texts[b]} == want
    assert reading_keys(docs).count() == len(texts) - 1


def test_long_text_whole():
    text = "word é " * 100_000
    assert canonical_text(text + "é") == text + "é"


def test_a_script_far_away_decides():
    text = "Жизнь " + "1 " * 100 + "АСЕ"
    assert canonical_text(text) == text == canonical_text(text.replace("АСЕ", "ACE"))
