"""Sentence units: worked cases, coverage of random texts, learned statistics."""

import random

import pytest

from tessellex.llm import sentences
from tessellex.llm.sentences import _LATIN_WORD, _SCRIPTS, PeriodModel, Splitter, count_types, fit_periods, script_runs, sentence_units

TEXTS = {
    "en": ["Dr. Lamo Kit met Mr. Vone Tiki at 5 p.m. in town. They sold nails, etc. before noon. The cat in town sat by the stove.\n\nDr. Kit left."] * 30,
    "de": ["Am 7. März fand Hr. Nofi Zaluno z. B. Mehl. Die Katze schlief im Regen.\n\nIm Jahr 12. Die Frau kam am 7. März."] * 30,
    "ru": ["Проф. Тику Лезале ест хлеб и сыр. В г. Вельм идёт дождь, хлеб мокнет.\n\nПроф. Тику спит."] * 30,
    "hi": ["प्रो. तोजु बोनीवो गाता है। चाचा दौड़ता है।"] * 30,
}


@pytest.fixture(scope="module")
def splitter(spark):
    rows = [(i, t, k) for k, v in TEXTS.items() for i, t in enumerate(v)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    samples = spark.createDataFrame([("en", "the cat and they met before noon in town"), ("en", "they sat by the stove before noon"), ("de", "die frau und am im der katze"), ("de", "am abend kam die frau im regen")], "lang string, text string")
    return Splitter(fit_periods(docs, samples))


def units(splitter, text):
    return [text[a:b] for a, b in splitter.spans(text)]


def test_statistics_are_learned_per_language(splitter):
    model = splitter.model
    assert ("en", "dr") in model.abbreviations and not model.abbreviations[("en", "dr")][0]
    assert ("hi", "प्रो") in model.abbreviations and ("ru", "проф") in model.abbreviations
    assert ("de", "märz") in model.collocations
    assert ("en", "stove") not in model.abbreviations


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Kit met Mr. Tiki at 5 p.m. in town.", "They left 3.5 km later."],
        ["“Is it ready?” asked Lamo Kit.", "“A ship came.", "The crew slept.”", "He left."],
        ["„Halt! Keiner bewegt sich!“, rief Tiki.", "Am 7. März fand die Frau Mehl."],
        ["« Halte ! Personne ne bouge ! » a crié Kit.", "Il dort."],
        ["Проф. Тику ест хлеб.", "«Стой! Никому не двигаться!» — кричит Тику."],
        ["「準備はできた？」とラクは尋ねた。", "クデは「走った。」と書いた。", "だれが来たのか？"],
        ["托萨问道：“戈库煮了热汤。”", "面包师喂了母鸡。", "等了很久……于2点煮了汤。"],
        ["«هل هو جاهز؟» سأل سابو.", "العم يغني."],
        ["“क्या यह तैयार है?” बोता ने पूछा।", "चाचा दौड़ता है।"],
        ["She waited ... and then left!! 🎉", "(In the rain, he sang.)", "Done."],
    ],
)
def test_cases(splitter, parts):
    glue = "" if ord(parts[0][-1]) > 0x3000 else " "
    assert units(splitter, glue.join(parts)) == parts


def test_lines_and_blocks(splitter):
    text = "A heading\n\nFirst bare line\nSecond bare line\nThe cat sat by\nthe old stove in\nthe rain and then it\nslept.\r\n \t\r\nLast Final."
    assert units(splitter, text) == ["A heading", "First bare line", "Second bare line", "The cat sat by\nthe old stove in\nthe rain and then it\nslept.", "Last", "Final."]


def test_units_cover_all_but_white_space():
    rng = random.Random(11)
    alphabet = list("aB.!?。「」“”‘’\"«»„ \n\t\r,1") + [" ", "​", " ", "है", "।", "🎉", "...", "\n\n", "Mr.", ". "]
    splitter = Splitter(PeriodModel())
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))
        spans = splitter.spans(text)
        inside = {i for a, b in spans for i in range(a, b)}
        assert all(i in inside for i, c in enumerate(text) if not c.isspace()), text
        assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_defined_results(spark, splitter):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 0), (None, "One. Two.", 0), (4, "Same.", 0), (4, "Same.", 0), (5, "Long words here. " * 20_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, begin_char int")
    out = sentence_units(docs, splitter.model, with_text=True)
    assert {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()} == {None: 2, 4: 2, 5: 20_000}
    assert sentence_units(docs.limit(0), splitter.model).count() == 0


def test_given_cases(splitter):
    """No text: no unit; one sign: one unit."""
    assert splitter.spans(None) == [] and splitter.spans("") == [] and splitter.spans("x") == [(0, 1)]


def test_short_stretch_in_another_language_is_cut_by_its_own_rules():
    votes = {"und": "de", "et": "fr", "the": "en"}
    model = PeriodModel(votes=votes, abbreviations={("de", "nr"): (False, False)}, ordinary={("fr", "nr")}, anywhere={"nr": (False, False)})
    german, french = "Er kam und sah und ging zu Nr. Sieben und blieb.", "Elle et lui ont vu le nr. Puis il dort."
    text = "\n\n".join([german] * 100 + ["Sie kam zu Nr. Acht.", french])
    assert [text[a:b] for a, b in Splitter(model).spans(text)] == [german] * 100 + ["Sie kam zu Nr. Acht.", "Elle et lui ont vu le nr.", "Puis il dort."]
    counts = count_types(["这是一本书。" * 100 + "\n\nHe met the man Dr. Kit."], votes)
    assert counts[("en", "word", "dr")][0] == 1


def test_words_and_starters_count_without_a_period_too():
    votes = {"the": "en", "The": "en"}
    counts = count_types(["The cat sat", "The cat.\n\nthe cat sat\n\nThe dog!", "the cat. the dog."], votes)
    assert counts[("en", "word", "cat")] == [1, 2, 0, 0, 0, 1, 0, 0]
    assert counts[("en", "word", "the")][1] == 6 and counts[("en", "word", "the")][7] == 5
    assert counts[("en", "word", "dog")][:2] == [0, 1]
    assert counts[("en", "all", "")][1] == 14


def test_script_runs_are_those_of_the_patterns():
    rng = random.Random(11)
    signs = "aZé÷ßÿ жЖяё かカ漢字\u3400\u9fff\u4dff الؠ\u064a\u064b हि\u0963। 1.\n\U0001f600𠮷\ud800"
    for text in ["", "a", "漢", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(500))]:
        assert script_runs(text) == [len(p.findall(text)) for p in [*(p for _, p in _SCRIPTS), _LATIN_WORD]]


def test_language_is_not_asked_where_no_period_is(splitter, monkeypatch):
    texts = ["こんにちは。元気ですか？はい！", "Went they? Yes!\n\nНет! Да…"]
    known = [units(splitter, t) for t in texts]
    monkeypatch.setattr(sentences, "text_language", None)
    assert [units(splitter, t) for t in texts] == known == [["こんにちは。", "元気ですか？", "はい！"], ["Went they?", "Yes!", "Нет!", "Да…"]]
