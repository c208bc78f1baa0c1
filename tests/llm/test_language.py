"""Language detection: network against its direct form, held-out accuracy, defined results."""

import re

import duckdb
import numpy as np
import pytest

from tessellex.llm.language import NONE, WIDTHS, WINDOW, Detector, document_languages, fit_languages, language_segments, parse_label, text_units, to_windows, train_network, training_windows, wrongly_labelled

DATA = "/root/testdata/sf0.001"


def samples():
    rows = duckdb.sql(f"select lang, text from '{DATA}/lang_samples.parquet' order by sample_id").fetchall()
    return sorted((parse_label(a), t) for a, t in rows)


@pytest.fixture(scope="module")
def trained():
    rows = samples()
    train = [r for i, r in enumerate(rows) if i % 5]
    languages = (*sorted({k for k, _ in rows}), NONE)
    windows, targets = training_windows(train, languages)
    net, par = train_network(windows, targets, languages, epochs=14)
    return net, par, [r for i, r in enumerate(rows) if i % 5 == 0]


def test_labels():
    assert [parse_label(x) for x in ("en_GB", "English", "ger", "zh-Hans", "FR", "jpn")] == ["en", "en", "de", "zh", "fr", "ja"]
    assert [parse_label(x) for x in (None, "", "und", "N/A", "xx", "unknown")] == [None] * 6
    assert parse_label("pt-BR") == "?pt"


def test_lookup_tables_equal_direct_convolution(trained):
    net, par, held = trained
    windows, _ = to_windows([t[:200] for _, t in held[:20]])
    got = net.log_probabilities(windows)
    feats = []
    for w in WIDTHS:
        e = par["emb"][windows]
        acc = sum(e[:, j : j + WINDOW - w + 1] @ par[f"k{w}"][j] for j in range(w))
        feats.append(np.maximum(acc.max(1) + par[f"b{w}"], 0))
    logits = np.concatenate(feats, 1) @ par["out"] + par["ob"]
    want = logits - np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True)
    assert np.abs(got - want).max() < 0.2 and (got.argmax(1) == want.argmax(1)).all()


def test_held_out_accuracy(trained):
    net, _, held = trained
    found = Detector(net).segments([t for _, t in held])
    right = sum(s and max(s, key=lambda x: x[1] - x[0])[2] == lang for s, (lang, _) in zip(found, held))
    assert right >= 0.95 * len(held)


def test_windows_cover_all_bytes():
    text = "añ日" * 200
    windows, owner = to_windows([text, "x", ""])
    assert (owner == 1).sum() == (owner == 2).sum() == 1
    assert (owner == 0).sum() == -(-len(text.encode()) // WINDOW)
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in text_units(text))) == text


def test_defined_results(spark):
    source = spark.read.parquet(f"{DATA}/lang_samples.parquet").select("lang", "text")
    net = fit_languages(source, epochs=(30, 1))
    english = "The postman ate a warm bun in the rain and the teacher opened the green gate. "
    german = "Der alte Fischer saß am Ofen und die Lehrerin kochte heiße Suppe am Sonntag. "
    rows = [
        (1, english * 3, "en"),
        (2, english * 3, None),
        (3, english * 3, "Chinese"),
        (4, english * 3 + german * 2, "en-US"),
        (5, None, "en"),
        (6, "", None),
        (7, "aGVsbG8gd29ybGQ" * 20, None),
        (8, german, "de"),
        (8, german, "de"),
        (None, german, "fr"),
        (9, english * 5000, "en"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, lang string, confidence string")
    found = sorted(((r.doc_id, r.lang) for r in wrongly_labelled(document_languages(docs, net)).collect()), key=str)
    assert found == sorted([(2, "en"), (3, "en"), (4, "en"), (4, "de"), (None, "de")], key=str)
    segments = language_segments(docs, net).collect()
    assert [(r.lang, r.segment_no) for r in sorted(segments, key=lambda r: r.segment_no) if r.doc_id == 4] == [("en", 0), ("de", 1)]
    assert {r.lang for r in segments if r.doc_id == 7} == {NONE}
    assert not [r for r in segments if r.doc_id in (5, 6)]
    assert all(0 <= r.confidence <= 1 for r in segments)
    assert language_segments(docs.limit(0), net).count() == 0
