"""Pieces against a plain reading of the text."""

import random
import re

from tessellex.llm.split import oversized_blocks, split_documents


def blocks_of(text):
    """Blocks by lines, as defined: runs of lines that aren't blank; U+2029 ends a block too."""
    out = []
    for part in text.split("\u2029"):
        current = []
        for line in re.split(r"\r?\n", part):
            if line.strip():
                current.append(line)
            elif current:
                out.append("\n".join(current))
                current = []
        if current:
            out.append("\n".join(current))
    return out


def random_text(rng):
    words = ["word", "löng", "x", "日本語。", "कि", "end.", "😀", "a" * rng.choice([5, 90]), "q,"]
    out = []
    for _ in range(rng.randrange(1, 40)):
        out.append(rng.choice(words))
        out.append(rng.choice([" ", " ", " ", "", "\n", "\r\n", "\n\n", "\r\n \t\r\n", "\u2029", "  ", " "]))
    return "".join(out)


def test_pieces_and_blocks(spark):
    rng = random.Random(3)
    texts = [random_text(rng) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    limit, overlap = 60, 12
    pieces = {}
    for r in split_documents(docs, limit, overlap).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, text in enumerate(texts):
        rows = sorted(pieces.get(doc_id, []), key=lambda r: r.piece_no)
        covered = set()
        for k, r in enumerate(rows):
            assert r.piece_no == k and text[r.begin_char : r.end_char] == r.text
            assert len(r.text) <= limit and r.overlap_chars <= overlap
            if k:
                assert r.begin_char + r.overlap_chars >= rows[k - 1].end_char and r.begin_char > rows[k - 1].begin_char
            covered |= set(range(r.begin_char, r.end_char))
        assert all(i in covered for i, c in enumerate(text) if not c.isspace())
    got = {tuple(r) for r in oversized_blocks(docs, limit, overlap).collect()}
    want = {(i, n) for i, t in enumerate(texts) for n, b in enumerate(blocks_of(t)) if len(b.strip()) > limit}
    # block_of joins lines with LF, so lengths are compared on texts without CR LF inside blocks
    plain = {i for i, t in enumerate(texts) if "\r\n" not in t}
    assert {x for x in got if x[0] in plain} == {x for x in want if x[0] in plain}


def test_defined_results(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (None, "tiny", "a"), (4, "same text here", "a"), (4, "same text here", "a"), (5, "z" * 50_000, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tiles string")
    out = split_documents(docs, 2000, 200)
    counts = {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {None: 1, 4: 2, 5: 28}
    assert {tuple(r) for r in oversized_blocks(docs).collect()} == {(5, 0)}
    assert split_documents(docs.limit(0)).count() == 0
