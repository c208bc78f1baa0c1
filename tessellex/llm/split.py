"""Cutting oversized texts into bounded, overlapping pieces, inside the JVM.

One regular expression tiles a text: white space between pieces, then the
longest run of whole paragraphs under the limit, then runs that end at a line,
a sentence, a word or a clause, and at last at a character. Bounded
quantifiers hold each run under the limit, greedy matching takes the latest
boundary of the strongest kind. Offsets are prefix sums over the matches; the
overlap is looked up in the end of the matches before a piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARAGRAPH = r"[^\S\n\x{2029}]*(?:\n[^\S\n]*\n|\x{2029})"
_SENTENCE = r"(?:(?<=[.!?؟।…]['\"\)\]»’”]{0,3})(?=\s+[^\s\p{Ll}])|(?<=[。！？][」』’”]{0,3})(?![」』’”，、]))"
_BLANK = r"(?sU)\A\s*\z"
_CLAUSE = r"(?<=[,;:、，；：،؛])"


def tile_pattern(limit: int, overlap: int) -> str:
    """The tiling expression: alternatives ordered by strength of boundary."""
    room = limit - overlap
    half = max(room // 2, 1)
    ends = [r"(?<=\S)(?=[^\S\n]*\n)", _SENTENCE, r"(?<=\S)(?=\s)", _CLAUSE]
    parts = [r"\s+", rf"\S.{{0,{limit - 1}}}(?<=\S)(?=\s*\z|{_PARAGRAPH})"]
    parts += [rf"\S.{{{half},{room - 1}}}{end}" for end in ends]
    parts += [rf"\S.{{0,{half - 1}}}{end}" for end in ends]
    parts += [rf"\S.{{0,{room - 1}}}(?![\p{{M}}\x{{200D}}])", rf"\S.{{0,{room - 1}}}"]
    return "(?sU)" + "|".join(parts)


def _running(values: Column, start: int = 0) -> Column:
    """Exclusive prefix sums of an integer array, one entry more than it has."""
    return F.aggregate(values, F.array(F.lit(start)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def cut_texts(docs: DataFrame, limit: int, overlap: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Tiles of every text: ``doc_id, tiles, begins, blocks`` (arrays).

    ``tiles`` cover the text without gaps, white-space runs included;
    ``begins`` are their offsets (code points), ``blocks`` the number of the
    block each begins in.
    """
    text = F.col(text_column)
    tiles = F.regexp_extract_all(text, F.lit(tile_pattern(limit, overlap)), F.lit(0))
    out = docs.select(F.col(id_column).alias("doc_id"), tiles.alias("tiles"))
    lengths = F.transform("tiles", lambda t: F.length(t))
    # a run of white space ends at most one block, none before the first one
    breaks = F.transform("tiles", lambda t, i: F.when((i == 0) & t.rlike(_BLANK), F.lit(0)).otherwise(F.regexp_count(t, F.lit(rf"(?sU){_PARAGRAPH}\s*"))))
    return out.select("doc_id", "tiles", _running(lengths).alias("begins"), _running(breaks).alias("blocks"))


def _tile_rows() -> Column:
    """Tiles with text as (tile, at, begin, block, whole): whole is false where a block is cut at the tile's end."""
    rows = F.transform(
        "tiles",
        lambda t, i: F.struct(
            t.alias("tile"),
            i.alias("at"),
            F.get("begins", i).alias("begin"),
            F.get("blocks", i).alias("block"),
            ((F.size("tiles") == i + 1) | F.coalesce(F.get("tiles", i + 1).rlike(_BLANK) & ((F.size("tiles") == i + 2) | F.get("tiles", i + 1).rlike(rf"(?sU){_PARAGRAPH}")), F.lit(False))).alias("whole"),
        ),
    )
    return F.filter(rows, lambda r: ~r["tile"].rlike(_BLANK))


def split_documents(docs: DataFrame, limit: int = 2000, overlap: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Ordered pieces of at most ``limit`` characters of every text.

    Result: ``doc_id, piece_no, begin_char, end_char, overlap_chars, block_no,
    whole, text``. A piece's text is the source between its offsets; it shares
    its first ``overlap_chars`` (up to ``overlap``) characters with what comes
    before. ``whole`` is false where the piece ends inside a block, which
    happens only to blocks longer than the limit.

    Nulls and texts without a visible character give no rows; a null id stays
    null. Repeated rows are cut each for itself, further columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    rows = cut_texts(docs, limit, overlap, id_column, text_column)
    rows = rows.select("doc_id", "tiles", F.posexplode(_tile_rows()).alias("piece_no", "row"))
    last, earlier = F.get("tiles", F.col("row.at") - 1), F.get("tiles", F.col("row.at") - 2)
    # what the piece before begins with stays its own, so pieces always advance
    before = F.when(F.col("piece_no") == 0, F.lit("")).when(last.rlike(_BLANK), F.concat(F.substring(earlier, 2, limit), last)).otherwise(F.substring(last, 2, limit))
    room = F.least(F.lit(overlap), F.lit(limit) - F.length("row.tile"))
    rows = rows.select("doc_id", "piece_no", "row", room.alias("room"), before.alias("before"))
    rows = rows.withColumn("before", F.when(F.col("room") > 0, F.right("before", F.col("room") + 1)).otherwise(F.lit("")))
    sentence = F.regexp_extract("before", r"(?sU)(?<=.)(?:(?<=[.!?؟।…\n]\s{1,4})|(?<=[。！？」』”]))\S.*\z", 0)
    word = F.regexp_extract("before", r"(?sU)(?<=\s)\S.*\z", 0)
    char = F.regexp_extract(F.expr("right(before, room)"), r"(?sU)[^\s\p{M}].*\z", 0)
    shared = F.when(sentence != "", sentence).when(word != "", word).otherwise(char)
    rows = rows.select("doc_id", "piece_no", "row", shared.alias("shared"))
    return rows.select(
        "doc_id",
        F.col("piece_no").cast("bigint").alias("piece_no"),
        (F.col("row.begin") - F.length("shared")).cast("bigint").alias("begin_char"),
        (F.col("row.begin") + F.length("row.tile")).cast("bigint").alias("end_char"),
        F.length("shared").cast("bigint").alias("overlap_chars"),
        F.col("row.block").cast("bigint").alias("block_no"),
        F.col("row.whole").alias("whole"),
        F.concat("shared", "row.tile").alias("text"),
    )


def oversized_blocks(docs: DataFrame, limit: int = 2000, overlap: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks that the cutting couldn't keep whole: ``doc_id, block_no``.

    Only texts over the limit can hold one. Same defined results as
    ``split_documents``; rows are distinct.
    """
    long = docs.where(F.length(text_column) > limit)
    rows = cut_texts(long, limit, overlap, id_column, text_column)
    broken = F.filter(_tile_rows(), lambda r: ~r["whole"])
    ended = F.transform(broken, lambda r: r["block"] + F.regexp_count(r["tile"], F.lit(rf"(?sU){_PARAGRAPH}\s*")))
    rows = rows.select("doc_id", F.explode(F.array_distinct(ended)).alias("block_no"))
    return rows.select("doc_id", F.col("block_no").cast("bigint").alias("block_no")).distinct()
