"""Tokenizer, token-level sentence splitter, stemmer, lemmatizer, spelling.

Rows are documents; one Arrow pass gives an array of token structs whose
offsets rebuild the text exactly (``before``/``after`` hold what lies between).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations that keep their period, and words split in two.
ABBREVIATIONS = "mr mrs ms dr prof st sr jr gen col lt sgt rev hon gov sen rep capt cmdr vs etc inc ltd co corp bros jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun no vol fig eq dept univ approx e.g i.e a.m p.m u.s u.k cf".split()
ASSIMILATIONS = {"cannot": 3, "gonna": 3, "gotta": 3, "gimme": 3, "lemme": 3, "wanna": 3}

_ASSIMILATED = {len(w) for w in ASSIMILATIONS}
_LONGEST = max(map(len, ABBREVIATIONS))
_ABBREVIATION = "|".join(sorted((re.escape(a) + r"\." for a in ABBREVIATIONS), key=len, reverse=True))
# plain: letters before a mark that no other kind of token goes on with, or before a period and too long for an
# abbreviation; point: marks that begin no other kind. The same tokens as without them ("word" and "any"), only sooner.
_TOKEN = re.compile(
    rf"(?P<plain>[^\W\d_]++(?![\w.+\-@:'’])|[A-Za-z]{{{_LONGEST + 1},}}+(?=\.(?:\s|\Z)))"
    r"|(?P<point>[,;:()\[\]\"“”、。，]|\.(?=\s|\Z))"
    r"|(?P<url>(?:https?://|www\.)[^\s<>\"]+[\w/]|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<tag></?[A-Za-z][^<>]*>)"
    rf"|(?P<abbr>(?=[^\W\d_]++\.)(?:\b(?i:{_ABBREVIATION})(?=\W|$)|(?:\b[^\W\d_]\.){{2,}}|\b[A-Z]\.(?=\s[A-Z])))"
    r"|(?P<num>[$£€]|\d+(?:[.,:/]\d+)*(?:st|nd|rd|th|s)?(?!\w)|\d+(?:[.,]\d+)*)"
    r"|(?P<clitic>(?<=\w)(?:n['’]t|['’](?:s|m|d|ll|re|ve))\b)"
    r"|(?P<word>[^\W\d_]+?(?=n['’]t\b)|[^\W_]+(?:[-'’_][^\W_]+)*?(?=['’](?:s|m|d|ll|re|ve)\b)|[^\W_]+(?:[-'’_][^\W_]+)*)"
    r"|(?P<dots>\.{2,}|…)|(?P<dash>--+|[–—])|(?P<mark>[!?]+)|(?P<any>\S)",
)

_SOONER = {"plain": "word", "point": "any"}

TOKEN_TYPE = "array<struct<idx:int,word:string,begin_char:int,end_char:int,before:string,after:string,kind:string>>"


@dataclass(frozen=True)
class TokenOptions:
    """Normalizations; the defaults leave the text as it is."""

    ptb3_escaping: bool = False
    ascii_quotes: bool = False
    normalize_spaces: bool = True
    americanize: bool = False
    keep_newlines: bool = False
    split_hyphenated: bool = False


def tokenize(text: str, options: TokenOptions = TokenOptions()) -> list[tuple[str, int, int, str]]:
    """(word, begin, end, kind) of each token of a text."""
    out: list[tuple[str, int, int, str]] = []
    at = 0
    for m in _TOKEN.finditer(text):
        if options.keep_newlines:
            _newlines(text, at, m.start(), out)
        word, (a, b), kind = m[0], m.span(), m.lastgroup
        if kind in _SOONER:
            kind = _SOONER[kind]
        if kind == "word" and len(word) in _ASSIMILATED and word.lower() in ASSIMILATIONS:
            k = ASSIMILATIONS[word.lower()]
            out += [(word[:k], a, a + k, kind), (word[k:], a + k, b, kind)]
        elif kind == "word" and options.split_hyphenated and "-" in word:
            for p in re.finditer(r"-|[^-]+", word):
                out.append((p[0], a + p.start(), a + p.end(), kind))
        else:
            out.append((word, a, b, kind))
        at = b
    if options.keep_newlines:
        _newlines(text, at, len(text), out)
    if options.ptb3_escaping or options.americanize:
        return [(_normal(w, options), a, b, k) for w, a, b, k in out]
    if options.ascii_quotes and not text.isascii():
        return [t if t[0].isascii() else (_normal(t[0], options), *t[1:]) for t in out]
    return out


def _newlines(text: str, begin: int, end: int, out: list[tuple[str, int, int, str]]) -> None:
    """Adds the newlines between two tokens."""
    while (begin := text.find("\n", begin, end)) >= 0:
        out.append(("*NL*", begin, begin + 1, "newline"))
        begin += 1


# Straight marks for quotation marks, escapes of brackets.
_QUOTES = str.maketrans("“”„«»‘’‚", "\"\"\"\"\"'''")
_ESCAPES = {"(": "-LRB-", ")": "-RRB-", "[": "-LSB-", "]": "-RSB-", "{": "-LCB-", "}": "-RCB-"}


def _normal(word: str, options: TokenOptions) -> str:
    if options.ptb3_escaping and word in _ESCAPES:
        return _ESCAPES[word]
    if options.ascii_quotes:
        word = word.translate(_QUOTES)
    if options.americanize:
        word = americanize(word)
    return word


def detokenize(words: list[str]) -> str:
    """Readable text of a token list."""
    text = " ".join({v: k for k, v in _ESCAPES.items()}.get(w, w) for w in words)
    text = re.sub(r" ([.,;:!?%)\]}]|n't|'(?:s|m|d|ll|re|ve)\b)", r"\1", text)
    return re.sub(r"([(\[{$£€]) ", r"\1", text)


_BOUNDARY = re.compile(r"[.。]|[!?！？]+")
_SPECIAL = frozenset("*.。!?！？")  # first letters of boundaries and newlines
_FOLLOWERS = re.compile(r"[\])}\"'”’»」』]|-R[RSC]B-|''")


def split_sentences(tokens: list[str], newline_policy: str = "NEVER", gaps: list[str] | None = None) -> list[tuple[int, int]]:
    """Token ranges of sentences.

    A boundary token ends a sentence; closing marks after it still belong to
    it, a straight quote only if it closes one. ``*NL*`` tokens are never part
    of a sentence: ALWAYS breaks at each, TWO_CONSECUTIVE at two in a row.
    """
    out: list[tuple[int, int]] = []
    begin, last_newline = None, False
    ended: int | None = None

    def close(end: int) -> None:
        nonlocal begin, ended
        if begin is not None and end > begin:
            out.append((begin, end))
        begin, ended = None, None

    for i, w in enumerate(tokens):
        if begin is not None and ended is None and w[:1] not in _SPECIAL:
            last_newline = False
            continue
        if w == "*NL*":
            if newline_policy == "ALWAYS" or newline_policy == "TWO_CONSECUTIVE" and last_newline:
                close(ended if ended is not None else i)
            last_newline = True
            continue
        if ended is not None:
            odd = w not in "\"'" or sum(t == w for t in tokens[begin:ended]) % 2 == 1
            if _FOLLOWERS.fullmatch(w) and not last_newline and odd:
                ended = i + 1
                last_newline = False
                continue
            if _BOUNDARY.fullmatch(w):
                ended = i + 1
                continue
            close(ended)
        if begin is None:
            begin = i
        if _BOUNDARY.fullmatch(w):
            ended = i + 1
        last_newline = False
    if begin is not None:
        end = len(tokens)
        while end > begin and tokens[end - 1] == "*NL*":
            end -= 1
        close(end)
    return out


# ---------------------------------------------------------------- stems, lemmas, spelling


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stemmer (M. F. Porter, 1980)."""
    w = word.lower()
    if len(w) <= 2 or not w.isalpha():
        return w

    def cons(s: str, i: int) -> bool:
        return s[i] not in "aeiou" and not (s[i] == "y" and i > 0 and cons(s, i - 1))

    def m(s: str) -> int:
        kinds = [cons(s, i) for i in range(len(s))]
        return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)

    vowel = lambda s: any(not cons(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and cons(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and cons(s, len(s) - 1) and not cons(s, len(s) - 2) and cons(s, len(s) - 3) and s[-1] not in "wxy"

    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    two = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
    three = dict(pair.split(":") for pair in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
    for table in (two, three):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if m(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or m(w[:-1]) == 1 and not cvc(w[:-1])):
        w = w[:-1]
    if m(w) > 1 and double(w) and w.endswith("l"):
        w = w[:-1]
    return w


# Irregular English forms as form:lemma.
IRREGULAR = dict(p.split(":") for p in "am:be are:be is:be was:be were:be been:be being:be has:have had:have having:have does:do did:do done:do went:go gone:go said:say made:make took:take taken:take came:come saw:see seen:see knew:know known:know got:get gave:give given:give found:find thought:think told:tell became:become left:leave felt:feel brought:bring began:begin begun:begin kept:keep held:hold wrote:write written:write stood:stand heard:hear met:meet paid:pay sat:sit spoke:speak spoken:speak led:lead grew:grow grown:grow lost:lose fell:fall fallen:fall sent:send built:build understood:understand drew:draw drawn:draw broke:break broken:break spent:spend ate:eat eaten:eat rose:rise risen:rise drove:drive driven:drive bought:buy wore:wear worn:wear chose:choose chosen:choose ran:run sang:sing sung:sing swept:sweep shut:shut hid:hide hidden:hide rode:ride ridden:ride tied:tie sold:sell weighed:weigh fed:feed men:man women:woman children:child feet:foot teeth:tooth mice:mouse people:person geese:goose better:good best:good worse:bad worst:bad".split())


@lru_cache(maxsize=1 << 16)
def lemma(word: str, tag: str = "") -> str:
    """Lemma of an English word by its tag; proper nouns keep their case."""
    if tag.startswith("NNP"):
        return word
    low = word.lower()
    if low in IRREGULAR and not (tag.startswith("JJ") and low == "left"):
        return IRREGULAR[low]
    if tag in ("NNS", "VBZ", "") and low.endswith("s") and len(low) > 3:
        if low.endswith("ies") and len(low) > 4:
            return low[:-3] + "y"
        if low.endswith(("sses", "shes", "ches", "xes", "zes")):
            return low[:-2]
        if not low.endswith(("ss", "us", "is")):
            return low[:-1]
    if tag in ("VBD", "VBN") and low.endswith("ed") and len(low) > 3:
        return _undo(low[:-2], low[:-1])
    if tag == "VBG" and low.endswith("ing") and len(low) > 4:
        return _undo(low[:-3], low[:-3] + "e")
    if tag in ("JJR", "JJS", "RBR", "RBS"):
        base = re.sub(r"(?:er|est)$", "", low)
        return base[:-1] + "y" if base.endswith("i") else base
    return low


def _undo(bare: str, with_e: str) -> str:
    if bare.endswith("i"):
        return bare[:-1] + "y"
    if len(bare) > 2 and bare[-1] == bare[-2] and bare[-1] not in "lsz":
        return bare[:-1]
    short = len(re.findall("[aeiouy]+", bare)) == 1
    if short and re.search("[^aeiou][aeiou][^aeiouwxy]$", bare):  # else the consonant would be doubled
        return with_e
    if re.search("(?:[^e]at|iz|ut|ur|[iuoa]s|ag|uc|[aeio]v|nc|rg|dg|rs|ns|[bcdgkpt]l|u|[aeiou]{2}[svzcg])$", bare):
        return with_e
    return bare


# British endings and their American counterparts, and words they don't hold for.
_SPELLING = [(r"our(s|ed|ing|ite|ites|able|al|ful|less)?$", r"or\1"), (r"(cent|met|theat|lit|fib|spect|somb|lust|meag)re(s|d)?$", r"\1er\2"), (r"(\w{2,})is(e|es|ed|ing|ation|ations|er|ers)$", r"\1iz\2"), (r"(anal|paral|catal)ys(e|es|ed|ing)$", r"\1yz\2"), (r"ogue(s)?$", r"og\1"), (r"(trave|cance|mode|labe|signa|leve|fue|jewe)ll(ed|ing|er|ers)$", r"\1l\2"), (r"(def|off|pret)ence$", r"\1ense")]
_KEEP = set("our hour hours four pour pours tour tours sour your yours flour detour contour glamour rise rises rising wise likewise otherwise exercise exercises exercised exercising surprise surprised surprising promise promises promised advise advised advises advising revise revised revises revising supervise supervised comprise comprised compromise compromised despise disguise disguised devise devised franchise improvise merchandise premise raise raised raises raising praise praised cruise cruised noise poise bruise arise arises arising vogue rogue rogues league leagues colleague colleagues tongue plague dialogue expertise enterprise enterprises excise televise televised concise precise paradise tortoise disease diseased tease".split())


@lru_cache(maxsize=1 << 16)
def americanize(word: str) -> str:
    low = word.lower()
    if len(low) < 4 or low in _KEEP:
        return word
    for pattern, to in _SPELLING:
        new = re.sub(pattern, to, low)
        if new != low:
            return new.capitalize() if word[:1].isupper() else new
    return word


# ---------------------------------------------------------------- over rows


#: Tokens, and letters of texts, of which a batch of results holds at least one and not many more than these.
_BATCH_TOKENS, _BATCH_LETTERS = 50_000, 1 << 20
_TOKEN_ARROW = pa.struct([("idx", pa.int32()), ("word", pa.string()), ("begin_char", pa.int32()), ("end_char", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("kind", pa.string())])
_SENTENCE_ARROW = pa.struct([("begin_token", pa.int32()), ("end_token", pa.int32())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None]]:
    """(id, text) of the rows, one at a time: batches may hold many long texts."""
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1)):
            yield key.as_py(), text.as_py()


def _split(text: str, options: TokenOptions, newline_policy: str) -> tuple[list[tuple[str, int, int, str]], list[tuple[int, int]]]:
    """Tokens of a text and its sentences as ranges of them; newlines count as tokens only if the options say so."""
    found = tokenize(text, TokenOptions(**{**options.__dict__, "keep_newlines": True}))
    ranges = split_sentences([t[0] for t in found], newline_policy)
    if options.keep_newlines or "\n" not in text:
        return found, ranges
    place, tokens = [], []
    for t in found:
        place.append(len(tokens))
        if t[3] != "newline":
            tokens.append(t)
    place.append(len(tokens))
    return tokens, [(place[a], place[b]) for a, b in ranges]


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))


def token_batches(batches: Iterator[pa.RecordBatch], options: TokenOptions = TokenOptions(), newline_policy: str = "TWO_CONSECUTIVE") -> Iterator[pa.RecordBatch]:
    """Rows of ``annotate_tokens`` for batches of (id, text)."""

    def made() -> pa.RecordBatch:
        last = lambda at, ends: pa.array([*at, ends], pa.int32())
        values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _TOKEN_ARROW)], fields=list(_TOKEN_ARROW))
        spans = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in bounds], fields=list(_SENTENCE_ARROW))
        arrays = [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(last(token_at, len(columns[0])), values), pa.ListArray.from_arrays(last(sentence_at, len(bounds[0])), spans)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "tokens", "sentences"])

    keys, token_at, sentence_at, columns, bounds, letters = [], [], [], [[] for _ in _TOKEN_ARROW], [[], []], 0
    for key, text in _pairs(batches):
        keys.append(key)
        if text is None:
            token_at.append(None)
            sentence_at.append(None)
        else:
            tokens, ranges = _split(text, options, newline_policy)
            token_at.append(len(columns[0]))
            sentence_at.append(len(bounds[0]))
            begins, ends = [t[1] for t in tokens], [t[2] for t in tokens]
            gaps = [text[a:b] for a, b in zip([0, *ends], [*begins, len(text)])]
            for column, new in zip(columns, (range(len(tokens)), [t[0] for t in tokens], begins, ends, gaps[:-1], gaps[1:], [t[3] for t in tokens])):
                column.extend(new)
            for bound, new in zip(bounds, zip(*ranges)):
                bound.extend(new)
            letters += len(text)
        if len(columns[0]) >= _BATCH_TOKENS or letters >= _BATCH_LETTERS or len(keys) >= 10_000:
            yield made()
            keys, token_at, sentence_at, columns, bounds, letters = [], [], [], [[] for _ in _TOKEN_ARROW], [[], []], 0
    if keys:
        yield made()


def annotate_tokens(docs: DataFrame, options: TokenOptions = TokenOptions(), newline_policy: str = "TWO_CONSECUTIVE", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, tokens, sentences``: tokens with offsets, sentence token ranges.

    A null text has null arrays, an empty one empty arrays; repeated rows and
    null ids are kept; further columns are ignored. Workers hold the tokens of
    one text, or of some 50,000 tokens of short ones, at a time.
    """
    schema = f"doc_id bigint, tokens {TOKEN_TYPE}, sentences array<struct<begin_token:int,end_token:int>>"

    return _texts(docs, id_column, text_column).mapInArrow(lambda batches: token_batches(batches, options, newline_policy), schema)


def capital_tokens(docs: DataFrame, options: TokenOptions = TokenOptions(), newline_policy: str = "TWO_CONSECUTIVE", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, sentence, idx, word, begin_char, end_char`` of the tokens that begin with a capital letter."""
    names, kinds = ["doc_id", "sentence", "idx", "word", "begin_char", "end_char"], [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        columns: list[list] = [[] for _ in names]
        for key, text in _pairs(batches):
            tokens, ranges = _split(text or "", options, newline_policy)
            for sentence, (first, end) in enumerate(ranges):
                for i in range(first, end):
                    word, a, b, _ = tokens[i]
                    if word[0].isupper():
                        for column, value in zip(columns, (key, sentence, i, word, a, b)):
                            column.append(value)
            if len(columns[0]) >= _BATCH_TOKENS:
                yield made()
                columns = [[] for _ in names]
        yield made()

    return _texts(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, sentence int, idx int, word string, begin_char int, end_char int")


def token_counts(docs: DataFrame, options: TokenOptions = TokenOptions(), newline_policy: str = "TWO_CONSECUTIVE", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, tokens, sentences``: the sizes of the arrays of ``annotate_tokens``, without making them; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in _pairs(iter([batch])):
                tokens, ranges = _split(text, options, newline_policy) if text is not None else (None, None)
                rows.append((key, None, None) if tokens is None else (key, len(tokens), len(ranges)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["doc_id", "tokens", "sentences"])

    return _texts(docs, id_column, text_column).mapInArrow(run, "doc_id bigint, tokens bigint, sentences bigint")
