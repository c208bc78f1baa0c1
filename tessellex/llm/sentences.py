"""Sentence units in all scripts, with periods classified by learned statistics.

First pass: per language, every word that stands before a period is counted
with and without it and by what follows, as are the words after numbers and
the words that open lines. Log-likelihood ratios over these counts give
abbreviations, collocations across a period and frequent sentence starters,
without any labelled text. Second pass: blocks, lines and quotations bound the
text, and each period is classified with the learned statistics.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellex.llm.canonical import _FOREIGN, _TO_LATIN, normalize_segments
from tessellex.session import collect_bounded, cut_lineage

_INVISIBLE = "\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe0f\ufeff"
_SYMBOL = "\u2190-\u21ff\u2300-\u23ff\u2460-\u27bf\u2900-\u2bff\U0001f000-\U0001faff\ufe0f\u200d"
_UNSEEN = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_THIN = " \u00a0\u2002\u2007\u2009\u202f"
_STRONG = "!?…。！？।॥؟۔．｡\u203c\u2047-\u2049"
_CLOSE = "\"”“’‘»«\u203a\u2039」』)\\]）］}】〕"
_OPEN = "\"“”„‘‚«»\u2039\u203a「『(\\[（{【¿¡"

_CANDIDATE = re.compile(rf"[.{_STRONG}][.{_STRONG}{_INVISIBLE}]*")
_TAIL_SYMBOLS = re.compile(rf"[^\S\n]*(?:[{_SYMBOL}]+[^\S\n]*)*[{_SYMBOL}]+|[{_INVISIBLE}]+")
_ENDS_CLOSED = re.compile(rf"[.{_STRONG}][{_CLOSE}{_SYMBOL}{_INVISIBLE}\s]*\Z")
_QUOTE = re.compile("[\"“”„«»‘’‚\u2039\u203a「」『』]")
_BLOCK = re.compile(r"(?:\u2029|\n(?=[^\S\n]*[\n\u2029]))\s*")
_LINE = re.compile(r"[\n\u2028][^\S\n]*")
_FIRST = re.compile(rf"[\s{_INVISIBLE}{_OPEN}—–-]*")
_OPEN_SIGNS = _OPEN.replace("\\", "")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\S{31,}")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

# Verbs that report speech, for scripts whose next word has no case.
_REPORT = re.compile(
    "^[^。！？]{0,40}(?:道|说|說|回答|答)(?:[。，！]|\\s*$)"  # zh
    "|^(?:と|って)|^[^。！？]{0,30}はと"  # ja
    "|^[^।!?]{0,60}ने (?:पूछा|कहा|उत्तर|चिल्ला|बताया|फुसफुसा)"  # hi
    "|^[^।!?]{0,60}(?:चिल्लाया|पुकारा|फुसफुसाया|बोला)"
    "|^(?:سأل|قال|همس|صاح|أجاب|رد|صرخ)"  # ar
)

_SCRIPTS = (
    ("ja", re.compile("[\u3040-\u30ff]+")),
    ("zh", re.compile("[\u3400-\u9fff]+")),
    ("ru", re.compile("[бвгджзийклмнптфцчшщъыьэюя]+")),
    ("ar", re.compile("[\u0620-\u064a]+")),
    ("hi", re.compile("[\u0900-\u0963]+")),
)
_EAST = re.compile("[\u0400-\u9fff]")
_UPPER = re.compile("[A-Z\u00c0-\u00de\u0391-\u03a9\u0400-\u042f\uff21-\uff3a]")
_SCRIPT_NAMES = tuple(name for name, _ in _SCRIPTS)
_OWN_SCRIPT = frozenset(_SCRIPT_NAMES)
_LATIN_WORD = re.compile("[a-zß-ÿ]+")
#: By UTF-16 unit: place from 1 in _SCRIPTS, after these small Latin letters, else 0.
_SIGN_SCRIPT = np.zeros(1 << 16, np.uint8)
for _place, _pattern in enumerate([*(p for _, p in _SCRIPTS), _LATIN_WORD], 1):
    for _run in _pattern.finditer("".join(map(chr, range(0xD800)))):
        _SIGN_SCRIPT[slice(*_run.span())] = _place


@dataclass
class PeriodModel:
    """What was learned; ``votes`` are words that tell Latin languages apart."""

    votes: dict[str, str] = field(default_factory=dict)
    #: (language, type) -> (can end a sentence, stands before numbers)
    abbreviations: dict[tuple[str, str], tuple[bool, bool]] = field(default_factory=dict)
    ordinary: set[tuple[str, str]] = field(default_factory=set)
    collocations: set[tuple[str, str]] = field(default_factory=set)
    starters: set[tuple[str, str]] = field(default_factory=set)
    anywhere: dict[str, tuple[bool, bool]] = field(default_factory=dict)

    def abbreviation(self, lang: str, kind: str) -> tuple[bool, bool] | None:
        found = self.abbreviations.get((lang, kind))
        if found is None and (lang, kind) not in self.ordinary:
            found = self.anywhere.get(kind)
        return found


def language_votes(samples: list[tuple[str, str]]) -> dict[str, str]:
    """Words of one Latin-script language only, from the labelled samples."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for lang, text in samples:
        for word in set(_LATIN_WORD.findall(text)):
            seen[word][lang] += 1
    votes = {}
    for word, by in seen.items():
        (lang, n), *rest = by.most_common(2)
        if n >= 2 and (not rest or n >= 8 * rest[0][1]):
            votes[word] = lang
    return votes


def script_runs(text: str) -> list[int]:
    """How many runs of signs of each of ``_SCRIPTS`` a text holds, then of small Latin letters."""
    signs = _SIGN_SCRIPT.take(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2"))
    starts = signs[np.flatnonzero(signs[1:] != signs[:-1]) + 1]
    runs = np.bincount(starts, minlength=len(_SCRIPTS) + 2)
    runs[signs[:1]] += 1
    return runs[1:].tolist()


def text_language(text: str, tokens: list[str], votes: dict[str, str]) -> tuple[str, bool]:
    """Language by script, then by the words that only one language has.

    Also tells whether the text holds nothing that speaks for another one.
    """
    tally: Counter = Counter()
    latin = 1
    if not text.isascii() and _EAST.search(text):
        *runs, latin = script_runs(text)
        counts = Counter(dict(zip(_SCRIPT_NAMES, runs)))
        if counts["ja"] * 8 > counts["zh"]:
            counts["ja"] += counts.pop("zh", 0)
        elif counts["ja"]:
            counts["zh"] += counts.pop("ja", 0)
        tally.update({k: n for k, n in counts.items() if n})
    if not tally or len(tally) > 1 or latin:
        if not text.isascii() and _FOREIGN.search(text):  # look-alike letters
            tokens = [t if t.isascii() else t.translate(_TO_LATIN) for t in tokens]
        tally.update(filter(None, map(votes.get, tokens)))
    if not tally:
        return "xx", True
    return tally.most_common(1)[0][0], len(tally) == 1


def block_language(block: str, tokens: list[str], votes: dict[str, str], main: str) -> str:
    """Language of a block; that of its text where nothing in it votes and the text is Latin."""
    lang = text_language(block, tokens, votes)[0]
    return main if lang == "xx" and main not in _OWN_SCRIPT else lang


def _follows(text: str, at: int) -> str:
    """Kind of the first sign after a place: upper, lower, digit, word, other, end."""
    char = text[at : at + 1]
    if char == " ":
        at += 1
        char = text[at : at + 1]
    if not char.isalnum():
        at = _FIRST.match(text, at).end()
        if at >= len(text):
            return "end"
        char = text[at]
    if char.isalpha():
        return "upper" if char.isupper() or char.istitle() else "lower" if char.islower() else "word"
    return "digit" if char.isdigit() else "other"


@lru_cache(maxsize=65536)
def _type(token: str, latin: bool = True) -> str:
    """The type a token before a period counts as."""
    if not token.isascii():
        token = normalize_segments(token)
        if latin:
            token = token.translate(_TO_LATIN)
    token = token.strip("\"'“”’‘«»()[],;:")
    if token.isdigit():
        return "#" if len(token) <= 2 else "##"
    if not token.isalpha() and any(c.isdigit() for c in token):
        return "##"
    return token if len(token) == 1 else token.lower()


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Offsets of the blocks, without white space at their ends."""
    lo = 0
    for match in [*_BLOCK.finditer(text), None]:
        a, b = lo, len(text) if match is None else match.start()
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            yield a, b
        if match:
            lo = match.end()


def _full(line: str, after: str, width: int) -> bool:
    """Whether a wrapping writer had no room for the next line's first word."""
    words = after.split(None, 1)
    if len(words) < 2 and len(line.split(None, 1)) < 2 or _CJK.match(after[:1] or " "):
        return len(line) >= width - 1
    return len(line) + 1 + len(words[0] if words else "") > width


def _segments(block: str) -> Iterator[tuple[int, int]]:
    """Parts of a block between line breaks that end a unit.

    A break is inside a sentence if the line isn't closed and goes on in lower
    case or after a comma, or if all lines of the block are filled to one width.
    """
    breaks = list(_LINE.finditer(block)) if "\n" in block or "\u2028" in block else ()
    if not breaks:
        yield 0, len(block)
        return
    edges = [0, *(m.end() for m in breaks), len(block)]
    ends = [*(m.start() for m in breaks), len(block)]
    lines = [block[a:b].rstrip() for a, b in zip(edges, ends)]
    if all(_ENDS_CLOSED.search(line[-16:]) for line in lines[:-1]):
        yield 0, len(block)
        return
    width = max(map(len, lines))
    # filled by a wrapping writer: no line had room for the next one's first word
    filled = all(_full(a, b, width) for a, b in zip(lines, lines[1:]))
    cased = _UPPER.search(block) is not None
    flow = sum(1 for a, b in zip(lines, lines[1:]) if not _ENDS_CLOSED.search(a[-16:]) and _follows(b, 0) == "lower" and not _RUN.fullmatch(b.split(None, 1)[0] if b else ""))
    wrapped = filled and (len(lines) >= 4 or flow > 0) and width <= 200
    start = 0
    for i, match in enumerate(breaks):
        line, after = lines[i], lines[i + 1]
        if _ENDS_CLOSED.search(line[-16:]):
            continue
        last = line[-1:]
        kind = _follows(after, 0)
        runs = bool(_RUN.fullmatch(line.strip())) and not _CJK.search(line) or bool(_RUN.fullmatch(after.strip())) and not _CJK.search(after)
        soft = not runs and (wrapped or (kind == "lower" and cased) or last in ",;،，、；؛")
        if not soft:
            yield start, match.start()
            start = match.end()
    yield start, len(block)


def _quotes(text: str) -> list[tuple[int, int]]:
    """Spans of matched quotations (opening mark to after the closing one)."""
    stack: list[tuple[str, int]] = []
    spans = []

    def close(at: int, marks: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in marks:
                spans.append((stack[k][1], at + 1))
                del stack[k:]
                return

    for match in _QUOTE.finditer(text):
        mark, at = match[0], match.start()
        before = text[at - 1] if at else " "
        after = text[at + 1] if at + 1 < len(text) else " "
        top = stack[-1][0] if stack else ""
        if mark in "「『„‚":
            stack.append((mark, at))
        elif mark == "」":
            close(at, "「")
        elif mark == "』":
            close(at, "『")
        elif mark == "“":
            if any(m == "„" for m, _ in stack) and not (before.isspace() and not after.isspace()):
                close(at, "„")
            elif before.isspace() or not after.isspace():
                stack.append((mark, at))
        elif mark == "”":
            close(at, "“„”")
        elif mark == "‘":
            if top == "‚":
                close(at, "‚")
            else:
                stack.append((mark, at))
        elif mark == "’":
            if not (before.isalnum() and after.isalpha()) or _CJK.match(before):
                close(at, "‘‚")
        elif mark in "«\u2039":
            if top == "»" and not before.isspace():
                close(at, "»")
            elif before.isspace() or at + 2 < len(text) and text[at + 2].isalnum() or not after.isspace():
                stack.append((mark, at))
        elif mark in "»\u203a":
            if any(m in "«\u2039" for m, _ in stack):
                close(at, "«\u2039")
            elif not after.isspace() and (before.isspace() or not before.isalnum()):
                stack.append((mark, at))
        elif any(m == '"' for m, _ in stack):
            close(at, '"')
        elif not after.isspace() and (before.isspace() or before in "([“‘«.!?"):
            stack.append((mark, at))
    return sorted(spans)


class Splitter:
    """Cuts texts into sentence units with a learned model."""

    def __init__(self, model: PeriodModel):
        self.model = model

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """Offsets of the units of a text."""
        out: list[tuple[int, int]] = []
        if not text:
            return out
        # only a period asks for the language
        main, alone = text_language(text, text.split(), self.model.votes) if "." in text else ("xx", True)
        for a, b in _blocks(text):
            block = text[a:b]
            lang = main if alone or "." not in block else block_language(block, block.split(), self.model.votes, main)
            lowered = _UPPER.search(block) is None
            for c, d in _segments(block):
                lo = a + c
                out += [(lo + x, lo + y) for x, y in self._cut(block[c:d], lang, lowered)]
        return out

    def _cut(self, text: str, lang: str, lowered: bool) -> list[tuple[int, int]]:
        quotes = _quotes(text) if ('"' in text if text.isascii() else _QUOTE.search(text)) else []
        closing = {b - 1 for _, b in quotes}
        opening = {a for a, _ in quotes}
        bounds: list[int] = []
        start = 0  # of the current unit
        held, attached = 0, False  # end of the quotation that is kept whole
        k = 0
        done = 0
        for match in _CANDIDATE.finditer(text):
            at, stop = match.span()
            if at < done:
                continue
            while k < len(quotes) and quotes[k][0] < at:
                a, b = quotes[k]
                k += 1
                if b <= held or a < start:
                    continue
                before = text[start:a]
                if _LETTERS.search(before):
                    if a >= held:
                        held, attached = b, False
                elif b > held and self._reported(text, a, b):
                    held, attached = b, True
            after = text[stop : stop + 2]
            end = stop if after[:1] == " " and after[1:] not in "»\u203a" else self._closed(text, stop, opening, closing)
            if end < held or end == held and attached and at < held and end < len(text):
                continue
            if self._ends(text, match, end, lang, lowered, quotes):
                after = text[end : end + 2]
                tail = _TAIL_SYMBOLS.match(text, end) if not after.isascii() or after.isspace() else None
                if tail:
                    end = tail.end()
                    end = self._closed(text, end, opening, closing)
                bounds.append(end)
                start = done = end
        out, lo = [], 0
        for hi in [*bounds, len(text)]:
            a, b = lo, hi
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if b > a:
                if out and not text[a].isalpha() and not _LETTERS.search(text, a, b) and not any(c.isdigit() for c in text[a:b]):
                    out[-1] = (out[-1][0], b)  # closing marks and symbols alone
                else:
                    out.append((a, b))
            lo = hi
        return out

    @staticmethod
    def _closed(text: str, at: int, opening: set[int], closing: set[int]) -> int:
        """After the closing marks that follow a place (one space may precede a guillemet)."""
        while at < len(text):
            char = text[at]
            if char in ")]）］}】〕":
                at += 1
            elif at in closing:
                at += 1
            elif char in "“«" and at not in opening and (at + 1 >= len(text) or not text[at + 1].isalnum()):
                at += 1
            elif char in "\"”’」』»\u203a" and at not in opening and (char not in '"’»' or at + 1 >= len(text) or not text[at + 1].isalnum()):
                at += 1
            elif char in _THIN and at + 1 < len(text) and text[at + 1] in "»\u203a" and (at + 1 in closing or at + 1 not in opening):
                at += 2
            elif char in _UNSEEN:
                at += 1
            else:
                break
        return at

    @staticmethod
    def _reported(text: str, a: int, b: int) -> bool:
        """Whether a quotation that opens a unit goes on in a reporting clause."""
        rest = text[b:]
        plain = rest.lstrip(_THIN + "\t" + _UNSEEN)
        if not plain or plain[0] == "\n":
            lead = plain.lstrip()
            return bool(lead) and lead[0].islower()
        if plain[0] in ",;:—–-，、،；":
            return True
        if plain[0].islower():
            return True
        inner = text[a:b].rstrip('"“”’‘»«」』' + _THIN + _UNSEEN)
        final = inner[-1:]
        if plain[0].isalpha() and not plain[0].isupper():
            if final and final in "!?！？؟…":
                return bool(_REPORT.search(normalize_segments(plain[:90])))
            if final and final in ".。।":
                return plain[0] in "と"
            return True
        return not (final and final in ".!?…。！？।؟") and plain[0].isupper()

    def _ends(self, text: str, match: re.Match, end: int, lang: str, lowered: bool, quotes) -> bool:
        mark = match[0]
        at, stop = match.span()
        latin = lang not in _OWN_SCRIPT
        if end >= len(text):
            return True
        nxt = text[end]
        kind = _follows(text, end)
        strong = mark.strip(".…")
        if strong:
            if nxt in ",;:，、،；":
                return False
            if kind == "lower" and not lowered and end == stop and not nxt.isspace():
                return False
            if kind == "lower" and not lowered:
                return "\n" in text[end : end + 3] or end == stop and mark[-1] not in "!?"
            if end > stop and nxt == "と":
                return False
            return True
        if len(mark) > 1 or "…" in mark:  # an ellipsis
            if nxt in ",;:，、،":
                return False
            return kind in ("upper", "other") or (kind in ("word", "digit", "lower") and end > stop and kind != "lower") or "\n" in text[end : end + 3] and kind != "lower"
        spaced = nxt.isspace()
        near = text[max(0, at - 40) : at]
        token = near.rsplit(None, 1)[-1].lstrip(_OPEN_SIGNS) if near and not near[-1].isspace() else ""
        if not spaced and end == stop:
            if not nxt.isalnum():
                opener = nxt in _OPEN_SIGNS and nxt not in ")]"
                if not opener:
                    tail = _TAIL_SYMBOLS.match(text, end)
                    if not tail or (nxt in "-'’/@"):
                        return False
            elif not nxt.isalpha() or nxt.islower():
                return False
            plain = token if token.isascii() else normalize_segments(token)
            last = _LETTERS.findall(plain[-12:])
            token = plain
            solid = token[-1:].isdigit() or token[-1:] in ")]”\"»" or last and token.endswith(last[-1]) and len(last[-1]) >= 2
            if not solid:
                return False
            if nxt.isalnum() and not (nxt.isupper() or _OTHER_SCRIPT(nxt)):
                return False
        if nxt in ",;:،":
            return False
        kind_of = _type(token, latin)
        if not kind_of:
            return kind not in ("lower",)
        if kind_of in ("#", "##"):
            if kind_of == "#" and (lang, _first_type(text, end, latin)) in self.model.collocations:
                return False
            return kind != "lower" or lowered
        known = self.model.abbreviation(lang, kind_of)
        if known is None:
            if len(token.strip("(\"'“")) == 1 and token[-1:].isupper() and token[-1:].isalpha():
                return kind == "upper" and (lang, _first_type(text, end, latin)) in self.model.starters
            if kind == "lower" and not lowered:
                return "." not in kind_of and (lang, kind_of) in self.model.ordinary
            if "." in kind_of and kind == "digit":
                return False
            return True
        can_end, numbered = known
        if kind == "lower" or kind == "other" and not spaced:
            return False
        if kind == "digit":
            return can_end and not numbered
        if not can_end:
            return False
        return kind in ("upper", "word", "other")


def _first_type(text: str, at: int, latin: bool) -> str:
    """Type of the word that opens what follows a place; empty if no word does."""
    word = _LETTERS.match(text, _FIRST.match(text, at).end())
    return _type(word[0], latin) if word else ""


def _OTHER_SCRIPT(char: str) -> bool:
    return ord(char) > 0x24F and char.isalpha()


# ---------------------------------------------------------------- statistics

_FIELDS = ("with_period", "bare", "lower", "upper", "digit", "block_end", "comma", "starts")
_CLOSERS = "\"'”’»)]"
STATS_SCHEMA = "lang string, kind string, type string, " + ", ".join(f"{f} bigint" for f in _FIELDS)


def count_types(texts: list[str], votes: dict[str, str]) -> dict[tuple[str, str, str], list[int]]:
    """Counts of types around periods over whole texts, by language.

    Words without a period and line starters count in every block, what follows
    a period only where case can tell. Chinese and Japanese aren't counted:
    their sentences don't end in periods, nor their words in spaces.
    """
    counts: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0] * len(_FIELDS))
    surface: dict[str, Counter] = defaultdict(Counter)
    for text in texts:
        whole = text.split()
        main, alone = text_language(text, whole, votes)
        if not whole or alone and main in ("zh", "ja"):
            continue
        if alone:
            surface[main].update(whole)
        for a, b in _blocks(text):
            block = text[a:b]
            if alone:
                lang = main
            else:
                tokens = block.split()
                lang = block_language(block, tokens, votes, main)
                if lang in ("zh", "ja"):
                    continue
                surface[lang].update(tokens)
            latin = lang not in _OWN_SCRIPT
            for line in block.split("\n"):
                word = _LETTERS.match(line) or _LETTERS.match(line, _FIRST.match(line).end())
                if word:
                    counts[(lang, "word", _type(word[0], latin))][7] += 1
            if "." not in block or _UPPER.search(block) is None and (latin or lang == "ru"):
                continue
            tokens = [*block.split(), ""]
            for i, token in [(i, t) for i, t in enumerate(tokens) if "." in t]:
                plain = token.rstrip(_CLOSERS)
                comma = plain[-1:] in (",", ";", ":") and plain[-2:-1] == "."
                if comma:
                    plain = plain[:-1]
                elif plain[-1:] != ".":
                    continue
                kind = _type(plain[:-1].lstrip(_OPEN_SIGNS), latin)
                if not kind or len(kind) > 20:  # nine letters and their periods at most
                    continue
                entry = counts[(lang, "word", kind)]
                entry[0] += 1
                if comma:
                    entry[6] += 1
                    continue
                following = tokens[i + 1]
                after = _follows(following, 0)
                if not following:
                    entry[5] += 1
                elif after in ("upper", "lower", "digit"):
                    entry[2 if after == "lower" else 3 if after == "upper" else 4] += 1
                if kind == "#" and following[:1].isalpha():
                    word = _LETTERS.match(following)
                    if word and len(word[0]) > 1:
                        counts[(lang, "pair", _type(word[0], latin))][0] += 1
    strip = "\"'“”„’‘«»()[],;:!?"
    for lang, seen in surface.items():
        total = sum(seen.values())
        latin = lang not in _OWN_SCRIPT
        for token, n in seen.items():
            plain = token.strip(strip)
            if plain and not plain.endswith("."):
                counts[(lang, "word", _type(plain, latin))][1] += n
        counts[(lang, "all", "")][1] += total
    return counts


def period_statistics(docs: DataFrame, votes: dict[str, str], text_column: str = "text") -> DataFrame:
    """The counts over all documents; partial sums are made per batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = count_types([t for t in batch["text"] if t], votes)
            rows = [(*k, *v) for k, v in counts.items() if k[1] != "word" or v[0] or v[7] or v[1] > 0]
            yield pd.DataFrame(rows, columns=["lang", "kind", "type", *_FIELDS], dtype=object)

    rows = docs.select(F.col(text_column).alias("text")).mapInPandas(run, STATS_SCHEMA)
    return rows.groupBy("lang", "kind", "type").agg(*(F.sum(f).alias(f) for f in _FIELDS))


def learn_periods(stats: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Abbreviations, ordinary words, collocations and starters with their ratios.

    ``floor`` is the least share of a language's tokens that a kept ordinary
    word has, which bounds them at ``1 / floor`` a language, whatever the
    corpus; all else is kept however rare. Result: ``lang, role, type, can_end, numbered, llr``.
    """
    totals = stats.where("kind = 'all'").select("lang", F.col("bare").alias("n"))
    periods = stats.where("kind = 'word'").groupBy("lang").agg(F.sum("with_period").alias("n_periods"), F.sum("starts").alias("n_starts"), (F.sum("block_end") / F.greatest(F.sum("with_period"), F.lit(1))).alias("end_rate"))
    words = stats.where("kind = 'word'").join(totals, "lang").join(periods, "lang")
    words = words.withColumn("seen", F.col("with_period") + F.col("bare")).where((F.col("seen") >= 2) | (F.col("starts") >= 3))

    def llr(both, first, second, n):
        """Dunning's ratio of a joint count against independence."""
        first, second = F.greatest(first, both), F.greatest(second, both)
        n = F.greatest(n, F.lit(1.0))
        p = F.least(F.greatest(second / n, F.lit(1e-9)), F.lit(1 - 1e-9))
        p1 = F.least(F.greatest(both / F.greatest(first, F.lit(1.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
        p2 = F.least(F.greatest((second - both) / F.greatest(n - first, F.lit(1.0)), F.lit(1e-9)), F.lit(1 - 1e-9))
        like = lambda k, m, q: k * F.log(q) + (m - k) * F.log(1 - q)
        rest, others = n - first, second - both
        return 2 * (like(both, first, p1) + like(others, rest, p2) - like(both, first, p) - like(others, rest, p))

    n = F.greatest(F.col("n"), F.col("seen")).cast("double")
    words = words.withColumn("llr", llr(F.col("with_period").cast("double"), F.col("seen").cast("double"), F.col("n_periods").cast("double"), n))
    words = words.withColumn("share", F.col("with_period") / F.greatest(F.col("seen"), F.lit(1)))
    dotted = F.col("type").contains(".")
    letters = F.length(F.regexp_replace("type", r"\.", ""))
    periods_seen = F.greatest(F.col("with_period"), F.lit(1))
    open_share = (F.col("lower") + F.col("comma") + F.when(F.col("digit") >= 3, F.col("digit")).otherwise(0)) / periods_seen
    significant = (F.col("llr") >= 7.88) & (F.col("share") > 0.5) | dotted
    # as sentence ends they would close a block now and then; a title never does
    # (the shorter the word, the less it takes to tell)
    expected = F.col("with_period") * F.greatest(F.col("end_rate"), F.lit(0.1))
    enough = F.when(letters <= 2, 0.7).when(letters == 3, 1.5).otherwise(3.0)
    never_last = (expected >= enough) & (F.col("block_end") < 0.1 * expected)
    inside = (open_share >= 0.08) | never_last | dotted
    abbreviation = significant & inside & (F.col("with_period") >= 2) & ((F.col("share") >= 0.9) | dotted & (F.col("share") >= 0.2)) & (letters <= 9) & ~F.col("type").rlike("^#+$")
    ordinary = (F.col("bare") >= 2) & (F.col("share") < 0.9) & (F.col("seen") >= F.col("n") * floor) & ~abbreviation
    kept = words.select(
        "lang",
        F.when(abbreviation, "abbreviation").when(ordinary & (F.col("with_period") > 0), "ordinary").alias("role"),
        "type",
        (F.col("block_end") >= 0.1 * expected).alias("can_end"),
        (F.col("digit") >= 0.5 * F.col("with_period")).alias("numbered"),
        "llr",
    ).where("role is not null")
    start_llr = llr(F.col("starts").cast("double"), F.greatest(F.col("seen"), F.col("starts")).cast("double"), F.col("n_starts").cast("double"), F.greatest(n, F.col("n_starts")))
    starters = words.withColumn("s", start_llr).where((F.col("s") >= 30) & (F.col("starts") > 0.25 * F.col("seen")) & (F.col("starts") * 200 > F.col("n_starts")))
    starters = starters.select("lang", F.lit("starter").alias("role"), "type", F.lit(True).alias("can_end"), F.lit(False).alias("numbered"), F.col("s").alias("llr"))
    pairs = stats.where("kind = 'pair'").select("lang", "type", F.col("with_period").alias("both"))
    numbers = stats.where("kind = 'word' and type = '#'").select("lang", F.col("with_period").alias("n_numbers"))
    colls = pairs.join(words.select("lang", "type", "seen", "n"), ["lang", "type"]).join(numbers, "lang")
    colls = colls.withColumn("llr", llr(F.col("both").cast("double"), F.col("seen").cast("double"), F.col("n_numbers").cast("double"), F.greatest(F.col("n"), F.col("seen")).cast("double")))
    colls = colls.where((F.col("llr") >= 15) & (F.col("both") >= 3) & (F.col("both") >= 0.3 * F.col("seen")))
    colls = colls.select("lang", F.lit("collocation").alias("role"), "type", F.lit(True).alias("can_end"), F.lit(False).alias("numbered"), "llr")
    return kept.unionByName(starters).unionByName(colls)


def period_model(learned: DataFrame, votes: dict[str, str], max_types: int = 2_000_000) -> PeriodModel:
    """The learned rows as a model to send to the tasks; its size is checked."""
    model = PeriodModel(votes=votes)
    rows = collect_bounded(learned.where("role <> 'ordinary'"), max_types, "period model")
    for r in rows:
        key = (r.lang, r.type)
        if r.role == "abbreviation":
            model.abbreviations[key] = (r.can_end, r.numbered)
            old = model.anywhere.get(r.type, (False, False))
            model.anywhere[r.type] = (old[0] or r.can_end, old[1] or r.numbered)
        elif r.role == "starter":
            model.starters.add(key)
        else:
            model.collocations.add(key)
    ordinary = learned.where("role = 'ordinary'").select("lang", "type")
    model.ordinary = {(r.lang, r.type) for r in collect_bounded(ordinary, max_types, "ordinary words")}
    return model


def fit_periods(docs: DataFrame, samples: DataFrame, text_column: str = "text", max_samples: int = 10_000) -> PeriodModel:
    """Learns the model from all documents.

    ``samples`` (lang, text) only serve to tell Latin-script languages apart;
    at most ``max_samples`` rows are allowed.
    """
    rows = collect_bounded(samples.select("lang", "text"), max_samples, "language samples")
    votes = language_votes([(r.lang, r.text) for r in rows if r.lang and r.text])
    # read five times below: counted once
    stats = cut_lineage(period_statistics(docs, votes, text_column))
    learned = cut_lineage(learn_periods(stats))
    return period_model(learned, votes)


def sentence_units(docs: DataFrame, model: PeriodModel, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False) -> DataFrame:
    """Sentence units: ``doc_id, begin_char, end_char`` (and ``text``).

    Units cover everything that isn't white space and have none at their ends.
    Null, empty and blank texts give no rows, a null id stays null, repeated
    rows come out each for itself, further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id bigint, begin_char bigint, end_char bigint" + (", text string" if with_text else "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(shared.value)
        for batch in batches:
            ids, begins, ends, texts = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                for a, b in splitter.spans(text):
                    ids.append(doc_id)
                    begins.append(a)
                    ends.append(b)
                    if with_text:
                        texts.append(text[a:b])
            out = {"doc_id": pd.array(ids, "Int64"), "begin_char": pd.array(begins, "int64"), "end_char": pd.array(ends, "int64")}
            yield pd.DataFrame(out | ({"text": pd.Series(texts, dtype=object)} if with_text else {}))

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, schema)
