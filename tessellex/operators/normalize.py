"""Number words, quantities and dates as normalized values."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Number words.
_ONES = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)} | {"fourty": 40}
_SCALES = {"dozen": 12, "hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
_ORDINALS = {"first": 1, "second": 2, "third": 3, "fifth": 5, "eighth": 8, "ninth": 9, "twelfth": 12}
_FRACTIONS = {"half": 0.5, "quarter": 0.25}


def _ordinal_word(word: str) -> int | None:
    if word in _ORDINALS:
        return _ORDINALS[word]
    if word.endswith("ieth") and word[:-4] + "y" in _TENS:
        return _TENS[word[:-4] + "y"]
    if word.endswith("th"):
        base = word[:-2]
        return _ONES.get(base, _SCALES.get(base))
    return None


@lru_cache(maxsize=1 << 14)
def parse_number(text: str) -> tuple[str, float] | None:
    """(``NUMBER`` or ``ORDINAL``, value) of digits or number words, else None.

    The greatest scale splits the words: what precedes it multiplies, what
    follows adds. "and", hyphens and commas don't count; an ordinal may only
    be last; "-ths" makes a fraction.
    """
    plain = text.strip().lower()
    digits = re.fullmatch(r"([-+]?\d[\d,]*(?:\.\d+)?)(st|nd|rd|th)?", plain)
    if digits:
        return "ORDINAL" if digits[2] else "NUMBER", float(digits[1].replace(",", ""))
    mixed = re.fullmatch(r"([-+]?\d[\d,]*(?:\.\d+)?)[ -](\w+)", plain)
    if mixed and mixed[2] in _SCALES:
        return "NUMBER", float(mixed[1].replace(",", "")) * _SCALES[mixed[2]]
    words = [w for w in re.split(r"[\s,\-]+", plain) if w and w not in ("and", "a", "an")]
    if not words:
        return None
    kind, fraction = "NUMBER", None
    if words[-1] in _FRACTIONS:
        fraction = _FRACTIONS[words.pop()]
        if not words:
            return "NUMBER", fraction
    elif len(words) > 1 and words[-1].endswith("s") and _ordinal_word(words[-1][:-1]):
        return _scaled(words[:-1], lambda v: ("NUMBER", v / _ordinal_word(words[-1][:-1])))
    else:
        last = _ordinal_word(words[-1])
        if last is not None:
            kind = "ORDINAL"
            name = next((w for table in (_ONES, _TENS, _SCALES) for w, v in table.items() if v == last), None)
            if name is None:
                return None
            words[-1] = name
    return _scaled(words, lambda v: (kind, v * fraction if fraction is not None else v))


def _scaled(words: list[str], make):
    value = _value(words)
    return None if value is None else make(float(value))


def _value(words: list[str]) -> int | None:
    if not words:
        return None
    scales = [(v, i) for i, w in enumerate(words) if (v := _SCALES.get(w))]
    if scales:
        top, at = max(scales, key=lambda s: (s[0], s[1]))
        before = _value(words[:at]) if at else 1
        after = _value(words[at + 1 :]) if at + 1 < len(words) else 0
        return None if before is None or after is None else before * top + after
    total = 0
    for i, w in enumerate(words):
        if w in _TENS and (i == 0 or words[i - 1] in _ONES):
            if total and total < 100 and len(words) > 1:  # nineteen eighty
                total *= 100
            total += _TENS[w]
        elif w in _ONES and (i == 0 or words[i - 1] in _TENS and _ONES[w] < 10):
            total += _ONES[w]
        else:
            return None
    return total


_MONEY = re.compile(r"(?P<sign>[$£€¥])\s?(?P<n>\d[\d,]*(?:\.\d+)?)(?:\s?(?P<scale>thousand|million|billion|trillion|[kmb]n?)\b)?|(?P<n2>\d[\d,]*(?:\.\d+)?)\s(?:(?P<scale2>thousand|million|billion|trillion)\s)?(?P<unit>dollars?|cents?|euros?|pounds?|yen|crowns?)\b", re.I)


def normalize_money(text: str) -> str | None:
    """Sign and plain value: ``$1200000.0``."""
    m = _MONEY.fullmatch(text.strip())
    if not m:
        return None
    value = float((m["n"] or m["n2"]).replace(",", ""))
    scale = (m["scale"] or m["scale2"] or "").lower()
    value *= _SCALES.get({"k": "thousand", "m": "million", "mn": "million", "b": "billion", "bn": "billion"}.get(scale, scale), 1)
    unit = (m["unit"] or "").lower().rstrip("s")
    if unit == "cent":
        value /= 100
    sign = m["sign"] or {"dollar": "$", "cent": "$", "euro": "€", "pound": "£", "yen": "¥"}.get(unit, unit + " ")
    return f"{sign}{value}"


# ---------------------------------------------------------------- time

_MONTHS = {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)}
_MONTHS |= {m[:3]: i for m, i in _MONTHS.items()} | {"sept": 9}
_DAYS = {d: i for i, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
_UNITS = {"second": "S", "minute": "M", "hour": "H", "day": "D", "week": "W", "month": "M", "year": "Y", "decade": "E", "century": "C"}
_M = "|".join(sorted(_MONTHS, key=len, reverse=True))
_D = "|".join(_DAYS)
_U = "|".join(_UNITS)
_N = r"\d+|a|an|" + "|".join([*_ONES, *_TENS])
_PARTS = [
    ("iso", r"\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?"),
    ("slash", r"\d{1,2}/\d{1,2}/\d{4}"),
    ("dmy", rf"(?:\d{{1,2}}(?:st|nd|rd|th)?\s(?:of\s)?)(?:{_M})\b\.?(?:,?\s\d{{4}}\b)?"),
    ("mdy", rf"(?:{_M})\b\.?\s\d{{1,2}}(?:st|nd|rd|th)?\b(?:,?\s\d{{4}}\b)?"),
    ("my", rf"(?:{_M})\b\.?,?\s\d{{4}}\b"),
    ("rel", rf"(?:next|last|this|previous|past|coming)\s(?:{_D}|{_M}|{_U}|weekend)\b"),
    ("off", rf"(?:{_N})\s(?:{_U})s?\s(?:ago|from now|later|earlier|before|after)\b|in\s(?:{_N})\s(?:{_U})s?\b"),
    ("dur", rf"(?:for\s)?(?:{_N})[\s-](?:{_U})s?\b"),
    ("set", rf"(?:every|each)\s(?:{_D}|{_U})\b|(?:daily|weekly|monthly|yearly|annually)\b"),
    ("time", r"\d{1,2}:\d{2}(?:\s?[ap]\.?m\.?)?|\d{1,2}\s?(?:a\.m\.|p\.m\.|am|pm|o'clock)\b|noon\b|midnight\b"),
    ("day", rf"(?:today|tomorrow|yesterday|tonight|now)\b|(?:{_D})\b"),
    ("decade", r"(?:the\s)?(?:19|20)\d0s\b"),
    ("year", r"\b(?:1[5-9]|20)\d{2}\b"),
    ("month", r"(?:january|february|march|april|june|july|august|september|october|november|december)\b"),
]
_FIRST = {w[:2] for w in [*_MONTHS, *_DAYS, *_ONES, *_TENS, *"an next last this previous past coming in for every each daily weekly monthly yearly annually noon midnight today tomorrow yesterday tonight now the".split()]}
# where a time can begin, at a word's begin or (second choices of the parts) within one; the same times as without it, only sooner
_BEGIN = rf"(?=[a-z\d])(?:(?<!\w)(?:(?=\d)|(?=a[\s-]|{'|'.join(sorted(f'{a}[{"".join(sorted(w[1] for w in _FIRST if w[0] == a))}]' for a in {w[0] for w in _FIRST}))}))|(?=\d|in\s|dai|fri|m(?:on|id)|noo|s(?:at|un)|t(?:ue|hu)|we[ed]|yea|ann))"
_TIMEX = re.compile(_BEGIN + "(?:" + "|".join(rf"(?P<{k}>(?<!\w){p})" for k, p in _PARTS) + ")", re.I)


@dataclass(frozen=True)
class Timex:
    begin: int
    end: int
    text: str
    kind: str
    value: str


def find_times(text: str, reference: dt.date | None = None) -> list[Timex]:
    """TIMEX3 types and values; what a missing reference leaves open is ``X``."""
    out = []
    for m in _TIMEX.finditer(text):
        made = _resolve(m.lastgroup, m[0].lower(), reference)
        if made:
            out.append(Timex(m.start(), m.end(), m[0], *made))
    return out


def _count(word: str) -> float:
    return 1 if word in ("a", "an") else parse_number(word)[1]


def _shift(day: dt.date, n: int, unit: str) -> str:
    if unit in ("day", "week"):
        return (day + dt.timedelta(days=n * (7 if unit == "week" else 1))).isoformat()
    if unit in ("hour", "minute", "second"):
        return day.isoformat()
    months = n * {"month": 1, "year": 12, "decade": 120, "century": 1200}[unit]
    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    if unit == "month":
        return f"{y:04d}-{m + 1:02d}"
    return f"{y:04d}"


def _resolve(kind: str, t: str, ref: dt.date | None) -> tuple[str, str] | None:
    words = t.replace(",", " ").replace(".", " ").split()
    if kind == "iso":
        try:
            dt.date.fromisoformat(t[:10])
        except ValueError:
            return None
        return ("TIME" if len(t) > 10 else "DATE"), t.upper().replace(" ", "T")
    if kind == "slash":
        month, day, year = map(int, t.split("/"))
        return ("DATE", f"{year:04d}-{month:02d}-{day:02d}") if 1 <= month <= 12 and 1 <= day <= 31 else None
    if kind in ("dmy", "mdy", "my", "month"):
        month = next(_MONTHS[w] for w in words if w in _MONTHS)
        numbers = [re.sub(r"\D", "", w) for w in words if w[0].isdigit()]
        year = next((n for n in numbers if len(n) == 4), "XXXX")
        day = next((n for n in numbers if len(n) < 3), None)
        return "DATE", f"{year}-{month:02d}" + (f"-{int(day):02d}" if day else "")
    if kind == "year":
        return "DATE", t
    if kind == "decade":
        return "DATE", re.search(r"\d{3}", t)[0] + "X"
    if kind == "set":
        what = words[-1]
        if what in _DAYS:
            return "SET", f"XXXX-WXX-{_DAYS[what] + 1}"
        unit = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year", "annually": "year"}.get(what, what)
        return "SET", f"P{'T' if unit in ('hour', 'minute', 'second') else ''}1{_UNITS[unit]}"
    if kind == "time":
        if t in ("noon", "midnight"):
            clock = "12:00" if t == "noon" else "00:00"
        else:
            h, _, m = re.match(r"(\d{1,2})(:(\d{2}))?", t).groups()
            hour = int(h) % 24
            if "p" in t.split(h, 1)[1] and hour < 12:
                hour += 12
            clock = f"{hour:02d}:{m or '00'}"
        return "TIME", f"{ref.isoformat() if ref else ''}T{clock}"
    if kind == "dur":
        n, unit = re.search(rf"({_N})[\s-]({_U})", t).groups()
        return "DURATION", f"P{'T' if unit in ('hour', 'minute', 'second') else ''}{_count(n):g}{_UNITS[unit]}"
    if kind == "off":
        n, unit = re.search(rf"({_N})\s({_U})", t).groups()
        back = re.search("ago|earlier|before", t) is not None
        if ref is None:
            return "DATE", f"OFFSET P{'-' if back else ''}{_count(n):g}{_UNITS[unit]}"
        return "DATE", _shift(ref, int(_count(n)) * (-1 if back else 1), unit)
    if kind == "day":
        if t == "now":
            return "DATE", "PRESENT_REF"
        step = {"today": 0, "tonight": 0, "tomorrow": 1, "yesterday": -1}.get(t)
        if step is not None:
            if ref is None:
                return "DATE", f"THIS P1D{f' OFFSET P{step}D' if step else ''}"
            day = (ref + dt.timedelta(days=step)).isoformat()
            return ("TIME", day + "TNI") if t == "tonight" else ("DATE", day)
        if ref is None:
            return "DATE", f"XXXX-WXX-{_DAYS[t] + 1}"
        return "DATE", (ref + dt.timedelta(days=_DAYS[t] - ref.weekday())).isoformat()
    if kind == "rel":
        sign = -1 if words[0] in ("last", "previous", "past") else 0 if words[0] == "this" else 1
        what = words[1]
        if ref is None:
            return "DATE", f"{ {-1: 'PREV', 0: 'THIS', 1: 'NEXT'}[sign]} {what.upper()}"
        if what in _DAYS or what == "weekend":
            target = _DAYS.get(what, 5)
            gap = (target - ref.weekday()) % 7
            if sign > 0:
                gap = gap or 7
            elif sign < 0:
                gap = gap - 7 if gap else -7
            else:
                gap = target - ref.weekday()
            day = ref + dt.timedelta(days=gap)
            return "DATE", f"{day.isocalendar()[0]}-W{day.isocalendar()[1]:02d}-WE" if what == "weekend" else day.isoformat()
        if what in _MONTHS:
            gap = (_MONTHS[what] - ref.month) % 12
            gap = gap or 12 if sign > 0 else gap - 12 if sign < 0 else _MONTHS[what] - ref.month
            return "DATE", _shift(ref.replace(day=1), gap, "month")
        if what == "week":
            year, week, _ = (ref + dt.timedelta(days=7 * sign)).isocalendar()
            return "DATE", f"{year}-W{week:02d}"
        return "DATE", _shift(ref, sign, what)
    return None


TIMEX_SCHEMA = "doc_id bigint, begin_char int, end_char int, text string, type string, value string"


def annotate_times(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", date_column: str | None = None) -> DataFrame:
    """Time expressions with values, resolved against the document's date.

    Dates may be ISO or unhyphenated; null or partial ones leave relative
    expressions open. Null and empty texts give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, day in zip(batch["doc_id"], batch["text"], batch["day"]):
                try:
                    ref = dt.datetime.strptime((day or "").replace("-", ""), "%Y%m%d").date()
                except ValueError:
                    ref = None
                key = None if pd.isna(doc_id) else int(doc_id)
                rows.extend((key, t.begin, t.end, t.text, t.kind, t.value) for t in find_times(text or "", ref))
            yield pd.DataFrame(rows, columns=["doc_id", "begin_char", "end_char", "text", "type", "value"], dtype=object)

    day = F.col(date_column) if date_column else F.lit(None).cast("string")
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), day.alias("day")).mapInPandas(run, TIMEX_SCHEMA)
