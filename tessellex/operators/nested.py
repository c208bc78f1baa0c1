"""Deeply nested JSON records to flat, linked tables.

A batch of payloads is one byte array. Bitmaps of quotes, escapes and
brackets give the structural characters; the parity of the quotes before a
place says whether it lies in a string, a prefix sum over the brackets gives
the nesting depth, and the container of each structural character is the last
bracket opened one level higher. Keys and values are spans between structural
characters, so nothing is parsed value by value: only the spans of the wanted
fields are ever turned into Python objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTE, _OPEN, _CLOSE, _COLON, _COMMA = 1, 2, 3, 4, 5
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b'"', _QUOTE), (b"{[", _OPEN), (b"}]", _CLOSE), (b":", _COLON), (b",", _COMMA)):
    for _c in _chars:
        _CLASS[_c] = _kind
_BOM = b"\xef\xbb\xbf"


@dataclass
class StructuralIndex:
    """Structural characters of several JSON texts held in one byte array.

    One entry per structural character outside strings (a string counts with
    its two quotes): ``pos`` in ``data``, ``kind``, ``depth`` outside of it,
    ``owner`` (entry of the bracket that holds it, -1 at top level) and
    ``doc`` (which text). ``complete[i]`` says whether text i is balanced.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    pos: np.ndarray
    kind: np.ndarray
    depth: np.ndarray
    owner: np.ndarray
    doc: np.ndarray
    complete: np.ndarray = field(repr=False)
    _by_owner: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict, repr=False)
    _signs: tuple[np.ndarray, np.ndarray] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, texts: list[bytes]) -> StructuralIndex:
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        pos = np.flatnonzero(_CLASS[data])
        kind = _CLASS[data[pos]]

        quote = kind == _QUOTE
        slash = np.flatnonzero(data == 92)
        if slash.size:  # a quote is escaped after an odd run of backslashes
            head = np.ones(slash.size, bool)
            head[1:] = np.diff(slash) > 1
            run = np.cumsum(head) - 1
            run_start = slash[head]
            run_len = np.bincount(run)
            run_end = run_start + run_len
            q = np.flatnonzero(quote)
            at = np.searchsorted(run_end, pos[q])
            at[at == run_end.size] = 0
            quote[q[(run_end[at] == pos[q]) & (run_len[at] % 2 == 1)]] = False
        keep = quote | (kind != _QUOTE)
        pos, kind, quote = pos[keep], kind[keep], quote[keep]
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(pos, ends), prepend=0))

        before = np.cumsum(quote) - quote  # quotes before each entry, per text
        first = np.searchsorted(doc, np.arange(len(texts)))
        base = np.zeros(len(texts), np.int64)
        inside = first < pos.size
        base[inside] = before[first[inside]]
        in_string = ((before - base[doc]) % 2 == 1) & ~quote
        quotes_per = np.bincount(doc[quote], minlength=len(texts))
        pos, kind, doc = pos[~in_string], kind[~in_string], doc[~in_string]

        step = (kind == _OPEN).astype(np.int32) - (kind == _CLOSE)
        running = np.cumsum(step)
        first = np.searchsorted(doc, np.arange(len(texts)))
        last = np.searchsorted(doc, np.arange(len(texts)), side="right") - 1
        some = last >= first
        offset = np.zeros(len(texts), np.int64)
        offset[some] = running[first[some]] - step[first[some]]
        level = running - offset[doc]
        depth = np.where(kind == _OPEN, level - 1, level)  # depth around the entry
        least = np.zeros(len(texts), np.int64)
        np.minimum.at(least, doc, level)
        complete = np.zeros(len(texts), bool)
        complete[some] = level[last[some]] == 0
        complete &= (least >= 0) & (quotes_per % 2 == 0)
        opens = np.bincount(doc[kind == _OPEN], minlength=len(texts))
        complete &= opens > 0
        # a complete text ends where its outermost bracket closes
        for i in np.flatnonzero(complete):
            tail = data[pos[last[i]] + 1 : ends[i]]
            if np.any(tail > 32):
                complete[i] = False

        owner = np.full(pos.size, -1, np.int64)
        opening = np.flatnonzero(kind == _OPEN)
        for d in range(1, int(depth.max(initial=0)) + 1):
            here = np.flatnonzero(depth == d)
            above = opening[depth[opening] == d - 1]
            if here.size and above.size:
                found = np.searchsorted(above, here) - 1
                ok = found >= 0
                owner[here[ok]] = above[found[ok]]
        return cls(data, starts, ends, pos, kind, depth, owner, doc, complete)

    def span(self, lo: int, hi: int) -> bytes:
        return self.data[lo:hi].tobytes()

    def key_of(self, entry: int) -> str | None:
        """Key of the value that begins at an entry; None for array elements."""
        if entry >= 3 and self.kind[entry - 1] == _COLON and self.owner[entry - 1] == self.owner[entry]:
            return fold_key(self.span(self.pos[entry - 3] + 1, self.pos[entry - 2]))
        return None

    def _inside(self, kind: int, owners: np.ndarray) -> np.ndarray:
        """Entries of a kind directly inside the given brackets, in text order."""
        if kind not in self._by_owner:  # all entries of the kind, sorted by owner
            found = np.flatnonzero(self.kind == kind)
            found = found[np.argsort(self.owner[found], kind="stable")]
            self._by_owner[kind] = found, self.owner[found]
        found, by = self._by_owner[kind]
        lo, hi = np.searchsorted(by, owners), np.searchsorted(by, owners, side="right")
        size = hi - lo
        if owners.size == 1:
            return found[lo[0] : hi[0]]
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return found[at]

    def colons(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the colons directly inside the given brackets, and which bracket."""
        colon = self._inside(_COLON, owners)
        return colon, self.owner[colon]

    def may_fold_to(self, colon: np.ndarray, names: Iterable[str]) -> np.ndarray:
        """Which keys before the given colons can fold to one of the names, by their length.

        Underscores and hyphens don't count; a key beyond ASCII always can, as
        lower case may change its length.
        """
        if self._signs is None:
            self._signs = np.flatnonzero((self.data == 95) | (self.data == 45)), np.flatnonzero(self.data > 127)
        lo, hi = self.pos[colon - 2] + 1, self.pos[colon - 1]
        signs, wide = (np.searchsorted(x, hi) - np.searchsorted(x, lo) for x in self._signs)
        return np.isin(hi - lo - signs, [len(n) for n in names]) | (wide > 0)

    def children(self, owners: np.ndarray) -> np.ndarray:
        """Entries of the brackets that open directly inside the given brackets."""
        return self._inside(_OPEN, owners)

    def scalar(self, colon: int) -> str | None:
        """The scalar after a colon as text, None for null and for brackets."""
        nxt = colon + 1
        if nxt < self.pos.size and self.kind[nxt] == _QUOTE and self.owner[nxt] == self.owner[colon]:
            raw = self.span(self.pos[nxt], self.pos[nxt + 1] + 1)
            return json.loads(raw) if b"\\" in raw else raw[1:-1].decode("utf-8", "replace")
        if nxt < self.pos.size and self.kind[nxt] == _OPEN and self.owner[nxt] == self.owner[colon]:
            return None
        raw = self.span(self.pos[colon] + 1, self.pos[nxt]).strip().decode("utf-8", "replace")
        return None if raw == "null" else raw


@lru_cache(maxsize=4096)
def fold_key(raw: bytes | str) -> str:
    """Keys compare without case, underscores and hyphens."""
    text = raw.decode("utf-8", "replace") if isinstance(raw, bytes) else raw
    return text.replace("_", "").replace("-", "").lower()


@dataclass(frozen=True)
class Level:
    """One kind of row to take out of nested records.

    kind: name of the rows. keys: folded names of the field that holds them.
    ident: folded field with the row's number (0 where left out); for rows of
    a map keyed by number the key stands for it. parent: field with the
    parent's number, used where the row isn't kept inside its parent.
    parent_kind: kind of the parent. inside: kinds of rows in which these
    rows may also be kept. fields: further scalars to keep.
    """

    kind: str
    keys: tuple[str, ...]
    ident: str | None
    parent_kind: str
    parent: str | None = None
    inside: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


#: The annotation document as several producers deliver it.
ANNOTATION_LEVELS = (
    Level("sentence", ("sentence",), "sentenceindex", "record", None, (), ("characteroffsetbegin", "characteroffsetend", "tokenoffsetbegin", "tokenoffsetend", "paragraph", "speaker")),
    Level("token", ("token",), None, "sentence", None, ("sentence",), ("word", "lemma", "pos", "beginchar", "endchar")),
    Level("chain", ("corefchain",), "chainid", "record", None, (), ("representative",)),
    Level("coref_mention", ("mention",), "mentionid", "chain", None, ("chain",), ("mentiontype", "beginindex", "endindex", "headindex", "sentenceindex", "number", "gender", "animacy")),
    Level("entity_mention", ("mentions",), "entitymentionindex", "sentence", "sentenceindex", ("sentence",), ("tokenstartinsentenceinclusive", "tokenendinsentenceexclusive", "ner", "entitymentiontext", "entitytype", "gender")),
    Level("quote", ("quote",), "index", "sentence", "sentencebegin", ("quote",), ("begin", "end", "sentenceend", "speaker", "text")),
)

ROW_SCHEMA = "record_id bigint, child_kind string, child_id bigint, parent_kind string, parent_id bigint, child_seq bigint, fields map<string,string>"


def _number(text: str | None) -> int:
    if text is None:
        return 0
    try:
        return int(text)
    except ValueError:
        try:
            return int(float(text))
        except (ValueError, OverflowError):
            return 0


class _Walker:
    """Takes the rows of all levels out of one batch of payloads."""

    def __init__(self, levels: tuple[Level, ...], kinds: frozenset[str], with_fields: bool):
        self.levels, self.kinds, self.with_fields = levels, kinds, with_fields
        self.by_key = {key: level for level in levels for key in level.keys}
        wanted = set(kinds)
        while True:  # a kind is visited if it or something inside it is wanted
            more = {p for x in levels if x.kind in wanted for p in x.inside} | wanted
            if more == wanted:
                break
            wanted = more
        self.visit = wanted
        self.out: list[tuple] = []

    def run(self, records: list[int], texts: list[bytes]) -> list[tuple]:
        """Rows (record_id, kind, id, parent kind, parent id, seq, fields)."""
        jobs = [(r, t, None, None, None) for r, t in zip(records, texts)]
        while jobs:
            jobs = self._pass(jobs)
        return self.out

    def _pass(self, jobs: list[tuple]) -> list[tuple]:
        index = StructuralIndex.build([j[1] for j in jobs])
        later: list[tuple] = []
        top = np.flatnonzero((index.kind == _OPEN) & (index.depth == 0))
        top = top[index.complete[index.doc[top]]]
        roots, embedded = [], []
        for entry in top:
            (embedded if jobs[index.doc[entry]][2] is not None else roots).append(entry)
        # payloads: the document, or an object that wraps it
        level_entries: list[tuple[int, Level, tuple[str, int] | None, str | None]] = []
        self._values(index, np.array(roots, np.int64), {e: (None, None) for e in roots}, jobs, level_entries, later, True)
        for entry in embedded:
            _, _, level, parent, _ = jobs[index.doc[entry]]
            self._expand(index, entry, level, parent, level_entries)
        seq: dict[tuple, int] = {}
        while level_entries:
            level_entries = self._rows(index, level_entries, jobs, later, seq)
        return later

    def _expand(self, index, entry, level, parent, into):
        """A field's value: one row, a list of rows, or a map of rows by number."""
        if index.data[index.pos[entry]] == 123:
            inner = index.children(np.array([entry]))
            keys = [index.key_of(i) for i in inner]
            if inner.size and all(k is not None and k.isdigit() for k in keys):
                into.extend((i, level, parent, k) for i, k in zip(inner, keys))
            else:
                into.append((entry, level, parent, None))
        else:
            into.extend((i, level, parent, None) for i in index.children(np.array([entry])) if index.data[index.pos[i]] == 123)

    def _values(self, index, owners, parents, jobs, into, later, unwrap):
        """Follows the fields of the given objects that hold rows."""
        if not owners.size:
            return
        bucket: dict[tuple[int, str], list] = {}
        inner = index.children(owners)
        keyed = [(i, index.key_of(i)) for i in inner]
        for i, key in keyed:
            owner = int(index.owner[i])
            level = self.by_key.get(key)
            kind = parents[owner][0]
            if level and level.kind in self.visit and (kind is None or kind in level.inside):
                bucket.setdefault((owner, key), []).append(i)
                self._expand(index, i, level, parents[owner][1], into)
            elif unwrap and key == "document" and kind is None:
                self._values(index, np.array([i]), {int(i): (None, None)}, jobs, into, later, False)
        colon, owner = index.colons(owners)
        quoted = np.zeros(colon.size, bool)
        ok = colon + 1 < index.pos.size
        quoted[ok] = index.kind[colon[ok] + 1] == _QUOTE
        # rows delivered as text: strings that begin with a bracket
        cand = np.flatnonzero(quoted)
        cand = cand[np.isin(index.data[index.pos[colon[cand] + 1] + 1], (91, 123))]
        for c, o in zip(colon[cand], owner[cand]):
            key = fold_key(index.span(index.pos[c - 2] + 1, index.pos[c - 1]))
            level, kind = self.by_key.get(key), parents[int(o)][0]
            if level and level.kind in self.visit and (kind is None or kind in level.inside):
                text = index.scalar(c)
                later.append((jobs[index.doc[c]][0], text.encode(), level, parents[int(o)][1], None))

    def _rows(self, index, entries, jobs, later, seq):
        by_level: dict[str, list] = {}
        for e in entries:
            by_level.setdefault(e[1].kind, []).append(e)
        into: list[tuple] = []
        for kind, group in by_level.items():
            level = group[0][1]
            owners = np.array([e[0] for e in group], np.int64)
            need = {level.ident, level.parent} - {None}
            if self.with_fields and kind in self.kinds:
                need |= set(level.fields)
            values: dict[int, dict[str, str | None]] = {int(o): {} for o in owners}
            if need:
                colon, owner = index.colons(owners)
                near = index.may_fold_to(colon, need)
                for c, o in zip(colon[near].tolist(), owner[near].tolist()):
                    key = fold_key(index.span(index.pos[c - 2] + 1, index.pos[c - 1]))
                    if key in need:
                        values[o][key] = index.scalar(c)
            parents: dict[int, tuple[str, object]] = {}
            for entry, _, parent, named in group:
                own = values[int(entry)]
                record = jobs[index.doc[entry]][0]
                count = seq[(record, kind, parent)] = seq.get((record, kind, parent), -1) + 1
                if level.ident is None:
                    ident = count
                elif level.ident in own:
                    ident = _number(own[level.ident])
                else:
                    ident = int(named) if named is not None else 0
                if parent is None:
                    up = (level.parent_kind, _number(own.get(level.parent)) if level.parent else record)
                else:
                    up = parent
                if kind in self.kinds:
                    keep = {k: v for k, v in own.items() if v is not None and k in level.fields} if self.with_fields else None
                    self.out.append((record, kind, ident, up[0], up[1], count, keep))
                parents[int(entry)] = (kind, (kind, ident))
            if any(kind in x.inside and x.kind in self.visit for x in self.levels):
                self._values(index, owners, parents, jobs, into, later, False)
        return into


def nested_rows(
    records: DataFrame,
    levels: tuple[Level, ...] = ANNOTATION_LEVELS,
    kinds: Iterable[str] | None = None,
    with_fields: bool = True,
    id_column: str = "record_id",
    payload_column: str = "payload",
    batch_bytes: int = 4 << 20,
) -> DataFrame:
    """Linked rows of nested records, one pass over the payloads.

    Result: ``record_id, child_kind, child_id, parent_kind, parent_id,
    child_seq, fields``; every row names its parent. ``kinds`` limits the
    kinds that come out. Keys compare without case and underscores; a list of
    one may be a bare object, a list may be a map keyed by number or JSON
    inside a string; the document may be wrapped in ``document``.

    Nulls: a null id is kept as null, a null or empty payload or one that
    isn't complete JSON gives no rows. Repeated records give repeated rows
    (see ``distinct_links``). Very long payloads are indexed whole, further
    columns are ignored, an empty table gives an empty result.
    """
    chosen = frozenset(kinds if kinds is not None else (x.kind for x in levels))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "child_kind", "child_id", "parent_kind", "parent_id", "child_seq", "fields"]
        for batch in batches:
            texts = [None if x is None else x.encode("utf-8", "replace") for x in batch["payload"]]
            ids = [None if pd.isna(i) else int(i) for i in batch["record_id"]]
            lo = 0
            while lo < len(texts):
                hi, room = lo, batch_bytes
                while hi < len(texts) and (hi == lo or room > 0):
                    room -= len(texts[hi] or b"")
                    hi += 1
                part = [(i, t[3:] if t.startswith(_BOM) else t) for i, t in zip(ids[lo:hi], texts[lo:hi]) if t]
                lo = hi
                if part:
                    rows = _Walker(levels, chosen, with_fields).run([p[0] for p in part], [p[1] for p in part])
                    if rows:
                        yield pd.DataFrame(rows, columns=columns, dtype=object)

    source = records.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(payload_column).alias("payload"))
    return source.mapInPandas(run, ROW_SCHEMA)


def distinct_links(rows: DataFrame) -> DataFrame:
    """Each child once per record, however often its record was delivered."""
    return rows.select("record_id", "child_kind", "child_id", "parent_kind", "parent_id").distinct()


def flat_tables(rows: DataFrame, levels: tuple[Level, ...] = ANNOTATION_LEVELS) -> dict[str, DataFrame]:
    """One flat table per kind, its fields as columns beside the links."""
    tables = {}
    for level in levels:
        part = rows.where(F.col("child_kind") == level.kind)
        columns = [F.col("fields")[f].alias(f) for f in level.fields]
        tables[level.kind] = part.select("record_id", F.col("child_id").alias("id"), "parent_kind", "parent_id", *columns).distinct()
    return tables
