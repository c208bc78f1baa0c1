"""Language of documents and of the stretches inside them.

A byte convolutional network: byte classes are embedded, convolved with
filters of several widths, max-pooled over a fixed-length window and mapped to
languages by softmax. It is trained here with numpy, first on labelled
samples, then also on a bounded sample of documents whose label it agrees
with. For use, each filter collapses to lookup tables over pairs of bytes, so
a batch of windows is classified with table lookups and maxima alone.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellex.llm.canonical import _FOREIGN, normalize_segments, unify_scripts
from tessellex.session import collect_bounded

WINDOW = 96
WIDTHS = (2, 4, 6)
NONE = "zxx"

# Codes and English names of the languages, and labels that name none.
LANGUAGE_NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish", "castilian"),
    "it": ("it", "ita", "italian"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin"),
    "ja": ("ja", "jpn", "japanese"),
    "ar": ("ar", "ara", "arb", "arabic"),
    "hi": ("hi", "hin", "hindi"),
}
NO_LANGUAGE = ("", "und", "unk", "unknown", "undetermined", "undefined", "xx", "xxx", "zz", "zxx", "mul", "mis", "none", "null", "nan", "na", "n/a", "other", "-", "?")

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _CLASS[_b] = (
        0 if _b == 0 else 1 if _b in b" \t\n\r" else 2 if 48 <= _b < 58 else 3 + _b - 97 if 97 <= _b < 123 else 29 + _b - 65 if 65 <= _b < 91 else 55 if _b in b"'-" else 56 if _b < 128 else 57 + _b - 128
    )
CLASSES = int(_CLASS.max()) + 1


def parse_label(label: str | None) -> str | None:
    """Two letters for one of the ten languages, None where a label names no
    language, and ``?name`` for any other language."""
    text = (label or "").strip().lower()
    if text in NO_LANGUAGE:
        return None
    base = re.split(r"[-_.@ (]", text)[0]
    for code, names in LANGUAGE_NAMES.items():
        if text in names or base in names:
            return code
    return "?" + base if base.isalpha() and base not in NO_LANGUAGE else None


# ---------------------------------------------------------------- network


@dataclass
class ByteNet:
    """Trained network in its lookup form; ``tables[w][j]`` holds pair j of width w."""

    languages: tuple[str, ...]
    tables: dict[int, list[np.ndarray]]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray
    scale: float

    def log_probabilities(self, windows: np.ndarray, chunk: int = 2048) -> np.ndarray:
        """Log-probabilities of windows of byte classes, shape (n, WINDOW)."""
        result = np.empty((len(windows), len(self.languages)), np.float32)
        filters = self.out.shape[0] // len(WIDTHS)
        for lo in range(0, len(windows), chunk):
            part = windows[lo : lo + chunk]
            n = len(part)
            pairs = np.ascontiguousarray((part[:, :-1].astype(np.int32) * CLASSES + part[:, 1:]).T)
            pooled = []
            row, extra = np.empty((n, filters), np.int16), np.empty((n, filters), np.int16)
            for width in WIDTHS:
                best = np.full((n, filters), -32768, np.int16)
                tables = self.tables[width]
                for p in range(WINDOW - width + 1):
                    np.take(tables[0], pairs[p], axis=0, out=row, mode="clip")
                    for j in range(1, width // 2):
                        np.take(tables[j], pairs[p + 2 * j], axis=0, out=extra, mode="clip")
                        np.add(row, extra, out=row)
                    np.maximum(best, row, out=best)
                pooled.append(np.maximum(best.astype(np.float32) / self.scale + self.bias[width], 0))
            logits = np.concatenate(pooled, 1) @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            result[lo : lo + n] = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        return result


def train_network(windows: np.ndarray, targets: np.ndarray, languages: tuple[str, ...], filters: int = 32, embed: int = 12, epochs: int = 6, seed: int = 1, start: dict | None = None) -> tuple[ByteNet, dict]:
    """Trains by Adam on cross entropy; gradients pass only through the maxima."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    if start is None:
        par = {"emb": rng.normal(0, 0.3, (CLASSES, embed)), "out": rng.normal(0, 0.15, (filters * len(WIDTHS), k)), "ob": np.zeros(k)}
        for w in WIDTHS:
            par[f"k{w}"] = rng.normal(0, (2.0 / (w * embed)) ** 0.5, (w, embed, filters))
            par[f"b{w}"] = np.zeros(filters)
        par = {a: v.astype(np.float32) for a, v in par.items()}
    else:
        par = {a: v.copy() for a, v in start.items()}
    par["emb"][0] = 0
    moment = {a: (np.zeros_like(v), np.zeros_like(v)) for a, v in par.items()}
    step, batch = 0, 128
    total = epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            x, y = windows[ids], targets[ids]
            n = len(ids)
            e = par["emb"][x]
            feats, args = [], []
            for w in WIDTHS:
                span = WINDOW - w + 1
                acc = None
                for j in range(w):
                    term = e[:, j : j + span].reshape(-1, e.shape[2]) @ par[f"k{w}"][j]
                    acc = term if acc is None else acc + term
                acc = acc.reshape(n, span, -1)
                at = acc.argmax(1)
                args.append(at)
                feats.append(np.take_along_axis(acc, at[:, None], 1)[:, 0] + par[f"b{w}"])
            raw = np.concatenate(feats, 1)
            act = np.maximum(raw, 0)
            keep = rng.random(act.shape) > 0.2
            drop = act * keep / 0.8
            logits = drop @ par["out"] + par["ob"]
            logits -= logits.max(1, keepdims=True)
            prob = np.exp(logits)
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(n), y] -= 1
            prob /= n
            grad = {"out": drop.T @ prob, "ob": prob.sum(0), "emb": np.zeros_like(par["emb"])}
            back = (prob @ par["out"].T) * keep / 0.8 * (raw > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * filters : (i + 1) * filters]
                where = args[i][:, :, None] + np.arange(w)
                byte = x[np.arange(n)[:, None, None], where]
                near = par["emb"][byte]
                grad[f"k{w}"] = np.einsum("nf,nfwe->wef", g, near, optimize=True)
                grad[f"b{w}"] = g.sum(0)
                flow = np.einsum("nf,wef->nfwe", g, par[f"k{w}"], optimize=True)
                flat, flow = byte.ravel(), flow.reshape(-1, flow.shape[-1])
                for d in range(flow.shape[1]):
                    grad["emb"][:, d] += np.bincount(flat, flow[:, d], CLASSES)
            step += 1
            rate = 0.004 * (1 - step / (total + 1))
            for a, g in grad.items():
                m, v = moment[a]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                par[a] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
            par["emb"][0] = 0
    scale = 512.0
    tables, bias = {}, {}
    for w in WIDTHS:
        single = [par["emb"] @ par[f"k{w}"][j] for j in range(w)]
        peak = max(1e-6, sum(np.abs(s).max() for s in single))
        scale = min(scale, 32000.0 / peak)
        tables[w], bias[w] = single, par[f"b{w}"]
    pairs = {w: [np.round((s[2 * j][:, None] + s[2 * j + 1][None]).reshape(CLASSES * CLASSES, -1) * scale).astype(np.int16) for j in range(w // 2)] for w, s in tables.items()}
    return ByteNet(languages, pairs, bias, par["out"], par["ob"], scale), par


# ---------------------------------------------------------------- windows and units

_STOP = re.compile(
    "[.!?…][.!?…\"”’“»«\\])’]*(?:(?=\\s)|(?=[^\\W\\d_a-zß-ÿа-я]))"
    "|[。！？।؟]+[」』”’»\"]*"
    "|[\\n\u2029]+"
)
_WORDY = re.compile(r"[^\W\d_]")


def text_units(text: str, least: int = 14) -> list[tuple[int, int]]:
    """Stretches that surely are in one language: sentences, or parts of them.

    Fragments of fewer bytes than ``least`` (after abbreviations, say) go with
    what follows on the line.
    """
    out, lo, begin = [], 0, None
    for match in _STOP.finditer(text):
        stop = match.end()
        part = text[lo:stop]
        if begin is None:
            begin = lo
        lo = stop
        size = stop - begin
        if size < least and size + 2 * sum(c > "\u02ff" for c in text[begin:stop]) < least and match[0][0] not in "\n\u2029":
            continue
        if part.strip() or begin < stop:
            out.append((begin, stop))
        begin = None
    if begin is None:
        begin = lo
    if begin < len(text):
        out.append((begin, len(text)))
    units = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            units.append((a, b))
    return units


def to_windows(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes in fixed-length windows, and the piece each is from."""
    raw = [p.encode("utf-8", "replace") for p in pieces]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    counts = np.maximum(1, -(-sizes // WINDOW))
    data = np.frombuffer(b"".join(raw) + bytes(WINDOW), np.uint8)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(raw)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    # the last window of a long piece ends with the piece
    offset = np.minimum(nth * WINDOW, np.maximum(sizes[owner] - WINDOW, 0))
    at = starts[owner] + offset
    windows = _CLASS[data[at[:, None] + np.arange(WINDOW)]]
    windows[np.arange(WINDOW)[None] >= (sizes[owner] - offset)[:, None]] = 0
    return windows.astype(np.uint8), owner


def clean_unit(text: str) -> str:
    """The unit in its canonical form, look-alike letters put right."""
    if text.isascii():
        return text
    text = normalize_segments(text)
    return unify_scripts(text) if _FOREIGN.search(text) else text


_ADDRESS = re.compile(r"\S*(?:@|www\.|://)\S*|[A-Za-z0-9+/=]{25,}")


def _no_language(rng: random.Random, names: list[str]) -> str:
    kind = rng.randrange(3)
    if kind == 0:
        return "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(rng.randrange(20, 97)))
    if kind == 1 and names:
        return ", ".join(" ".join(rng.sample(names, 2)) for _ in range(rng.randrange(1, 5)))
    return rng.choice(["12:30", "3.14 %", "-----", "***", "404", "(c) 2031"]) + " " + str(rng.randrange(10**6))


def training_windows(labelled: list[tuple[str, str]], languages: tuple[str, ...], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Windows and classes of labelled units: whole, and cut at random words."""
    rng = random.Random(seed)
    index = {k: i for i, k in enumerate(languages)}
    names = sorted({w for lang, t in labelled if lang in ("en", "de", "fr", "es", "it") for w in re.findall(r"(?<=[a-z,] )[A-Z][a-z]+(?= [A-Z])", t)})
    pieces, targets = [], []
    for lang, text in labelled:
        if lang not in index:
            continue
        units = [clean_unit(text[a:b]) for a, b in text_units(text)]
        for unit in units:
            raw = unit.encode()
            words = [m.start() for m in re.finditer(r"(?<=\s)\S", unit)] or list(range(0, len(unit), 5))
            cuts = [0, *rng.sample(words, min(len(words), 1 + len(raw) // WINDOW))]
            for cut in cuts:
                piece = unit[cut : cut + rng.choice((20, 30, 45, WINDOW))]
                if sum(map(str.isalpha, piece)) >= 8 or cut == 0:
                    pieces.append(piece)
                    targets.append(index[lang])
    for _ in range(max(60, len(pieces) // 40)):
        pieces.append(_no_language(rng, names))
        targets.append(index[NONE])
    windows, owner = to_windows(pieces)
    return windows, np.array(targets)[owner]


def fit_languages(samples: DataFrame, docs: DataFrame | None = None, max_samples: int = 10_000, max_docs: int = 2000, max_units: int = 12, epochs: tuple[int, int] = (24, 3), id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> ByteNet:
    """Trains the network.

    ``samples`` (lang, text) hold at most ``max_samples`` rows. Of ``docs``
    the ``max_docs`` labelled ones with the least hash of their id serve as
    further training texts (``max_units`` random units of each), where the first network confirms the label: those
    units that it doesn't clearly give to another language. Both bounds keep training on the driver the same at
    every size of the corpus.
    """
    rows = collect_bounded(samples.select("lang", "text"), max_samples, "language samples")
    labelled = sorted((parse_label(r.lang) or NONE, r.text) for r in rows if r.text)
    languages = (*sorted({k for k, _ in labelled if k != NONE}), NONE)
    windows, targets = training_windows(labelled, languages)
    net, par = train_network(windows, targets, languages, epochs=epochs[0])
    if docs is None:
        return net
    some = docs.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    # a share of the hash range that holds a few more than max_docs, so that
    # no task sends more than its part to the driver
    rank = F.pmod(F.xxhash64(id_column), F.lit(1 << 30))
    share = min(1.0, (1.1 * max_docs + 100) / max(1, docs.select(id_column).count()))
    some = some.where(rank < int(share * (1 << 30))).select(id_column, label_column, text_column, rank.alias("_rank"))
    some = collect_bounded(some, 2 * max_docs + 1000, "labelled documents to train on")
    some = sorted(some, key=lambda r: (r[3], str(r[0])))[:max_docs]
    extra = []
    for r in sorted(some, key=lambda r: str(r[0])):
        code = parse_label(r[1])
        if code not in languages:
            continue
        text = r[2]
        units = [text[a:b] for a, b in text_units(text)]
        units = [u for u in units if len(u) >= 12]
        units = random.Random(7).sample(units, min(len(units), max_units))
        if units:
            best, owner = _unit_scores(net, [clean_unit(u) for u in units])
            own = best.argmax(1) == languages.index(code)
            if (own & (best.max(1) > np.log(0.8))).mean() >= 0.7:  # the label holds; what is doubtful goes with it
                keep = own | (best.max(1) < np.log(0.98))
                extra.extend((code, u) for u, ok in zip(units, keep) if ok)
    more, more_targets = training_windows(labelled + extra, languages, seed=6)
    net, _ = train_network(more, more_targets, languages, epochs=epochs[1], start=par, seed=2)
    return net


def _unit_scores(net: ByteNet, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of whole units: windows count as independent evidence.

    What a window gives to no language (a list of names, say) speaks for all
    languages alike.
    """
    windows, owner = to_windows(units)
    prob = np.exp(net.log_probabilities(windows))
    none = net.languages.index(NONE)
    rest = prob[:, none].copy()
    prob += rest[:, None] / (prob.shape[1] - 1)
    prob[:, none] = rest
    logp = np.log(prob + 1e-6)
    total = np.stack([np.bincount(owner, logp[:, k], len(units)) for k in range(logp.shape[1])], 1)
    total -= total.max(1, keepdims=True)
    return total - np.log(np.exp(total).sum(1, keepdims=True)), owner


# ---------------------------------------------------------------- operator

SEGMENT_SCHEMA = "doc_id bigint, segment_no bigint, begin_char bigint, end_char bigint, lang string, confidence double, sentences bigint"


_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def _signs(piece: str) -> tuple[int, int]:
    """Letters of a piece, and signs of scripts with wide ones."""
    if piece.isascii():
        return len(piece.encode().translate(None, _NO_LETTERS)), 0
    return sum(map(str.isalpha, piece)), sum(map("\u2e80".__lt__, piece))


def _ids(column: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in column]


class Detector:
    """Segments of texts with their languages."""

    def __init__(self, net: ByteNet, certain: float = 0.9, least_letters: int = 12, margin: float = 6.0):
        self.net, self.certain, self.least, self.margin = net, certain, least_letters, margin

    def segments(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float, int]]]:
        """Per text: (begin, end, language, confidence, sentences surely in it)."""
        spans, pieces, owner = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            whole = text if text.isascii() else normalize_segments(text)
            same = whole is text or whole == text
            mixed = not text.isascii() and _FOREIGN.search(whole) is not None
            for a, b in text_units(text):
                unit = text[a:b]
                if not unit.isascii():
                    unit = unit if same else normalize_segments(unit)
                    if mixed and _FOREIGN.search(unit):
                        unit = unify_scripts(unit)
                if "@" in unit or "www." in unit or len(unit) > 25 and " " not in unit:
                    unit = _ADDRESS.sub(" ", unit)
                spans.append((a, b))
                pieces.append(unit)
                owner.append(i)
        out: list[list] = [[] for _ in texts]
        if not pieces:
            return out
        scores, _ = _unit_scores(self.net, pieces)
        best = scores.argmax(1)
        conf = np.exp(scores.max(1))
        none = self.net.languages.index(NONE)
        rows = defaultdict(list)
        for j, i in enumerate(owner):
            piece = pieces[j]
            letters, wide = _signs(piece)
            weak = letters + 2 * wide < self.least or best[j] == none
            rows[i].append((*spans[j], None if weak else int(best[j]), float(conf[j]), letters + 2 * wide, j))
        for i, units in rows.items():
            out[i] = self._join(units, scores)
        return out

    def _join(self, units: list, scores: np.ndarray) -> list[tuple[int, int, str, float, int]]:
        """Adjacent units of one language as one segment.

        A unit that isn't certain takes the language of the text around it
        unless it clearly contradicts it; units in no language go along.
        """
        weight: dict[int, float] = defaultdict(float)
        for _, _, lang, conf, size, _ in units:
            if lang is not None:
                weight[lang] += conf * size
        langs = self.net.languages
        if not weight:
            return [(units[0][0], units[-1][1], NONE, float(np.mean([u[3] for u in units])), 0)]
        main = max(weight, key=weight.get)
        segments: list[list] = []
        for a, b, lang, conf, size, j in units:
            sure = 0
            if lang is None:
                chosen = None
            elif lang == main or conf >= self.certain and scores[j, lang] - scores[j, main] >= self.margin:
                chosen, sure = lang, int(conf >= self.certain or lang == main)
            else:
                chosen = main
            if segments and (chosen is None or segments[-1][2] in (None, chosen)):
                last = segments[-1]
                last[1] = b
                if last[2] is None:
                    last[2] = chosen
            else:
                segments.append([a, b, chosen, 0.0, 0.0, 0])
                last = segments[-1]
            if chosen is not None:
                last[3] += size * float(np.exp(scores[j, chosen]))
                last[4] += size
            last[5] += sure
        return [(a, b, langs[k], s / n, sure) for a, b, k, s, n, sure in segments if k is not None]


def language_segments(docs: DataFrame, net: ByteNet, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stretches of each document in one language, with confidence.

    Result: ``doc_id, segment_no, begin_char, end_char, lang, confidence,
    sentences`` (whole sentences surely in the language). ``lang`` is ``zxx``
    for a text in no language. Null, empty and blank texts give no rows, a
    null id stays null, repeated rows come out each for itself, further
    columns are ignored. Texts are classified whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                rows = []
                for doc_id, segments in zip(_ids(part["doc_id"]), detector.segments(part["text"].tolist())):
                    rows.extend((doc_id, n, *s) for n, s in enumerate(segments))
                frame = pd.DataFrame(rows, columns=["doc_id", "segment_no", "begin_char", "end_char", "lang", "confidence", "sentences"], dtype=object)
                yield frame

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(run, SEGMENT_SCHEMA)


def document_languages(docs: DataFrame, net: ByteNet, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """One row per document and language with a whole sentence in its text.

    Result: ``doc_id, label, lang, confidence, n_langs, main``: the label as
    the language it names (null if none), the language and the confidence,
    the number of such languages and whether it holds most of the text.
    Rows follow ``language_segments``; a text in no language gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = "doc_id bigint, label string, lang string, confidence double, n_langs bigint, main boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(shared.value)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.iloc[lo : lo + 200]
                rows = []
                for doc_id, label, segments in zip(_ids(part["doc_id"]), part["label"], detector.segments(part["text"].tolist())):
                    size: dict[str, float] = defaultdict(float)
                    certain: dict[str, float] = defaultdict(float)
                    for a, b, lang, conf, sure in segments:
                        if lang != NONE and sure:
                            size[lang] += b - a
                            certain[lang] += conf * (b - a)
                    for lang in size:
                        rows.append((doc_id, parse_label(label), lang, certain[lang] / size[lang], len(size), lang == max(size, key=size.get)))
                frame = pd.DataFrame(rows, columns=["doc_id", "label", "lang", "confidence", "n_langs", "main"], dtype=object)
                yield frame

    source = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"), F.col(label_column).alias("label"))
    return source.mapInPandas(run, schema)


def wrongly_labelled(languages: DataFrame) -> DataFrame:
    """``doc_id, lang`` of documents whose label is missing, or names another
    language than the text is in, or whose text is in several."""
    other: Column = F.col("label").isNull() | (F.col("n_langs") > 1) | (F.col("label") != F.col("lang"))
    return languages.where(other).select("doc_id", "lang").distinct()
