"""Operator 6: quality classifier, a generalised additive model with pairwise interactions.

Spark computes a vector of text features per document in one pass. The model is fitted on a bounded sample of labelled
vectors: features are cut into quantile bins, and boosting goes round the features, one shallow tree on one feature's bins
at a time, so that each feature ends as a lookup table; then the pairs whose residuals ask most for it get
two-dimensional tables in the same way. A score is the sum of the looked-up values, computed for whole batches.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, bounded_batches, chained, mix, pieces, scratch, table

#: Labelled rows that the fit takes at most, drawn by hashes of doc_id and features.
SAMPLE = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAF = 80, 40, 0.2, 20
THRESHOLD = 0.7

_CLASSES = ["lower", "upper", "digit", "symbol", "bang", "stop", "comma", "quote", "newline", "blank", "wide", "other"]
_CLASS = np.full(256, 11, np.int64)
for _i, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>=_^~@+/\\{}[]", "!?", ".", ",;:", "'\"()-", "\n", " \t\r\x0b\x0c"]):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i
_CLASS[128:] = 10
FEATURES = [
    "log_words", "word_length", "long_words", "distinct", "repeats", "line_words", "repeated_lines", "first_upper",
    *[f"share_{c}" for c in _CLASSES],
]


def held_out(doc_id: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def _distinct(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values per document."""
    _, first = np.unique(mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(doc[first], minlength=n)


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    w = Words(texts, lower=True)
    n, words, doc, size = len(texts), w.counts(), w.doc(), np.diff(w.off)
    byte_doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(byte_doc * len(_CLASSES) + _CLASS[w.raw], minlength=n * len(_CLASSES)).reshape(n, -1)
    length = (w.ends - w.starts).astype(float)
    many = np.maximum(words, 1)
    three = chained(w.hash, 3, 51)
    inside = np.arange(len(three)) + 3 <= np.repeat(w.first[1:], words)[: len(three)]
    windows = np.bincount(doc[: len(three)][inside], minlength=n)
    # lines, by the hashes of their words
    breaks = np.concatenate([[0], np.cumsum(w.raw == 10)])
    line = breaks[w.starts] + doc * 0 if len(w.starts) else np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])])) if len(line) else line
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash)])
    line_hash = total[np.append(new[1:], len(w.hash))] - total[new] if len(new) else np.zeros(0, np.uint64)
    lines = np.bincount(doc[new], minlength=n) if len(new) else np.zeros(n, int)
    first = w.raw[w.starts] if len(w.starts) else w.raw[:0]
    per = lambda v: np.bincount(doc, weights=v, minlength=n) / many
    columns = [
        np.log1p(words), per(length), per(length > 12), _distinct(w.hash, doc, n) / many,
        1 - _distinct(three[inside], doc[: len(three)][inside], n) / np.maximum(windows, 1), words / np.maximum(lines, 1),
        1 - _distinct(line_hash, doc[new], n) / np.maximum(lines, 1), per((first >= 65) & (first <= 90)),
    ]
    return np.column_stack([*columns, *(kinds / np.maximum(size, 1)[:, None]).T]).astype(np.float32)


def _feature_rows(batches):
    for rb in pieces(batches):
        x = features(rb.column("text"))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
        yield table(doc_id=rb.column("doc_id"), x=values)


class Additive:
    """Lookup tables over binned features and pairs of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        q = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, q)) for c in x.T]
        qp = np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.coarse = [np.unique(np.quantile(c, qp)) for c in x.T]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        if len(np.unique(y)) < 2:
            return
        bins = [np.searchsorted(c, v, "right") for c, v in zip(self.cuts, x.T, strict=True)]
        f = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                p = 1 / (1 + np.exp(-f))
                g, h = np.bincount(b, y - p, len(self.tables[j])), np.bincount(b, p * (1 - p), len(self.tables[j]))
                step = RATE * _tree(g, h, np.bincount(b, minlength=len(g)), 2)
                self.tables[j] += step
                f += step[b]
        coarse = [np.searchsorted(c, v, "right") for c, v in zip(self.coarse, x.T, strict=True)]
        p = 1 / (1 + np.exp(-f))
        gains = []
        for a, b in combinations(range(x.shape[1]), 2):
            shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            at = coarse[a] * shape[1] + coarse[b]
            g, h = np.bincount(at, y - p, shape[0] * shape[1]), np.bincount(at, p * (1 - p), shape[0] * shape[1])
            gains.append((float((g * g / (h + 1)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.pair_tables = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                at = coarse[a] * t.shape[1] + coarse[b]
                p = 1 / (1 + np.exp(-f))
                g, h = (np.bincount(at, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p)))
                step = RATE * _grid(g, h, np.bincount(at, minlength=t.size).reshape(t.shape))
                t += step
                f += step.ravel()[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for c, t, v in zip(self.cuts, self.tables, x.T, strict=True):
            f += t[np.searchsorted(c, v, "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            f += t[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-f))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Best gain and place of a cut of the bins in two."""
    G, H, N = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = G**2 / (H + 1) + (g.sum() - G) ** 2 / (h.sum() - H + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((N >= LEAF) & (n.sum() - N >= LEAF), gain, -1.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin in a tree of the given depth."""
    gain, k = _split(g, h, n) if depth else (-1.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + 1))
    return np.concatenate([_tree(g[:k], h[:k], n[:k], depth - 1), _tree(g[k:], h[k:], n[k:], depth - 1)])


def _grid(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A cut along the better axis, and one in each half along the other."""
    (gain, k), (gain1, k1) = _split(*(v.sum(1) for v in (g, h, n))), _split(*(v.sum(0) for v in (g, h, n)))
    if max(gain, gain1) <= 1e-9:
        return np.zeros_like(g)
    if gain1 > gain:
        return _grid(g.T, h.T, n.T).T
    halves = [np.broadcast_to(_tree(*(v[s].sum(0) for v in (g, h, n)), 1), g[s].shape) for s in (slice(0, k), slice(k, None))]
    return np.concatenate(halves)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted per row of docs (doc_id, text), learning from labels (doc_id, label).

    Rows held out by crc32 of doc_id never train; a null doc_id has no label and is not held out. Labels other than 0
    and 1, null ones, and labels of no document are left aside. Null and empty texts are scored by their (zero) features.
    A text is worked on whole in one task, at some 60 bytes of memory for each of its bytes. Rows of one doc_id and several
    texts share its label. Without labels every score is 0.5, with labels of one class all scores are its smoothed rate. Other columns are
    ignored; repeated rows come back as often as they came. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = scratch(rows.mapInArrow(_feature_rows, "doc_id long, x array<float>"), "features")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    marks = marks.distinct()
    # a repeated doc_id brings all its rows: the bound is on rows, drawn by a hash of id and features
    n = x.select("doc_id").join(marks, "doc_id").count()
    share = int((1 << 20) * min(1.0, 0.97 * SAMPLE / max(1, n)))  # 0.97: the draw stays under the limit
    drawn = x.where(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 20)) < share)
    known = drawn.join(marks, "doc_id").select("x", "y").limit(SAMPLE).toArrow()
    y = known.column("y").to_numpy().astype(float)
    known = known.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort((y, *known.T)) if len(y) else []  # the fit does not depend on the order of arrival
    model = Additive(known[order], y[order]) if len(y) else None

    def run(batches):
        for rb in batches:
            v = rb.column("x").flatten().to_numpy().reshape(rb.num_rows, -1)
            yield table(doc_id=rb.column("doc_id"), score=model.score(v) if model else np.full(rb.num_rows, 0.5))

    s = x.mapInArrow(run, "doc_id long, score double")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
