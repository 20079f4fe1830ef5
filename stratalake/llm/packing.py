"""Operator 10: packing tokenised documents into sequences of fixed length by non-negative least squares.

A document's tokens are cut every ``length`` ids; what is left over is a remainder. The histogram of remainder lengths is
small (one number per length) whatever the corpus. All combinations of two or three occurring lengths that fill a sequence
are enumerated, their repeat counts solve a non-negative least-squares fit to the histogram and are rounded down, and the
residual histogram is packed greedily, largest first. The pieces themselves never leave Spark: each gets its rank among
pieces of its length (ranks of hash buckets plus offsets of the buckets), and a table of (length, ranks) -> sequence places it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, pieces, scratch, span_hashes, table, text_bytes

LENGTH, END_ID = 2048, 1
#: Words whose ids a worker keeps; a full table is emptied.
CACHE = 400_000
#: Steps of the least-squares fit at most; it ends earlier when a step changes no count by this much.
STEPS, SMALL = 500, 0.01


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: The splitting rule of byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EDGE = np.zeros(256, bool)
_EDGE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: White space beyond ASCII as UTF-8 (fixed values).
WIDE_GAPS = [c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
_LEAD = np.zeros(256, bool)
_LEAD[[c[0] for c in WIDE_GAPS]] = True


class Encoder:
    """Ids of texts, as arrays of unsigned 32-bit integers.

    By the vocabulary's splitting rule a single space between two other characters always begins a token. So a text is
    cut there, and each distinct word (with the space before it) is encoded once and then found by its hash. Texts in
    which other white space touches a space, or that hold wide white space or an added token's text, are encoded whole.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # the same vocabulary for single words: a byte-level vocabulary's ids are its ranks
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain}
        byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        vocab = made["model"]["vocab"]
        self.added = [x["content"].encode() for x in made.get("added_tokens") or [] if x["content"]]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t)}
        ranks = {t: i for t, i in ranks.items() if t not in self.added}
        self.words = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._reset()

    def _reset(self) -> None:
        self.key, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = [np.zeros(0, "<u4")]
        self.held = 0

    def _learn(self, key: np.ndarray, chunks: list[bytes]) -> None:
        if len(self.key) > CACHE:
            self._reset()
        ids = [self.words.encode_ordinary(c.decode()) for c in chunks]
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.array([y for x in ids for y in x], "<u4")
        self.pool = [np.concatenate([*self.pool, flat])]
        at = self.held + np.cumsum(n) - n
        self.held += len(flat)
        where = np.searchsorted(self.key, key)
        self.key, self.at, self.n = (np.insert(x, where, y) for x, y in ((self.key, key), (self.at, at), (self.n, n)))

    def _find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, key)
        i = np.minimum(i, max(0, len(self.key) - 1))
        return i, (self.key[i] == key) if len(self.key) else np.zeros(len(key), bool)

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        raw, off = text_bytes(texts)
        n = len(raw)
        if not n:
            return [np.zeros(0, "<u4")] * len(texts)
        space = np.flatnonzero(raw == 32)
        full = off[:-1][np.diff(off) > 0]
        # a chunk begins at a text's start or at a space (which it holds), unless the text begins with it
        starts = np.union1d(space, full)
        ends = np.append(starts[1:], n)
        doc = np.searchsorted(off, starts, "right") - 1
        lead = raw[starts] == 32
        body = starts + lead
        odd = lead & ((body >= ends) | _EDGE[raw[np.minimum(body, n - 1)]])
        before_space = np.append(lead[1:] & (doc[1:] == doc[:-1]), False)
        odd |= before_space & _EDGE[raw[ends - 1]]
        odd |= lead & np.isin(starts, full)
        exotic = np.zeros(len(texts), bool)
        exotic[doc[odd]] = True
        for i in np.flatnonzero(_LEAD[raw]).tolist():
            if raw[i : i + 3].tobytes().startswith(tuple(WIDE_GAPS)):
                exotic[np.searchsorted(off, i, "right") - 1] = True
        text = raw.tobytes()
        for word in self.added:
            i = text.find(word)
            while i >= 0:
                exotic[np.searchsorted(off, i, "right") - 1] = True  # one that crosses two texts does no harm
                i = text.find(word, i + 1)
        use = ~exotic[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        key = span_hashes(raw, starts, ends)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        i, known = self._find(distinct)
        if not known.all():
            fresh = len(self.key) > CACHE
            new = np.ones(len(distinct), bool) if fresh else ~known
            f = first[new]
            self._learn(distinct[new], [text[a:b] for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
            i, known = self._find(distinct)
        at, size = self.at[i][back], self.n[i][back]
        stop = np.cumsum(size)
        begin = stop - size
        flat = self.pool[0][np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(at - begin, size)]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        bound = np.append(begin, len(flat))
        out = [flat[bound[a] : bound[b]] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        for d in np.flatnonzero(exotic).tolist():
            ids = self.whole.encode(texts[d].as_py(), add_special_tokens=False).ids
            out[d] = np.array(ids, "<u4")
        return out


def _piece_rows(path: str, length: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end = Encoder(path), np.array([END_ID], "<u4")
        again: dict[tuple, int] = {}  # equal pieces of one doc_id (or none) are told apart, so that their buckets differ
        for rb in pieces(batches):
            out = []
            for doc, ids in zip(rb.column("doc_id").to_pylist(), encode(rb.column("text")), strict=True):
                ids = np.concatenate([ids, end]).tobytes()
                n = len(ids) // 4
                for a in range(0, n, length):
                    b = min(n, a + length)
                    crc = zlib.crc32(ids[4 * a : 4 * b])
                    again[doc, a, crc] = nth = again.get((doc, a, crc), -1) + 1
                    out.append((doc, a, b - a, crc, n, nth))
            if len(again) > CACHE:
                again = {}
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            yield table(**dict(zip((*PIECE, "nth"), cols, strict=True)))

    return run


def combinations(have: np.ndarray, length: int) -> np.ndarray:
    """All twos and threes of lengths that occur and fill a sequence exactly, one per row, 0 in place of a third."""
    there = np.flatnonzero(have)
    there = there[there > 0]
    a = there[2 * there <= length]
    a = a[have[length - a] > 0]
    found = [np.stack([length - a, a, np.zeros_like(a)], 1)]
    for x in there[3 * there <= length].tolist():
        y = there[(there >= x) & (2 * there <= length - x)]
        y = y[have[length - x - y] > 0]
        found.append(np.stack([length - x - y, y, np.full_like(y, x)], 1))
    return np.concatenate(found)


def solve(hist: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the sum of x times combination nearest to the histogram in the sense of least squares:
    accelerated projected gradients, all combinations at once."""
    m, size = combos > 0, len(hist)
    x = np.zeros(len(combos))
    if not len(combos):
        return x
    spread = lambda v: np.bincount(combos[m], weights=np.repeat(v, m.sum(1)), minlength=size)  # noqa: E731  A v
    sums = lambda r: (r[combos] * m).sum(1)  # noqa: E731  A' r
    v = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = sums(spread(v))
        bound = float(np.sqrt(v @ v))
        v /= bound
    step, y, t = 1 / (1.05 * bound), x, 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y + step * sums(hist - spread(y)))
        moved = float(np.abs(new - x).max())
        if (y - new) @ (new - x) > 0:  # momentum against the descent is dropped
            t = 1.0
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t_new * (new - x), t_new
        if moved < SMALL:
            break
    return x


def plan(hist: np.ndarray, length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use up the histogram (index: length of a remainder) exactly."""
    left, out = hist.astype(np.int64).copy(), []
    combos = combinations(left, length)
    x = solve(left.astype(float), combos)
    order = np.argsort(-x, kind="stable")
    for c, times in zip(combos[order].tolist(), x[order].tolist(), strict=True):
        if times + 1e-6 < 1:
            break
        at, n = np.unique([z for z in c if z], return_counts=True)
        if (k := min(int(times + 1e-6), int((left[at] // n).min()))) > 0:
            out.append((tuple(z for z in c if z), k))
            left[at] -= k * n
    there = np.flatnonzero(left).tolist()
    while there:
        seq, room, used = [], length, {}
        i = len(there)
        while (i := bisect_right(there, room, 0, i)) > 0:
            size = there[i - 1]
            take = min(room // size, int(left[size]) - used.get(size, 0))
            seq += [size] * take
            used[size] = used.get(size, 0) + take
            room -= take * size
            i -= 1
        k = min(int(left[s]) // n for s, n in used.items() if n)
        out.append((tuple(seq), k))
        for s, n in used.items():
            left[s] -= k * n
            if not left[s]:
                there.remove(s)
    return out


def _placed(patterns: list[tuple[tuple[int, ...], int]], length: int, first_sequence: int):
    """Looks up sequence and offset of the piece that is number rank among those of its length."""
    begin, used, seq = [], {}, first_sequence
    for lens, k in patterns:
        offset = 0
        for x in lens:
            begin.append((x, used.get(x, 0), seq, offset))
            used[x] = used.get(x, 0) + k
            offset += x
        seq += k
    t = np.array(sorted(begin) or [(0, 0, 0, 0)], np.int64)
    key = (t[:, 0] << 44) + t[:, 1]

    def run(batches):
        for rb in batches:
            size, rank = rb.column("length").to_numpy(), rb.column("rank").to_numpy()
            i = np.maximum(np.searchsorted(key, (size << 44) + rank, "right") - 1, 0)
            full = size == length
            cols = {c: rb.column(c) for c in rb.schema.names if c != "rank"}
            yield table(
                **cols, sequence_id=np.where(full, rank, t[i, 2] + rank - t[i, 1]), offset=np.where(full, 0, t[i, 3])
            )

    return run


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of docs (doc_id, text).

    Ids are those that tokenizers gives for the file at path without adding special tokens (the text of an added token inside
    a document is that token), then END_ID; null and empty texts are that one id. Other columns are ignored; repeated rows are
    documents of their own; rows with a null doc_id keep it. An empty table gives an empty result. Sequence numbers begin at 0
    with the full pieces. A text is encoded whole in one task, at some 40 bytes of memory for each of its bytes.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    p = scratch(rows.mapInArrow(_piece_rows(path or tokenizer_path(), length), ", ".join(f"{c} long" for c in (*PIECE, "nth"))), "pieces")
    n = p.count()
    buckets = max(64, n // 50_000)
    p = p.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "nth"), F.lit(buckets)).cast("int"))
    counts = scratch(p.groupBy("length", "bucket").agg(F.count("*").alias("n")), "counts")
    run = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "bucket", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    hist = np.zeros(length + 1, np.int64)
    for r in total:
        hist[r["length"]] = r["n"]
    full, hist[length] = int(hist[length]), 0
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens", "nth")
    ranked = p.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select(*PIECE, (F.col("own") + F.col("before")).alias("rank"))
    fields = ", ".join(f"{c} long" for c in (*PIECE, "sequence_id", "offset"))
    return ranked.mapInArrow(_placed(plan(hist, length), length, full), fields)
