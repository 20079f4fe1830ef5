"""Operator 9: removal of repeated passages by prefix-partitioned suffix trees.

A repeat is a word sequence of ``window`` words or more that two suffixes of the corpus begin with, so it is an internal
node of that depth in the suffix tree over words.

1. Pruning. Every window has one smallest ``GRAM``-word gram (its anchor), the same wherever the window occurs. A window
   whose anchor occurs once only is a leaf of its own: its suffix needs no place in a tree.
2. Splitting. What is left are runs of suffixes that begin one word apart and share an anchor. A run is handed on as the
   words themselves, once for all its suffixes. Groups are formed by a word prefix of variable length: the anchor's
   ``GRAM`` words, or, where the anchor occurs more often than ``SPLITS`` says, the first 12, 16 or all ``window`` words of
   each suffix. The length follows from the anchor's count over all documents, so that a group fits a task.
3. Building. Each task sorts the suffixes of its groups as word sequences and takes the common-prefix lengths of
   neighbours; neighbours that share ``window`` words or more hang below one deep internal node. A node's first leaf in the
   order of (doc_id, start) stays, its other leaves are removals; adjacent ones make up the maximal repeats.

A task merges equal runs among its own rows before anything is shuffled, so that one passage held by a third of all rows
sends one row per task and flush.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Words, bit_field, bounded_batches, chained, discard, in_field, mix, pieces, release, scratch, table

GRAM = 8
#: Occurrences of an anchor beyond which its suffixes are grouped by a longer prefix, and that prefix's words (at most the window).
SPLITS = ((4096, 12), (32_768, 16), (131_072, 1 << 30))
#: Suffixes of one run; grams, and suffixes, that a task gathers before it hands them on; runs that are sorted at a time.
RUN, FLUSH, SORTED = 64, 1 << 19, 16_384


def _slide(x: np.ndarray, k: int, op) -> np.ndarray:
    """op over every k consecutive values."""
    out, have = x, 1
    while have < k:
        step = min(have, k - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def _minimal(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams; the smallest gram of each window; whether the window lies in one document."""
    n, wide = len(w.hash), window - gram + 1
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = chained(w.hash, gram, 31)
    low = _slide(grams, wide, np.minimum)
    end = np.repeat(w.first[1:], w.counts())
    return grams, low, np.arange(len(low)) + window <= end[: len(low)]


def _anchor_rows(window: int, gram: int):
    """x, r, pos, n: an anchor once per flush with one place and its count, and with n = 0 each further place of it."""

    def run(batches):
        held, size = [], 0

        def flush():
            grams, r, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(grams, kind="stable")
            grams, r, pos = grams[order], r[order], pos[order]
            new = np.concatenate([[True], grams[1:] != grams[:-1]])[: len(grams)]
            n = np.zeros(len(grams), np.int64)
            n[new] = np.diff(np.append(np.flatnonzero(new), len(grams)))
            apart = mix(r.view(np.uint64) + pos.astype(np.uint64), 5)  # known to be repeated: these rows need not meet
            return table(x=np.where(new, grams, apart).view(np.int64), r=r, pos=pos, n=n)

        for rb in pieces(batches):
            w = Words(rb.column("text"))
            grams, low, ok = _minimal(w, window, gram)
            pad = np.zeros(window - gram, np.uint64)
            pick = _slide(np.concatenate([pad, np.where(ok, low, 0), pad]), window - gram + 1, np.maximum) == grams if len(low) else ok
            at = np.flatnonzero(pick)
            doc = w.doc()[at]
            held.append((grams[at], rb.column("r").to_numpy()[doc], (at - w.first[doc]).astype(np.int64)))
            size += len(at)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _run_rows(window: int, gram: int, fields):
    """key, d, t, f, n, text: a run of n suffixes for the tree of its prefix; without text, one that an earlier run of this
    flush repeats. f holds the first start, and whether the doc_id is null."""

    def run(batches):
        bits = fields.value
        first: dict[tuple[int, bytes], tuple] = {}
        known: list[tuple] = []
        size = 0

        def flush():
            spread = mix(np.arange(len(known), dtype=np.uint64), len(first)).view(np.int64).tolist()
            rows = [(key, d, t, f, n, text) for (key, text), (_, d, t, f, n) in first.items()]
            rows += [(key, d, t, f, n, None) for key, (_, d, t, f, n) in zip(spread, known, strict=True)]
            types = dict.fromkeys(("key", "d", "t", "f", "n"), pa.int64()) | {"text": pa.string()}
            return table(**{c: pa.array(v, types[c]) for c, v in zip(types, zip(*rows, strict=True), strict=True)})

        for rb in pieces(batches):
            w = Words(rb.column("text"))
            grams, low, ok = _minimal(w, window, gram)
            if not len(low):
                continue
            pos = rb.column("pos")
            flat, off = pos.flatten().to_numpy(), pos.offsets.to_numpy()
            at = flat + np.repeat(w.first[:-1], np.diff(off))
            s = np.flatnonzero(ok & np.isin(low, np.unique(grams[at[at < len(grams)]])))
            if not len(s):
                continue
            doc, anchor = w.doc()[s], low[s]
            level = np.zeros(len(s), np.int64)
            for k, field in enumerate(bits, 1):
                level[in_field(field, anchor)] = k
            key = anchor.copy()
            for k, (_, words) in enumerate(SPLITS, 1):
                if (m := level == k).any():
                    key[m] = chained(w.hash, min(words, window), 47 + k)[s[m]]
            new = np.concatenate([[True], (np.diff(s) != 1) | (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
            begin = np.flatnonzero(new)
            inside = np.arange(len(s)) - begin[np.cumsum(new) - 1]
            begin = np.flatnonzero(inside % RUN == 0)
            n = np.diff(np.append(begin, len(s)))
            a, doc, size = s[begin], doc[begin], size + len(s)
            raw = w.raw.tobytes()
            d, t, z = (rb.column(c).to_numpy(zero_copy_only=False)[doc] for c in ("d", "t", "z"))
            f = ((a - w.first[doc]) << 1) | z.astype(np.int64)
            spans = zip(w.starts[a].tolist(), w.ends[a + n + window - 2].tolist(), strict=True)
            for key_, x, y, d_, t_, f_, n_ in zip(key[begin].view(np.int64).tolist(), *zip(*spans, strict=True), d.tolist(), t.tolist(), f.tolist(), n.tolist(), strict=True):
                text = raw[x:y]
                me = (f_ & 1, d_, t_, f_, n_)
                other = first.setdefault((key_, text), me)
                if other != me:
                    if me < other:
                        first[key_, text], me = me, other
                    known.append(me)
            if size >= FLUSH:
                yield flush()
                first, known, size = {}, [], 0
        if first:
            yield flush()

    return run


def suffix_order(w: Words, start: np.ndarray, depth: int, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that begin at these words as word sequences of depth words, then by more values (last first);
    for each suffix in it, the words it shares with the one before (0 for the first)."""
    _, ids = np.unique(w.hash, return_inverse=True)
    bits = max(1, int(ids.max()).bit_length())
    words = ids[start[:, None] + np.arange(depth)]
    each = 63 // bits
    packed = []
    for a in range(0, depth, each):
        col = np.zeros(len(start), np.int64)
        for j in range(a, min(depth, a + each)):
            col = (col << bits) | words[:, j]
        packed.append(col)
    order = np.lexsort((*then, *packed[::-1]))
    words = words[order]
    unlike = words[1:] != words[:-1]
    shared = np.where(unlike.any(1), unlike.argmax(1), depth)
    return order, np.concatenate([np.zeros(1, np.int64), shared])


def _trees(window: int):
    """d, t, z, start, n: runs of removals, from runs of suffixes in the order of their prefix keys."""

    def leaves(rows: pa.Table):
        w = Words(rows.column("text").combine_chunks())
        n, f = rows.column("n").to_numpy(), rows.column("f").to_numpy()
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        d, t, z, start = rows.column("d").to_numpy()[own], rows.column("t").to_numpy()[own], f[own] & 1, (f[own] >> 1) + step
        order, shared = suffix_order(w, w.first[own] + step, window, start, t, d, z)
        d, t, z, start = d[order], t[order], z[order], start[order]
        node = np.maximum.accumulate(np.where(shared >= window, 0, np.arange(len(d))))  # first leaf below the same deep node
        out = (d != d[node]) | (t != t[node]) | (z != z[node]) | (start != start[node])
        d, t, z, start = d[out], t[out], z[out], start[out]
        order = np.lexsort((start, t, d, z))
        d, t, z, start = d[order], t[order], z[order], start[order]
        if not len(d):
            return None
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1]) | (np.diff(start) > 1)])
        a = np.flatnonzero(new)
        last = np.append(a[1:], len(d)) - 1
        return table(d=d[a], t=t[a], z=z[a].astype(bool), start=start[a], n=start[last] - start[a] + 1)

    def run(batches):
        held, size, enough = [], 0, SORTED
        for rb in batches:
            known = rb.filter(pc.is_null(rb.column("text")))
            if known.num_rows:
                f = known.column("f").to_numpy()
                yield table(d=known.column("d"), t=known.column("t"), z=(f & 1).astype(bool), start=f >> 1, n=known.column("n"))
            held.append(rb.filter(pc.is_valid(rb.column("text"))))
            size += held[-1].num_rows
            if size >= enough:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
                if cut and (out := leaves(rows.slice(0, cut))) is not None:
                    yield out
                held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
                enough = max(SORTED, 2 * size)
        if size and (out := leaves(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _cut(window: int, want_texts: bool):
    """Per document: what is left of its words, and (if wanted) the text with the removed words' spans cut out."""

    def run(batches):
        for rb in pieces(batches):
            w = Words(rb.column("text"), hashes=False)
            gone = rb.column("gone")
            off = gone.offsets.to_numpy() - gone.offsets[0].as_py()
            start, count = (gone.flatten().field(c).to_numpy() for c in ("start", "n"))
            n, sha, texts = [], [], []
            for i in range(rb.num_rows):
                a, b = w.first[i], w.first[i + 1]
                step = np.zeros(b - a + 1, np.int64)
                s, m = start[off[i] : off[i + 1]], count[off[i] : off[i + 1]]
                np.add.at(step, s, 1)
                np.add.at(step, s + m - 1 + window, -1)
                keep = np.cumsum(step)[:-1] == 0
                body = w.joined(i, keep)
                n.append(int(len(keep) - keep.sum()))
                sha.append(hashlib.sha256(body).hexdigest())
                if not want_texts:
                    texts.append(None)
                    continue
                raw, parts = w.raw, []
                at, stop = w.off[i], w.off[i + 1]
                edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                for x, y in zip(edge[::2], edge[1::2], strict=True):  # words x..y-1 go, with the white space that follows
                    parts.append(raw[at : w.starts[a + x]])
                    at = w.starts[a + y] if a + y < b else stop
                parts.append(raw[at:stop])
                texts.append(b"".join(p.tobytes() for p in parts))
            yield table(
                d=rb.column("d"), t=rb.column("t"), z=rb.column("z"), n_removed=pa.array(n, pa.int64()),
                kept_sha256=pa.array(sha, pa.string()), kept_text=pa.array(texts, pa.binary()).cast(pa.string()),
            )

    return run


def _whole(batches):
    for rb in pieces(batches):
        w = Words(rb.column("text"), hashes=False)
        sha = [hashlib.sha256(w.joined(i)).hexdigest() for i in range(rb.num_rows)]
        cols = {c: rb.column(c) for c in rb.schema.names if c != "text"}
        yield table(**cols, n_words=w.counts().astype(np.int64), whole_sha256=pa.array(sha, pa.string()))


KEY = ["d", "t", "z"]


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the key of a document: (d, t, z). Rows of one doc_id and one text are one document; z marks a null doc_id.

    The order of documents is that of (z, d, t): doc_id first, null last, then a hash of the text. Texts are told apart by
    64 bits within a doc_id, and by 128 bits among null ones.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    id_ = F.col(doc_id).cast("long")
    return docs.withColumns({"d": F.coalesce(id_, F.xxhash64(F.lit("d"), body)), "t": F.xxhash64(body), "z": id_.isNull()})


def once(docs: DataFrame) -> DataFrame:
    """docs (KEY, text) with one row of each document. Only rows that come again are shuffled, and each task merges its own first."""
    again = scratch(docs.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*KEY), "again")
    some = again.count()
    if not some:
        return docs
    again = F.broadcast(again) if some <= 100_000 else again
    repeated = docs.join(again, KEY, "left_semi").dropDuplicates(KEY)
    return docs.join(again, KEY, "left_anti").unionByName(repeated)


def removals(docs: DataFrame, window: int = 20, texts: bool = True) -> DataFrame:
    """d, t, z, n_removed, kept_sha256, kept_text (null without texts) of each document that loses words.

    docs: the key of keyed(), and text (not null). Starts are judged on the input.
    """
    spark = docs.sparkSession
    docs = once(docs)
    gram = min(GRAM, window)
    r = F.xxhash64(*KEY)  # equal values only bring more candidates
    rows = docs.select(r.alias("r"), "text").mapInArrow(_anchor_rows(window, gram), "x long, r long, pos long, n long")
    rows = rows.withColumn("seen", F.sum("n").over(Window.partitionBy("x")))
    anchors = scratch(rows.where("n = 0 or seen > 1").select("x", "r", "pos", "n"), "anchors")
    often = anchors.where("n > 0").groupBy("x").agg(F.sum("n").alias("n")).where(F.col("n") > SPLITS[0][0])
    often = scratch(often, "often")
    fields = spark.sparkContext.broadcast([bit_field(often.where(F.col("n") > n), "x") for n, _ in SPLITS])

    places = anchors.groupBy("r").agg(F.collect_list("pos").alias("pos"))
    held = docs.select(r.alias("r"), *KEY, "text").join(places, "r").select(*KEY, "text", "pos")
    held = scratch(held, "repeating")
    discard(anchors, often)
    release(spark)
    runs = held.mapInArrow(_run_rows(window, gram, fields), "key long, d long, t long, f long, n long, text string")
    runs = runs.repartition("key").sortWithinPartitions("key")
    gone = runs.mapInArrow(_trees(window), "d long, t long, z boolean, start long, n long")
    gone = gone.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n")).alias("gone"))
    gone = scratch(gone, "gone")
    release(spark)
    cut = held.select(*KEY, "text").join(gone, KEY)
    cut = cut.mapInArrow(_cut(window, texts), "d long, t long, z boolean, n_removed long, kept_sha256 string, kept_text string")
    out = scratch(cut, "cut")
    discard(held, gone)
    return out


def dedup_report(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs (doc_id, text); other columns are ignored.

    A word goes if a window of ``window`` consecutive words of its document covers it whose words also start earlier: in
    a document of smaller doc_id, or earlier in the same one. Null texts have no words. Rows of one doc_id and one text are
    one document and get one answer; several texts of one doc_id are documents of their own, in the order of a hash of the
    text, and so are texts without doc_id, after all others. An empty table gives an empty result. A text is worked on
    whole in one task, at some 60 bytes of memory for each of its bytes.
    """
    bounded_batches(docs.sparkSession)
    docs = keyed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    cut = removals(docs.select(*KEY, "text"), window, texts=False).drop("kept_text")
    whole = docs.select(F.col("doc_id").cast("long"), *KEY, "text").mapInArrow(_whole, "doc_id long, d long, t long, z boolean, n_words long, whole_sha256 string")
    out = whole.join(cut, KEY, "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"),
    )


def dedup_texts(docs: DataFrame, window: int = 20) -> DataFrame:
    """The rows of docs with repeated passages cut out of text; rows left without a word go. Other columns stay.

    Rows are documents as in dedup_report. Texts that lose nothing stay as they are, byte for byte; null texts stay null.
    """
    bounded_batches(docs.sparkSession)
    plain = keyed(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    cut = removals(plain.select(*KEY, "text"), window).select(*KEY, "kept_text")
    out = keyed(docs.select(F.struct("*").alias("doc")), "doc.doc_id", "doc.text").join(cut, KEY, "left")
    out = out.where(F.col("kept_text").isNull() | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    text = F.coalesce("kept_text", F.col("doc.text").cast("string"))
    return out.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")
