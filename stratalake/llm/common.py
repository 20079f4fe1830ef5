"""Helpers shared by the operators: scratch tables, bounded Arrow batches, word hashing."""

from __future__ import annotations

import gc
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Java and Python form of the separator of words: space, tab, newline, vertical tab, form feed, return.
GAP = r"[\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch that a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Rows that a piece of a batch holds while its arrays are computed.
PIECE_BYTES = 2 << 20


# ---------------------------------------------------------------- scratch tables


#: Scratch tables after which the driver collects its garbage: jobs in quick succession would else fill its memory with dead plans.
RELEASE_EVERY = 6
_written = itertools.count(1)


def scratch(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_written) % RELEASE_EVERY == 0:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that no later step reads."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for long texts; read when a plan is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def topmost(df: DataFrame, column: str, most: int) -> Column:
    """Which rows have the largest positive values of column, at most so many of df: whole steps of a logarithmic scale.

    Counts per step go to the driver (a few hundred), never the rows themselves.
    """
    step = F.floor(16 * F.log2(F.col(column)))
    steps = df.where(F.col(column) > 0).groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()
    total, least = 0, None
    for row in sorted(steps, key=lambda r: -r["step"]):
        total += row["n"]
        if total > most:
            break
        least = row["step"]
    return F.lit(False) if least is None else (F.col(column) > 0) & (step >= least)


def parted(df: DataFrame, column: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The topmost rows of df, and the others."""
    top = topmost(df, column, most)
    return df.where(top), df.where(~top)


def xxhash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(a, b)."""
    u = np.uint64
    p1, p2, p3, p4, p5 = u(0x9E3779B185EBCA87), u(0xC2B2AE3D27D4EB4F), u(0x165667B19E3779F9), u(0x85EBCA77C2B2AE63), u(0x27D4EB2F165667C5)
    h = np.full(len(a), 42, u)
    for x in (a, b):
        t = x * p2  # turned left by 31 bits
        s = t >> u(33)
        t <<= u(31)
        t |= s
        t *= p1
        h += p5 + u(8)
        h ^= t
        np.right_shift(h, u(37), out=s)
        h <<= u(27)
        h |= s
        h *= p1
        h += p4
        for n, p in ((33, p2), (29, p3), (32, None)):
            np.right_shift(h, u(n), out=s)
            h ^= s
            if p is not None:
                h *= p
    return h


#: Bits per key of a field, and the logarithms of its least and largest size in bits.
FIELD_BITS, FIELD_LEAST, FIELD_MOST = 16, 16, 28


def bit_field(keys: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of the (well mixed) keys with three probes: a key one of whose bits is unset is not among them.

    Its size follows the number of keys up to 32 MB; beyond that more keys only set more of its bits.
    """
    x = keys.select(F.col(column).alias("x"))
    size = min(FIELD_MOST, max(FIELD_LEAST, (FIELD_BITS * x.count()).bit_length()))
    probes = (f"shiftrightunsigned(x, {64 - size})", f"shiftrightunsigned(shiftleft(x, {size}), {64 - size})", f"shiftrightunsigned(xxhash64(x, x), {64 - size})")
    at = x.select(F.explode(F.array(*[F.expr(p) for p in probes])).alias("at"))
    bit = F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")
    found = at.groupBy(F.expr("shiftright(at, 6)").alias("i")).agg(bit).toArrow()
    bits = np.zeros(1 << (size - 6), np.uint64)
    bits[found.column("i").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return bits


def in_field(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the field."""
    size = np.uint64(len(bits).bit_length() + 5)
    rest = np.uint64(64) - size

    def probe(at: np.ndarray) -> np.ndarray:
        return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)

    out = probe(x >> rest)
    i = np.flatnonzero(out)
    i_x = x[i]
    out[i] = probe((i_x << size) >> rest)
    i = i[out[i]]
    out[i] = probe(xxhash(x[i], x[i]) >> rest)
    return out


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: its cleaner acts when the driver's JVM collects garbage,
    which by itself may be long after the files are dead."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def row_key(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with _a and _b, two hashes of these columns that tell rows apart: by 128 bits, nulls included."""
    cols = [F.col(c) for c in columns]
    cols += [F.concat(*[F.col(c).isNull().cast("string") for c in columns])]
    return docs.withColumns({"_a": F.xxhash64(*cols), "_b": F.xxhash64(F.lit("b"), *cols)})


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds, each one pre-aggregated minimum per node and one join
    whose skewed keys Spark can split; rounds grow with the logarithm of a component's length.
    """
    e = scratch(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc"
    )
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low2, "u")
        small = j.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low2.select("u", F.col("m").alias("v"))
        )
        nxt = scratch(small.where("u <> v").distinct(), "cc")
        now = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        discard(e)
        e = nxt
        if now == seen:
            break
        seen = now
    out = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = out.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    return out.unionByName(roots)


# ---------------------------------------------------------------- vectorised word hashing

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values; another salt gives an independent permutation."""
    x = x + np.uint64((int(salt) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64), 7)
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        out[1:] = base
        have = np.multiply.accumulate(out)
        if size <= 4 * PIECE_BYTES:
            _powers[int(base)] = have
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, null as empty, and where each text begins in them."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, from one running sum over all of them."""
    n = len(b)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[b] * _power(_STEP, n), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _ODD))


class Words:
    """The words of some texts: byte spans, where each document's words begin, and a 64-bit hash of each."""

    def __init__(self, texts: pa.Array, lower: bool = False, hashes: bool = True):
        raw, self.off = text_bytes(texts)
        self.raw, n = raw, len(raw)
        solid = ~_SPACE[raw]
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[inner] = False
        after[inner - 1] = False
        self.starts = np.flatnonzero(solid & ~before)
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        if hashes:
            self.hash = span_hashes(_LOWER[raw] if lower else raw, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts())

    def joined(self, d: int, keep: np.ndarray | None = None) -> bytes:
        """The words of document d (those marked in keep) joined by one space."""
        a, b = self.first[d], self.first[d + 1]
        text = self.raw.tobytes() if len(self.off) == 2 else self.raw[self.off[d] : self.off[d + 1]].tobytes()
        words = text.split()
        assert len(words) == b - a
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep, strict=True) if k])


def chained(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of k consecutive values of h (runs may cross documents: mask them)."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    m = mix(np.array([int(salt) + 11], np.uint64))[0] | np.uint64(1)
    for j in range(1, k):
        out *= m
        out += h[j : j + n]
    return mix(out, salt)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a piece's texts stay near so many bytes; one long text is a piece of its own."""
    for rb in batches:
        if not rb.num_rows:
            continue
        col = rb.column(rb.schema.get_field_index(column)).cast(pa.large_string())
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        i = 0
        while i < rb.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield rb.slice(i, j - i)
            i = j


def table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns)
    )
