"""Operator 1: embedding near-duplicates by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on Gaussian directions, shifted and cut into cells of a fixed width; ``hashes`` cells make
a table's bucket, and vectors that share a bucket in any of ``tables`` tables are compared exactly. Two unit vectors of
cosine 0.9 are 0.447 apart and share one cell of width 4 * 0.447 with probability 0.80, unrelated ones with 0.44; the
number of hashes grows with the logarithm of the number of vectors so that chance meetings stay a fixed number per table
and vector, and the number of tables follows from the recall asked for.

Directions and vectors are rounded to whole numbers before they are multiplied, so that cells come out the same wherever
they are computed. A row of a table is the vector as it came; which tables a linked pair shares is computed again where it
was found, and the pair counts in the first of them: links are counted without a shuffle of pairs. Equal vectors are one class
that is compared once. A bucket of more than ``BLOCK`` rows is dealt out in pairs of blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, mix, scratch, table

COSINE = 0.9
BLOCK = 1024
SEED = 20
#: Chance meetings per table that hashes are chosen for, at this many vectors.
HASHES, VECTORS = 6, 50_000
#: Whole steps of a vector's unit and of a direction's.
_UNIT, _STEP = 1 << 16, 1 << 10


def parameters(n: int, cosine: float = COSINE, recall: float = 0.99) -> tuple[float, int, int]:
    """Cell width, hashes per table and tables for n vectors; recall is that of pairs right at the threshold."""
    apart = math.sqrt(2 - 2 * cosine)
    width = 4 * apart

    def meet(c: float) -> float:
        r = width / c
        return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    near, far = meet(apart), meet(math.sqrt(2))
    hashes = max(HASHES - 2, round(HASHES + math.log(max(n, 1) / VECTORS) / -math.log(far)))
    return width, hashes, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes))


def usable(kind: pa.DataType):
    """vec_id and the vector's bytes as it came (kind: of its components); null where it links with nothing."""
    size = kind.to_pandas_dtype()().itemsize

    def run(batches):
        for rb in batches:
            e = rb.column("embedding")
            n = np.diff(e.offsets.to_numpy()) if len(e) else np.zeros(0, np.int64)
            n = np.where(np.asarray(e.is_valid()), n, 0)
            flat = e.flatten()  # without those of null lists
            values = np.asarray(flat.fill_null(float("nan")), kind.to_pandas_dtype())
            end = np.cumsum(n)
            ok = np.zeros(len(n), bool)
            full = np.flatnonzero(n)
            if len(full):
                at = (end - n)[full]
                ok[full] = np.logical_and.reduceat(np.isfinite(values), at) & np.logical_or.reduceat(values != 0, at)
            raw = values.tobytes()
            made = [raw[(b - k) * size : b * size] if g else None for b, k, g in zip(end.tolist(), n.tolist(), ok.tolist(), strict=True)]
            yield table(vec_id=rb.column("vec_id"), raw=pa.array(made, pa.binary()))

    return run


def units(raw: list[bytes], dtype) -> np.ndarray:
    """Unit vectors of the rows, all of one length, in double precision and without overflow or underflow of squares."""
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Hasher:
    """Buckets of unit vectors in each table."""

    def __init__(self, width: float, hashes: int, tables: int):
        self.hashes, self.tables = hashes, tables
        self.width = round(width * _UNIT * _STEP)
        self.shift = np.floor(np.random.default_rng(SEED + 1).uniform(0, self.width, tables * hashes))
        self.planes: dict[int, np.ndarray] = {}

    def __call__(self, x: np.ndarray, tables: int | None = None) -> np.ndarray:
        """One row per vector, one column per table (or for the first tables)."""
        n, d = x.shape
        tables = self.tables if tables is None else tables
        if d not in self.planes:
            self.planes[d] = np.rint(np.random.default_rng(SEED).normal(size=(d, self.tables * self.hashes)) * _STEP)
        # whole numbers of under 2 ** 53: the sum is exact in any order
        cells = np.floor((np.rint(x * _UNIT) @ self.planes[d][:, : tables * self.hashes] + self.shift[: tables * self.hashes]) / self.width)
        cells = cells.astype(np.int64).view(np.uint64).reshape(n, tables, self.hashes)
        h = np.full((n, tables), np.uint64(d))
        for j in range(self.hashes):
            h = mix(h ^ cells[:, :, j], j + 1)
        return h


NODE = ("z", "low", "c1")


def _buckets(hasher: Hasher, dtype, whole: bool):
    """A row for each vector and table; with whole, also the node, its copies and the vector."""

    def run(batches):
        for rb in batches:
            raw = rb.column("raw").to_pylist()
            size = np.array([len(x) for x in raw], np.int64)
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                h = hasher(units([raw[i] for i in rows.tolist()], dtype)).view(np.int64)
                part = rb.take(pa.array(rows))
                more = {c: part.column(c) for c in (*NODE, "copies", "raw")} if whole else {}
                for t in range(hasher.tables):
                    yield table(t=np.full(len(rows), t, np.int32), bucket=h[:, t], size=np.full(len(rows), d, np.int32), **more)

    return run


MEET = ("t", "bucket", "size", "i", "j")


def _lowest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the lowest row that the pairs (x, y) connect it with."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, x, low[y])
        np.minimum.at(low, y, low[x])
        low = low[low]
        if (low == was).all():
            return low


def _compare(cosine: float, hasher: Hasher, dtype):
    def meet(rows: pa.Table):
        t, inside = rows.column("t")[0].as_py(), rows.column("i")[0] == rows.column("j")[0]
        x = units(rows.column("raw").to_pylist(), dtype)
        copies, side = rows.column("copies").to_numpy(), rows.column("sub").to_numpy()
        count, pairs = np.zeros(len(x), np.int64), []
        for a in range(0, len(x), 512):
            close = x[a : a + 512] @ x.T >= cosine
            close &= np.arange(a, a + len(close))[:, None] < np.arange(len(x))[None, :]
            if not inside:
                close &= side[a : a + 512, None] != side[None, :]
            p, q = np.nonzero(close)
            pairs.append((p + a, q))
        p, q = (np.concatenate(v) for v in zip(*pairs, strict=True))
        if not len(p):
            return None
        links = _lowest(len(x), p, q)
        if t:  # a pair that met in an earlier table was counted there
            some, back = np.unique(np.concatenate([p, q]), return_inverse=True)
            h = hasher(x[some], t)
            new = ~(h[back[: len(p)]] == h[back[len(p) :]]).any(1)
            p, q = p[new], q[new]
        np.add.at(count, p, copies[q])
        np.add.at(count, q, copies[p])
        a = np.concatenate([np.flatnonzero(count), np.flatnonzero(links != np.arange(len(x)))])
        b = np.concatenate([np.flatnonzero(count), links[links != np.arange(len(x))]])
        n = np.concatenate([count[count > 0], np.zeros(len(a) - (count > 0).sum(), np.int64)])
        ends = {f"{e}_{c}": rows.column(c).take(pa.array(v)).combine_chunks() for e, v in (("a", a), ("b", b)) for c in NODE}
        return table(**ends, n=n)

    def run(batches):
        held, size = [], 0

        def groups(rows: pa.Table, last: bool):
            """Whole groups of rows, and where the last one begins if it may go on."""
            key = np.stack([rows.column(c).to_numpy() for c in MEET])
            edge = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            stop = np.append(edge[1:], rows.num_rows)
            if not last:
                edge, stop = edge[:-1], stop[:-1]
            return [rows.slice(a, b - a) for a, b in zip(edge.tolist(), stop.tolist(), strict=True) if b - a > 1], int(stop[-1]) if len(stop) else 0

        for rb in batches:
            held.append(rb)
            size += rb.num_rows
            if size >= 2 * BLOCK:
                rows = pa.Table.from_batches(held)
                whole, rest = groups(rows, False)
                for g in whole:
                    if (out := meet(g)) is not None:
                        yield out
                held, size = rows.slice(rest).to_batches(), rows.num_rows - rest
        if size:
            for g in groups(pa.Table.from_batches(held), True)[0]:
                if (out := meet(g)) is not None:
                    yield out

    return run


def linked(vectors: DataFrame, cosine: float = COSINE, recall: float = 0.99) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors (vec_id, embedding); other columns are ignored.

    Links join vectors of cosine >= cosine (double precision) that the tables bring together; none below is linked.
    component_id: smallest vec_id reachable; kept: vec_id = component_id. Vectors that are null, empty, zero, or hold null
    or non-finite components link with nothing, and vectors of other lengths only with their own. Equal vectors are
    links too. Rows with a null vec_id count as links of others, but have kept false. Repeated rows are vectors of their
    own. An empty table gives an empty result. A bucket of any size is compared in blocks, each pair of blocks in one task.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    single = dict(vectors.select("embedding").dtypes)["embedding"] == "array<float>"
    kind = pa.float32() if single else pa.float64()
    dtype = kind.to_pandas_dtype()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    v = v.mapInArrow(usable(kind), "vec_id long, raw binary")
    v = v.withColumns({"c1": F.when(F.col("raw").isNotNull(), F.xxhash64("raw")), "c2": F.xxhash64(F.lit("b"), "raw")})
    v = scratch(v, "vectors")
    classes = v.where("raw is not null").groupBy("c1", "c2", "raw").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = scratch(classes.withColumn("z", F.col("low").isNull()), "classes")
    hasher = Hasher(*parameters(classes.count(), cosine, recall))
    key = ["t", "bucket", "size"]
    where = "t int, bucket long, size int"
    large = classes.select("raw").mapInArrow(_buckets(hasher, dtype, False), where).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = scratch(large.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "large")
    some = large.count()
    rows = classes.select(*NODE, "copies", "raw").mapInArrow(_buckets(hasher, dtype, True), where + ", z boolean, low long, c1 long, copies long, raw binary")
    if some:
        rows = rows.join(F.broadcast(large) if some <= 100_000 else large, key, "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1)) if some else F.lit(1))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64("raw"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("sub", "o"), "j": F.greatest("sub", "o")}).drop("o", "blocks")
    ends = ", ".join(f"{e}_{c} {t}" for e in "ab" for c, t in zip(NODE, ("boolean", "long", "long"), strict=True))
    found = rows.repartition(*MEET).sortWithinPartitions(*MEET).mapInArrow(_compare(cosine, hasher, dtype), ends + ", n long")
    a, b = (F.struct(*[F.col(f"{e}_{c}").alias(c) for c in NODE]).alias(e) for e in "ab")
    found = scratch(found.select(a, b, "n"), "found")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    tied = components(found.where("n = 0").select("a", "b"))
    c = classes.select("c1", "c2", "copies", F.struct(*NODE).alias("node")).join(counts, "node", "left").join(tied, "node", "left")
    low = F.when(F.col("root").isNull(), F.col("node.low")).otherwise(F.col("root.low"))
    c = scratch(c.select("c1", "c2", "copies", F.coalesce("others", F.lit(0)).alias("others"), low.alias("component_id")), "tied")
    out = v.drop("raw").join(c, ["c1", "c2"], "left")
    alone = F.col("copies").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.when(alone, F.lit(0)).otherwise(F.col("copies") - 1 + F.col("others")).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
