"""Operator 11: nearest neighbours by an inverted multi-index.

Vectors are cut into two halves, each half quantised by a codebook of its own; a pair of centroids is a cell. A query walks the
cells in the order of its summed distance to both centroids with a heap, until the cells hold as many vectors as the index asks
for, and what lies in them is ranked by the exact distance.

1. Codebooks are fitted on at most ``SAMPLE`` vectors (those of smallest hash); every vector is indexed.
2. How many vectors a query has to see is measured, not guessed: ``TRIALS`` vectors are compared with all others, and the
   number is the least that finds the share ``recall`` of their neighbours. It is never below ``LEAST``, so a small table is
   searched whole.
3. Cells are dealt into shards of some ``SHARD`` vectors; a larger cell is cut into pieces by hash. A query goes to each shard it
   visits once, with the list of its cells there. A shard's vectors are held by its task, its queries stream past; a shard that
   more than ``ASKS`` queries visit is held by several tasks, each of which sees its part of them.

Equal vectors are one entry with its ``k + 1`` smallest ids: no query can return more of them. Queries of equal vectors are
searched once.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, discard, scratch, table
from .embedding_dedup import usable

#: Vectors, and bytes of them, that codebooks are fitted on; vectors that the search is tried with.
SAMPLE, SAMPLE_BYTES, TRIALS = 32_768, 64 << 20, 256
#: Vectors that a query sees at least, and those of a shard.
LEAST, SHARD = 2000, 4096
#: Queries beyond which a shard is held by more tasks than one.
ASKS = 16_384
#: Vectors per cell that the codebooks' size aims at, the most centroids of a codebook, and rounds of Lloyd's algorithm.
PER_CELL, CENTROIDS, ROUNDS = 12, 1024, 10


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of each row of x to each row of c."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """At most k centroids of the rows of x by Lloyd's algorithm; the start is spread over the rows, equal rows once."""
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    c = rows[np.random.default_rng(11).choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        near = np.concatenate([_squares(part, c).argmin(1) for part in np.array_split(x, 1 + len(x) // 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class Books:
    """Both codebooks of each length of vectors; a length without codebooks has one cell."""

    def __init__(self, sample: dict[int, np.ndarray], n: int):
        size = sum(map(len, sample.values()))
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d, x in sample.items():
            share = n * len(x) / size
            k = 1 << max(0, min(CENTROIDS.bit_length() - 1, round(np.log2(max(1.0, share / PER_CELL)) / 2)))
            self.of[d] = fitted(x[:, : d // 2], k), fitted(x[:, d // 2 :], k)

    def halves(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        return self.of.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))

    def far(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each row to the centroids of both halves."""
        a, b = self.halves(x.shape[1])
        return _squares(x[:, : x.shape[1] // 2], a), _squares(x[:, x.shape[1] // 2 :], b)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.far(x)
        return (np.int64(x.shape[1]) << 24) | (a.argmin(1) << 12) | b.argmin(1)


def walk(a: np.ndarray, b: np.ndarray, held: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Pairs of centroids by summed distance until they hold enough vectors; held: vectors of each pair. Empty pairs are left out."""
    i_of, j_of = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[i_of].tolist(), b[j_of].tolist()
    heap, out, seen, rows = [(a[0] + b[0], 0, 0)], [], 0, {}
    while heap and seen < enough:
        _, i, j = heapq.heappop(heap)
        if j == 0:
            rows[i] = held[i_of[i], j_of].tolist()
        if rows[i][j]:
            out.append((int(i_of[i]), int(j_of[j])))
            seen += rows[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


class Shards:
    """Where the vectors of each cell lie: its first shard, and into how many pieces it is cut."""

    def __init__(self, cells: np.ndarray, n: np.ndarray):
        order = np.argsort(cells)
        self.cell, self.n = cells[order], n[order]
        self.pieces = -(-self.n // SHARD)
        shard, room, at = [], 0, -1
        for count, cut in zip(self.n.tolist(), self.pieces.tolist(), strict=True):
            if cut > 1 or count > room:
                at += 1
                room = 0 if cut > 1 else SHARD
                shard.append(at)
                at += cut - 1
            else:
                shard.append(at)
            room -= min(room, count)
        self.shard, self.count = np.array(shard, np.int64), at + 1

    def find(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cell, cells)

    def held(self, d: int, books: Books) -> np.ndarray:
        """Vectors of each pair of centroids of the vectors of this length."""
        a, b = books.halves(d)
        out = np.zeros((len(a), len(b)), np.int64)
        mine = self.cell >> 24 == d
        out[self.cell[mine] >> 12 & 4095, self.cell[mine] & 4095] = self.n[mine]
        return out


def _by_length(rb: pa.RecordBatch, dtype):
    """Rows of each length of a batch with column raw, and their vectors in double precision."""
    raw = rb.column("raw").to_pylist()
    size = np.array([len(x) for x in raw], np.int64)
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        yield at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), dtype).reshape(len(at), -1).astype(np.float64)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of x to q, by differences in double precision."""
    with np.errstate(over="ignore"):
        return np.sqrt(((x - q) ** 2).sum(1))


def nearest(x: np.ndarray, low: np.ndarray, q: np.ndarray, k: int, square: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows of x to q by (distance, low), and their distances. square: squared distances good to some 10 digits,
    which leave aside what is clearly farther."""
    at = np.arange(len(x))
    if square is not None and len(x) > 4 * k:
        limit = np.partition(square, k)[k]
        slack = 1e-9 * ((q * q).sum() + (x * x).sum(1).max())
        if np.isfinite(limit + slack):
            at = np.flatnonzero(square <= limit + slack)
    s = exact(x[at], q)
    order = np.lexsort((low[at], s))[:k]
    return at[order], s[order]


def _cells(books, dtype):
    def run(batches):
        for rb in batches:
            cell = np.zeros(rb.num_rows, np.int64)
            for at, x in _by_length(rb, dtype):
                cell[at] = books.value.cells(x)
            yield table(**{c: rb.column(c) for c in rb.schema.names}, cell=cell)

    return run


def _trial(tries: dict[int, tuple[np.ndarray, np.ndarray]], dtype, k: int):
    """trial, score, cell: the nearest of a task's vectors to each trial vector, itself left out."""

    def run(batches):
        best = {i: [] for ids, _ in tries.values() for i in ids.tolist()}
        for rb in batches:
            cell = rb.column("cell").to_numpy()
            for at, x in _by_length(rb, dtype):
                ids, q = tries.get(x.shape[1], ((), ()))
                for i, one in zip(ids, q, strict=True):
                    s = exact(x, one)
                    s[(x == one).all(1)] = np.inf
                    near = np.argsort(s)[:k]
                    best[i] = sorted([*best[i], *zip(s[near].tolist(), cell[at][near].tolist(), strict=True)])[:k]
        rows = [(i, *x) for i, found in best.items() for x in found if np.isfinite(x[0])]
        if rows:
            trial, score, cell = zip(*rows, strict=True)
            yield table(trial=pa.array(trial, pa.int32()), score=pa.array(score, pa.float64()), cell=pa.array(cell, pa.int64()))

    return run


def _needed(books: Books, shards: Shards, tries: dict, found: list, recall: float) -> int:
    """Vectors that a query has to see for this share of the neighbours found in the trials."""
    where: dict[int, list[int]] = {}
    for row in found:
        where.setdefault(row["trial"], []).append(row["cell"])
    needs = []
    for d, (ids, q) in tries.items():
        held, far = shards.held(d, books), zip(*books.far(q), strict=True)
        for i, (a, b) in zip(ids.tolist(), far, strict=True):
            total = a[:, None] + b[None, :]
            needs += [int(held[total <= total[c >> 12 & 4095, c & 4095]].sum()) for c in where.get(i, ())]
    return sorted(needs)[min(len(needs) - 1, int(np.ceil(recall * len(needs))))] if needs else 0


def _visits(books, shards, enough: int, dtype):
    """shard, raw, cells: each query once for each shard that it visits, with its cells there."""

    def run(batches):
        s, held = shards.value, {}
        for rb in batches:
            raw, out = rb.column("raw"), []
            for at, x in _by_length(rb, dtype):
                d = x.shape[1]
                if d not in held:
                    held[d] = s.held(d, books.value)
                for row, a, b in zip(at.tolist(), *books.value.far(x), strict=True):
                    cells = np.array([(d << 24) | (i << 12) | j for i, j in walk(a, b, held[d], enough)], np.int64)
                    place = s.find(cells)
                    pieces = s.pieces[place]
                    shard = np.repeat(s.shard[place], pieces) + np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                    cells = np.repeat(cells, pieces)
                    order = np.argsort(shard, kind="stable")
                    edge = np.flatnonzero(np.diff(shard[order], prepend=-1))
                    out += [(int(shard[o[0]]), row, cells[o].tolist()) for o in np.split(order, edge[1:])]
                    if len(out) >= 2000:
                        yield _visit_rows(out, raw)
                        out = []
            if out:
                yield _visit_rows(out, raw)

    return run


def _visit_rows(out: list, raw: pa.Array) -> pa.RecordBatch:
    shard, row, cells = zip(*out, strict=True)
    return table(shard=pa.array(shard, pa.int64()), raw=raw.take(pa.array(row)), cells=pa.array(cells, pa.list_(pa.int64())))


def _placed(shards):
    """The shard of each entry."""

    def run(batches):
        for rb in batches:
            s = shards.value
            place = s.find(rb.column("cell").to_numpy())
            piece = rb.column("mark").to_numpy() % s.pieces[place]
            cells = pa.ListArray.from_arrays(pa.array(np.arange(rb.num_rows + 1, dtype=np.int32)), rb.column("cell"))
            yield table(shard=s.shard[place] + piece, raw=rb.column("raw"), cells=cells, ids=rb.column("ids"))

    return run


def _ranked(dtype, k: int):
    """raw, score, ids: the k nearest entries of a shard to each query that visits it."""

    class Held:
        """The entries of one shard."""

        def __init__(self, batches: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(batches).combine_chunks()
            self.ids = rows.column("ids").combine_chunks()
            self.of = {x.shape[1]: (at, x, (x * x).sum(1)) for at, x in _by_length(rows.to_batches()[0], dtype)}
            first = [np.inf if i[0] is None else i[0] for i in self.ids.to_pylist()]
            self.low = np.argsort(np.argsort(np.array(first, object), kind="stable"), kind="stable")
            self.cell = rows.column("cells").combine_chunks().flatten().to_numpy()

        def answers(self, asks: pa.RecordBatch):
            visited = asks.column("cells").to_pylist()
            for at, q in _by_length(asks, dtype):
                mine, x, norm = self.of.get(q.shape[1], (None, None, None))
                for c in range(0, len(q) if mine is not None else 0, 256):
                    part = q[c : c + 256]
                    square = norm[None, :] - 2 * part @ x.T + (part * part).sum(1)[:, None]
                    for row, one, near in zip(at[c : c + 256].tolist(), part, square, strict=True):
                        inside = np.flatnonzero(np.isin(self.cell[mine], visited[row]))
                        got, score = nearest(x[inside], self.low[mine[inside]], one, k, near[inside])
                        yield from ((row, s, i) for s, i in zip(score.tolist(), mine[inside[got]].tolist(), strict=True))

    def run(batches):
        now, entries, held = None, [], None
        for rb in batches:
            key = rb.column("shard").to_numpy() << 20 | rb.column("copy").to_numpy()
            edge = np.flatnonzero(np.diff(key, prepend=-1))
            for a, b in zip(edge.tolist(), [*edge[1:].tolist(), rb.num_rows], strict=True):
                part = rb.slice(a, b - a)
                if key[a] != now:
                    now, entries, held = key[a], [], None
                late = part.column("late")
                entries.append(part.filter(pc.invert(late)))
                asks = part.filter(late)
                if not asks.num_rows:
                    continue
                held = Held(entries) if held is None else held
                if out := list(held.answers(asks)):
                    row, score, i = zip(*out, strict=True)
                    yield table(raw=asks.column("raw").take(pa.array(row)), score=pa.array(score, pa.float64()), ids=held.ids.take(pa.array(i)))

    return run


def search(vectors: DataFrame, asked: Column, k: int = 10, recall: float = 0.96) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found to each row of vectors (vec_id, embedding) for which asked, a
    condition on vec_id, holds.

    score is the Euclidean distance of the vectors as they came, in double precision; nearest first, ties to the smaller vec_id
    (null last). A row is no neighbour of itself; every other row may be, equal ones too. Fewer rows than k are all returned.
    Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of other lengths than a
    query's are no candidates. Repeated rows are rows of their own, and each one asked for has its own k rows. Other columns
    are ignored; an empty table gives an empty result. recall is that of the trials (see above).
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    single = dict(vectors.select("embedding").dtypes)["embedding"] == "array<float>"
    kind = pa.float32() if single else pa.float64()
    dtype = kind.to_pandas_dtype()
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if single else 'double'}>").alias("embedding"))
    v = v.mapInArrow(usable(kind), "vec_id long, raw binary").where("raw is not null")
    v = scratch(v.withColumn("asked", F.coalesce(asked, F.lit(False))), "usable")

    first = Window.partitionBy("raw").orderBy(F.col("vec_id").asc_nulls_last())
    few = v.select("vec_id", "raw").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"])
    entries = scratch(few.groupBy("raw").agg(ids.alias("ids")).withColumn("mark", F.xxhash64("raw").bitwiseAND(F.lit(2**62 - 1))), "entries")
    n, longest = entries.agg(F.count("*"), F.max(F.length("raw"))).first()
    top = min(SAMPLE, max(TRIALS, SAMPLE_BYTES // max(1, (longest or 0) * 8 // kind.to_pandas_dtype()().itemsize)))
    chosen = entries.where(F.col("mark") <= int(2**62 * min(1.0, top / max(1, n)))).select("raw", "mark").toArrow().sort_by([("mark", "ascending"), ("raw", "ascending")])
    sample = {x.shape[1]: x for _, x in _by_length(chosen.combine_chunks().to_batches()[0], dtype)} if chosen.num_rows else {}
    books = Books(sample, n)
    sent = spark.sparkContext.broadcast(books)
    indexed = scratch(entries.mapInArrow(_cells(sent, dtype), "raw binary, ids array<long>, mark long, cell long"), "cells")
    counts = indexed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row for each pair of centroids at most
    shards = Shards(counts.column("cell").to_numpy(), counts.column("n").to_numpy())

    tries, at = {}, 0
    for d, x in sample.items():
        share = x[: max(1, TRIALS * len(x) // chosen.num_rows)]
        tries[d] = np.arange(at, at + len(share)), share
        at += len(share)
    near = Window.partitionBy("trial").orderBy("score", "cell")
    found = indexed.select("raw", "cell").mapInArrow(_trial(tries, dtype, k), "trial int, score double, cell long")
    found = found.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k).collect()
    enough = max(LEAST, _needed(books, shards, tries, found, recall))

    placed = spark.sparkContext.broadcast(shards)
    rows = indexed.mapInArrow(_placed(placed), "shard long, raw binary, cells array<long>, ids array<long>")
    asks = v.where("asked").select("raw").distinct()
    visits = scratch(asks.mapInArrow(_visits(sent, placed, enough, dtype), "shard long, raw binary, cells array<long>"), "visits")
    busy = visits.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > ASKS)
    busy = scratch(busy.select("shard", F.ceil(F.col("n") / ASKS).cast("int").alias("copies")), "busy")
    some = busy.count()

    def copied(df: DataFrame) -> DataFrame:
        if not some:
            return df.withColumn("copies", F.lit(1))
        return df.join(F.broadcast(busy) if some <= 100_000 else busy, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))

    rows = copied(rows).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    visits_ = copied(visits).withColumn("copy", F.pmod(F.xxhash64("raw"), F.col("copies")).cast("int")).withColumn("ids", F.lit(None).cast("array<long>"))
    both = rows.withColumn("late", F.lit(False)).unionByName(visits_.withColumn("late", F.lit(True))).drop("copies")
    both = both.repartition(max(1, min(10_000, shards.count)), "shard", "copy").sortWithinPartitions("shard", "copy", "late")
    got = both.mapInArrow(_ranked(dtype, k + 1), "raw binary, score double, ids array<long>")
    best = Window.partitionBy("raw").orderBy("score", F.col("ids")[0].asc_nulls_last())
    got = got.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    one = F.transform("ids", lambda i: F.struct("score", i.isNull().alias("z"), i.alias("vec_id")))
    got = got.groupBy("raw").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("near"))
    out = v.where("asked").select(F.col("vec_id").alias("query_id"), "raw").join(got, "raw")
    me = F.struct(F.lit(0.0).alias("score"), F.col("query_id").isNull().alias("z"), F.col("query_id").alias("vec_id"))
    own = F.array_position("near", me).cast("int")  # itself, unless k + 1 equal rows have smaller ids
    rest = F.when(own > 0, F.concat(F.slice("near", F.lit(1), F.greatest(own - 1, F.lit(0))), F.slice("near", own + 1, F.size("near")))).otherwise(F.col("near"))
    out = out.select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "x"))
    out = scratch(out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "x.vec_id", "x.score"), "found")
    discard(v, entries, indexed, visits, busy)
    return out
