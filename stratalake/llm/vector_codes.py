"""Operator 12: product codes of vectors by weighted Lloyd over distinct parts.

Components become whole numbers and a vector is cut into equal parts. At each part position equal parts are one row with a
weight, so that Lloyd's rounds run over distinct rows: they are assigned to the position's nearest entry, and sums and counts per
entry (``PARTS * ENTRIES`` rows) are all that a round sends to the driver. Codes and errors of the last assignment are joined
back to the vectors' parts. All arithmetic is in whole numbers, so the result doesn't depend on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, scratch, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers beyond this would overflow sums of squares.
LARGEST = 1 << 28


def _whole(batches):
    """vec_id, label and the components as whole numbers of 32 bits; null where the vector takes no part."""
    for rb in batches:
        e = rb.column("embedding")
        n = np.where(np.asarray(e.is_valid()), np.diff(e.offsets.to_numpy()), 0) if len(e) else np.zeros(0, np.int64)
        values = np.floor(np.asarray(e.flatten().fill_null(float("nan")), np.float64) * SCALE)
        with np.errstate(invalid="ignore"):
            fine = np.abs(values) <= LARGEST  # false for NaN and infinities
        end = np.cumsum(n)
        ok = np.zeros(len(n), bool)
        full = np.flatnonzero(n)
        if len(full):
            ok[full] = np.logical_and.reduceat(fine, (end - n)[full])
        raw = np.where(fine, values, 0).astype("<i4").tobytes()
        ints = [raw[(b - k) * 4 : b * 4] if g else None for b, k, g in zip(end.tolist(), n.tolist(), ok.tolist(), strict=True)]
        yield table(vec_id=rb.column("vec_id"), label=rb.column("label"), ints=pa.array(ints, pa.binary()))


def _decoded(part: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(part), "<i4").reshape(len(part), -1).astype(np.int64)


def assigned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book to each row of x (the lower one of equally near ones), and the squared distance."""
    best = np.zeros(len(x), np.int64)
    error = ((x - book[0]) ** 2).sum(1)
    for i in range(1, len(book)):
        e = ((x - book[i]) ** 2).sum(1)
        nearer = e < error
        best[nearer], error[nearer] = i, e[nearer]
    return best, error


def _by_position(rb: pa.RecordBatch, books: list[np.ndarray]):
    """Rows of a batch at each position: position, rows, parts, code, squared distance."""
    pos = rb.column("pos").to_numpy()
    part = rb.column("part").to_pylist()
    for p in np.unique(pos).tolist():
        at = np.flatnonzero(pos == p)
        x = _decoded([part[i] for i in at.tolist()])
        yield p, at, x, *assigned(x, books[p])


def _sums(books: list[np.ndarray]):
    """pos, entry, n and the summed components of the parts nearest to each entry, once for each task."""
    width = books[0].shape[1]

    def run(batches):
        total = np.zeros((PARTS, ENTRIES, 1 + width), np.int64)
        for rb in batches:
            n = rb.column("n").to_numpy()
            for p, at, x, code, _ in _by_position(rb, books):
                np.add.at(total[p], code, np.concatenate([n[at, None], x * n[at, None]], 1))
        pos, entry = np.nonzero(total[:, :, 0])
        if len(pos):
            sums = total[pos, entry, 1:]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(pos) + 1, dtype=np.int32) * width, pa.int32()), pa.array(sums.ravel()))
            yield table(pos=pos.astype(np.int32), entry=entry.astype(np.int32), n=total[pos, entry, 0], sums=lists)

    return run


def _codes(books: list[np.ndarray]):
    def run(batches):
        for rb in batches:
            out, error = np.zeros(rb.num_rows, np.int32), np.zeros(rb.num_rows, np.int64)
            for _, at, _, code, e in _by_position(rb, books):
                out[at], error[at] = code, e
            yield table(pos=rb.column("pos"), part=rb.column("part"), code=out, error=error)

    return run


def _next(books: list[np.ndarray], found: list) -> list[np.ndarray]:
    """Entries moved to the whole mean of their parts; entries that have none stay."""
    out = [b.copy() for b in books]
    for r in found:
        out[r["pos"]][r["entry"]] = [s // r["n"] for s in r["sums"]]
    return out


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 per kept row of vectors (vec_id, embedding, label).

    Kept are vectors without null, NaN or infinite components. Component x becomes floor(256 * x); a vector is cut into 16
    parts, and each position has a codebook of 64 entries: at first that part of the vectors of the 64 smallest vec_ids (of all,
    if fewer; null ids come last, equal ids in the order of their bytes), then of two rounds of Lloyd's algorithm over all. code: index of the
    nearest entry of each part, two hex digits each; error: its squared distances summed; label_error: the error summed over
    rows of equal label, nulls together; codebooks_sha256: of all entries, one hash for all rows.

    The kept vector of smallest vec_id gives the length, a multiple of 16. Vectors of other lengths, empty ones, and those with a
    component beyond 2 ** 20 on either side (whose squares no 64-bit sum can hold) are left out like null ones; if the first vector cannot be
    cut into 16 parts, ValueError. Repeated rows are rows of their own. Other columns are ignored; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    label = dict(vectors.dtypes)["label"]
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    v = v.mapInArrow(_whole, f"vec_id long, label {label}, ints binary").where("ints is not null")
    v = scratch(v.withColumn("row", F.monotonically_increasing_id()), "whole")
    first = v.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(1).collect()
    if not first:
        empty = v.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty.where("false")
    size = len(first[0]["ints"])
    if size % (4 * PARTS):
        raise ValueError(f"vectors of {size // 4} components cannot be cut into {PARTS} parts")
    width = size // PARTS
    kept = v.where(F.length("ints") == size)
    start = [r["ints"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints").select("ints").limit(ENTRIES).collect()]
    books = [_decoded([x[p * width : (p + 1) * width] for x in start]) for p in range(PARTS)]

    cut = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.substring("ints", p * width + 1, F.lit(width)))
    parts = kept.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = scratch(parts.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    for _ in range(ROUNDS):
        sums = distinct.mapInArrow(_sums(books), "pos int, entry int, n long, sums array<long>")
        total = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width // 4)]
        found = sums.groupBy("pos", "entry").agg(F.sum("n").alias("n"), *total)
        books = _next(books, found.select("pos", "entry", "n", F.array(*[f"s{i}" for i in range(width // 4)]).alias("sums")).collect())
    coded = distinct.mapInArrow(_codes(books), "pos int, part binary, code int, error long")
    each = parts.join(coded, ["pos", "part"]).groupBy("row", "vec_id", "label")
    hexes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0")))
    each = scratch(each.agg(F.array_join(hexes, "").alias("code"), F.sum("error").alias("error")).select("vec_id", "label", "code", "error"), "codes")
    labels = each.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    sha = F.sha2(F.lit(",".join(str(c) for b in books for entry in b.tolist() for c in entry)), 256)
    out = each.join(labels, F.col("label").eqNullSafe(F.col("l")))
    discard(v, distinct)
    return out.select("vec_id", "code", "error", "label_error", sha.alias("codebooks_sha256"))
