"""Filters over row groups."""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import readings, verdict
from ..functions.schema import column_by_path
from .filter_index import FIELDS, FilterIndex

#: Filters are broadcast up to so many rows; more are dealt out in blocks of so many.
BROADCAST_FILTERS = 100_000
#: Row groups that meet a block of filters in a task; rows that a batch of verdicts holds, about.
ROW_GROUPS_PER_TASK, BATCH = 4096, 1 << 16
#: Only the records of named columns are handed to tasks if filters name so many columns at most.
NAMED_COLUMNS = 1000


def keeps(filters: Iterable[tuple], columns: str = "columns", nan_bound: str = "prune") -> Column:
    """Whether all filters (column, op, value[, value2]) keep a row group; a column without record keeps.

    One expression on the row: nothing is shuffled.
    """
    out = F.lit(True)
    for path, op, value, *more in filters:
        # a column without record has null statistics, which keep
        out &= verdict(column_by_path(path, columns), op, value, more[0] if more else "", nan_bound)
    return out


def _cuts(filters: DataFrame) -> DataFrame:
    """filter_set, column, side, both and the literal in each way of FIELDS: what decides of a set's filters, parsed once each.

    A set excludes a row group if one of its filters does, so of all literals that it holds a column's upper bound against (side lower) the
    largest decides, and of those for its lower bound (upper) the smallest: a set has a few rows for each column, whatever the number of its filters. both: both
    bounds must be known. A set that never excludes anything has a row with side null.
    """
    f = filters.where("filter_set is not null").select("filter_set", "column", "op", readings(F.col("value")).alias("a"), readings(F.coalesce("value2", F.lit(""))).alias("b"))

    def fields(r: Column) -> dict[str, Column]:
        # ts as number, whatever the session's zone
        return {"num": r["num"], "int": r["int"], "whole": F.when(r["int"].isNull(), r["num"]), "str": r["str"], "ts": F.unix_micros(r["ts"]), "bool": r["bool"]}

    a, b = fields(F.col("a")), fields(F.col("b"))
    between = F.col("op") == "between"
    # a range counts for a kind of column only if both of its literals can be read so: whole numbers and others both for int
    read = lambda own, k: own["num"].isNotNull() | own["int"].isNotNull() if k in ("int", "whole") else own[k].isNotNull()
    lower = {k: F.when(~between | read(b, k), a[k]) for k in FIELDS}
    upper = {k: F.when(between, F.when(read(a, k), b[k])).otherwise(a[k]) for k in FIELDS}
    none = {k: F.lit(None) for k in FIELDS}
    side = lambda name, values, ops: F.when(F.col("op").isin(*ops), F.struct(name.alias("side"), *[v.alias(k) for k, v in values.items()]))
    sides = F.array(side(F.lit("lower"), lower, ("eq", "gte", "between")), side(F.lit("upper"), upper, ("eq", "lte", "between")), side(F.col("op"), none, ("is_null", "is_not_null")))
    each = f.select("filter_set", "column", F.col("op").isin("eq", "between").alias("both"), F.explode_outer(F.filter(sides, lambda s: s.isNotNull())).alias("s"))
    most = [F.when(F.col("side") == "lower", F.max(k)).otherwise(F.min(k)).alias(k) for k in FIELDS]
    return each.select("filter_set", "column", "both", "s.*").groupBy("filter_set", "column", "side", "both").agg(*most)


def _packed(cuts: DataFrame, blocks: int, nan_bound: str) -> DataFrame:
    """block, pack: the index of each block of filter sets, pickled, with the names of its sets. Sets lie in blocks by hash."""

    def pack(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        names, index = FilterIndex.of(t, nan_bound)
        return pa.table({"block": pa.array([block], pa.int32()), "pack": pa.array([pickle.dumps((names, index))], pa.binary())})

    dealt = cuts.withColumn("block", F.pmod(F.xxhash64("filter_set"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, "block int, pack binary")


def _slim(row_groups: DataFrame, paths: list[str] | None) -> DataFrame:
    """file, rg_index and the fields that filters ask for of the columns records with these paths, or of all."""
    some = F.col("columns")
    if paths is not None:
        wanted = F.array(*[F.lit(p) for p in sorted(paths)]).cast("array<string>")
        some = F.filter("columns", lambda c: F.array_contains(wanted, c["path"]))
    timed = lambda r: r.withField("ts", F.unix_micros(r["ts"]))  # noqa: E731  numbers, whatever the session's zone
    of = lambda c, x: timed(c[x]) if x.endswith("_raw") else c[x]
    slim = F.transform(some, lambda c: F.struct(*[of(c, x).alias(x) for x in ("path", "num_values", "null_count", "min_raw", "max_raw")]))
    return row_groups.where("rg_index is not null").select(F.col("file").cast("string").alias("file"), F.col("rg_index").cast("int").alias("rg_index"), slim.alias("columns"))


def _met(row_groups: DataFrame, filters: DataFrame, nan_bound: str, answer, schema: str, total: int | None = None) -> DataFrame:
    """What answer says of the batches of row groups and an index of filters, once for each block of filters. total: the number of row groups, if known.

    Filters up to BROADCAST_FILTERS are one block, whose index is broadcast; the driver sees its bytes only. More are dealt out in blocks of sets
    by hash: each block's index goes to tasks of some thousand row groups each, ahead of them.
    """
    head = filters.groupBy("column").count().limit(NAMED_COLUMNS + 1).collect()
    few = len(head) <= NAMED_COLUMNS
    n = sum(r["count"] for r in head) if few else filters.count()
    rows = _slim(row_groups, [r["column"] for r in head if r["column"] is not None] if few else None)
    cuts = _cuts(filters)
    if n <= BROADCAST_FILTERS:
        packed = _packed(cuts, 1, nan_bound).first()
        held = row_groups.sparkSession.sparkContext.broadcast(packed["pack"] if packed else None)

        def run(batches):
            if held.value is not None:
                yield from answer(*pickle.loads(held.value), batches)

        return rows.mapInArrow(run, schema)
    blocks = -(-n // max(1, BROADCAST_FILTERS))
    pieces = max(1, -(-(rows.count() if total is None else total) // ROW_GROUPS_PER_TASK))
    place = F.col("block") * pieces + F.col("piece")
    packs = _packed(cuts, blocks, nan_bound).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1)))).select(place.alias("place"), "pack")
    to_each = rows.withColumn("piece", F.pmod(F.xxhash64("file", "rg_index"), F.lit(pieces)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = packs.unionByName(to_each.select(place.alias("place"), "file", "rg_index", "columns"), allowMissingColumns=True)
    return both.repartitionById(blocks * pieces, "place").sortWithinPartitions("place", F.col("pack").isNull()).mapInArrow(_by_place(answer), schema)


def _by_place(answer):
    """answer over the rows of places in order, each place's pack ahead of its row groups; a place without pack has no filters."""

    def run(batches):
        held, ready = (None, None), []  # the place and pack at hand, and what else came with the last batch

        def cut(rb):
            at = rb.column("place").to_numpy()
            begins = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            return [(int(at[i]), rb.slice(i, j - i)) for i, j in zip(begins, begins[1:], strict=False)]

        def more():
            while not ready:
                rb = next(batches, None)
                if rb is None:
                    return False
                ready.extend(cut(rb))
            return True

        def of(place):
            while more() and ready[0][0] == place:
                yield ready.pop(0)[1].select(["file", "rg_index", "columns"])

        batches = iter(batches)
        while more():
            place, rb = ready[0]
            if held[0] != place:
                pack = rb.column("pack")[0].as_py()
                held = place, pack
                ready[0] = place, rb.slice(1) if pack is not None else rb
            if held[1] is None:
                ready.pop(0)
            else:
                yield from answer(*pickle.loads(held[1]), of(place))

    return run


def _all_verdicts(names: pa.Array, index: FilterIndex, batches):
    """filter_set, file, rg_index, keep of each row group and all sets."""
    n = len(names)
    most = max(1, BATCH // max(n, 1))
    tiled = pa.concat_arrays([names] * most)
    for rb in batches:
        records = rb.column("columns").to_pylist()
        for i in range(0, len(records), most):
            some = records[i : i + most]
            keep = np.ones((len(some), n), bool)
            for mine, r in zip(keep, some, strict=True):
                for x in index.failed(r or []):
                    mine[x] = False
            row = pa.array(np.repeat(np.arange(i, i + len(some), dtype=np.int32), n))
            columns = [tiled.slice(0, keep.size), rb.column("file").take(row), rb.column("rg_index").take(row), pa.array(keep.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["filter_set", "file", "rg_index", "keep"])


def _all_failures(names: pa.Array, index: FilterIndex, batches):
    """filter_set, file, rg_index of each row group's failures."""
    for rb in batches:
        sets, at, size = [], [], 0
        for i, records in enumerate(rb.column("columns").to_pylist()):
            fails = np.zeros(len(names), bool)
            for x in index.failed(records or []):
                fails[x] = True
            sets.append(np.flatnonzero(fails))
            at.append(np.full(len(sets[-1]), i))
            size += len(sets[-1])
            if size >= BATCH or i == rb.num_rows - 1:
                row = pa.array(np.concatenate(at))
                columns = [names.take(pa.array(np.concatenate(sets))), rb.column("file").take(row), rb.column("rg_index").take(row)]
                yield pa.RecordBatch.from_arrays(columns, ["filter_set", "file", "rg_index"])
                sets, at, size = [], [], 0


def _failure_counts(names: pa.Array, index: FilterIndex, batches):
    """filter_set, failed: once for each block and task, whatever the number of its row groups."""
    total = np.zeros(len(names), np.int64)
    for rb in batches:
        for records in rb.column("columns").to_pylist():
            found = index.failed(records or [])
            if len(found) == 1:
                total[found[0]] += 1  # a set comes once in each
            elif found:
                fails = np.zeros(len(names), bool)
                for x in found:
                    fails[x] = True
                total += fails
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(total[some])], ["filter_set", "failed"])


def failures(row_groups: DataFrame, filters: DataFrame, nan_bound: str = "prune") -> DataFrame:
    """filter_set, file, rg_index of every row group that a filter of the set excludes, once each.

    filters: filter_set, filter_id, column, op, value, value2. Literals are read once per filter, before they meet the row
    groups; of several records of one path the first counts; rows without row group (rg_index null: empty or broken files)
    are left out. Every file has the same few paths, so rows are never dealt out by path: filters become indexes of sorted
    literals, which are broadcast or meet the row groups in blocks.
    """
    return _met(row_groups, filters, nan_bound, _all_failures, "filter_set string, file string, rg_index int")


def prune_many(row_groups: DataFrame, filters: DataFrame, nan_bound: str = "prune") -> DataFrame:
    """filter_set, file, rg_index, keep for every filter set and row group.

    A set keeps the row groups it has no failure in. The result has as many rows as sets times row groups; failures() and
    match_counts() are there for those who do not want them all.
    """
    return _met(row_groups, filters, nan_bound, _all_verdicts, "filter_set string, file string, rg_index int, keep boolean")


def match_counts(row_groups: DataFrame, filters: DataFrame, nan_bound: str = "prune") -> DataFrame:
    """filter_set, matched, total of each filter set: all row groups less those that fail; no set meets a row group that
    it keeps."""
    total = row_groups.where("rg_index is not null").count()
    failed = _met(row_groups, filters, nan_bound, _failure_counts, "filter_set string, failed long", total).groupBy("filter_set").agg(F.sum("failed").alias("_failed"))
    sets = filters.select("filter_set").distinct().join(failed, "filter_set", "left")
    every = F.lit(total).cast("bigint")
    return sets.select("filter_set", (every - F.coalesce("_failed", F.lit(0))).alias("matched"), every.alias("total"))
