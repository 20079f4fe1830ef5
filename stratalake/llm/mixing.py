"""Operator 7 [native]: mixing sources to target token weights by entropy balancing.

Among all document rates that meet the token constraints, the ones nearest to 1 (in token-weighted relative entropy) are
exponential tilts, rate = exp(sum of the duals of the document's strata). Newton steps on the joint convex dual run as
DataFrame jobs over cells (documents that share all strata); then rates become whole copies: the integer part for all, one
copy more for as many documents, in hash order, as the source's remaining tokens hold. With sources as the only family, as
in the query, a step needs no system to be solved; with several families the operator solves them together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, row_key, scratch, words_of

#: No document is taken more often.
CAP = 3
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: Newton stops at this relative error of the worst constraint, or after so many steps.
TOLERANCE, MAX_STEPS = 1e-9, 60
#: Hash buckets per source from which copies are dealt; passes that fill what the last left open.
BUCKETS, FILLS = 4096, 5
#: Per-stratum tables are broadcast up to so many rows and joined by shuffle beyond.
BROADCAST_ROWS = 50_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, column: str) -> DataFrame:
    """rows with rank, their number from 0 in the order of column, null last: numbered within ranges, whose counts alone
    go to the driver (one number per shuffle partition)."""
    r = scratch(rows.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ranges")
    counts, before = {x["_part"]: x["n"] for x in r.groupBy("_part").agg(F.count("*").alias("n")).collect()}, {}
    for p in sorted(counts):
        before[p] = sum(counts[q] for q in before)
    start = F.try_element_at(F.create_map(*[F.lit(x) for p in before.items() for x in p]), "_part") if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last()))
    return r.withColumn("rank", own - 1 + start).drop("_part")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares of the total by weight, no target above cap times its source's size.

    The excess of full sources is shared again until none is above; each round is one aggregate over the sources.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))).cast("int"))
    s = ranked(s, "source").withColumn("weight", weight).withColumn("room", cap * F.col("source_size").cast("double"))
    s = scratch(s, "sources")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("room") <= level * F.col("weight") if n_full >= 0 else F.lit(False)
        row = s.agg(F.sum(F.when(full, F.col("room"))).alias("room"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n")).first()
        if row["n"] == n_full or not row["weight"]:
            break
        level, n_full = max(level, (total - (row["room"] or 0.0)) / row["weight"]), row["n"]
    return s.select("source", "source_size", F.least("room", level * F.col("weight")).alias("target"))


def _solved(a: list[list[Column]], b: list[Column]) -> Column:
    """Array x with a x = b for a symmetric positive matrix of columns, by elimination on the one row."""
    n = len(b)
    rows = F.array(*[F.array(*[a[i][j] + (1e-9 if i == j else 0.0) for j in range(n)], b[i]) for i in range(n)])

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        scaled = F.transform(pivot, lambda x: x / F.get(pivot, k))
        return F.transform(m, lambda row, i: F.when(i == k, scaled).otherwise(F.zip_with(row, scaled, lambda x, y: x - F.get(row, k) * y)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, step), lambda row: F.get(row, F.lit(n)))


def entropy_rates(sizes: DataFrame, families: dict[str, DataFrame], cap: float = CAP) -> DataFrame:
    """One row per cell (distinct values of the families' columns) with its rate, at most cap.

    families: column -> (column, target) with the tokens to take from each of its strata. The first family may have any
    number of strata, the others a few dozen together. Each step is a Newton step on the joint dual: the first family's
    block of the Hessian is diagonal and is eliminated where it lies, one sum over its strata gives the small system that
    is left for the others, and its solution goes back into the first family's steps. Steps are scaled to at most 1.
    """
    lead, *others = list(families)
    cells = sizes.groupBy(lead, *others).agg(F.sum("size").cast("double").alias("tokens"))
    to = families[lead].select(F.col(lead).alias("_c"), F.col("target").alias("to"))
    cells = cells.join(_small(to), F.col(lead).eqNullSafe(F.col("_c")), "left").drop("_c")
    strata = [(c, r[c], float(r["target"])) for c in others for r in families[c].select(c, "target").collect()]
    inside = [F.col(c).eqNullSafe(F.lit(v)) for c, v, _ in strata]
    cells = scratch(cells.withColumn("dual", F.lit(0.0)), "cells")
    small = [0.0] * len(strata)
    k = range(len(strata))
    for _ in range(MAX_STEPS):
        tilt = F.exp(reduce(lambda a, b: a + b, [F.when(m, F.lit(v)).otherwise(0.0) for m, v in zip(inside, small, strict=True)], F.col("dual")))
        got = F.col("tokens") * F.least(F.lit(float(cap)), tilt)
        bend = F.when(tilt < cap, got).otherwise(0.0)  # at the cap the rate does not move
        own = Window.partitionBy(lead)
        c = cells.withColumns({"_got": got, "_h": bend}).withColumn("_sum", F.sum("_got").over(own))
        c = c.withColumns({"_d": F.greatest(F.sum("_h").over(own), F.lit(1e-9)), "_g": F.coalesce(F.col("to") - F.col("_sum"), F.lit(0.0))})
        c = c.withColumns({f"_b{i}": F.sum(F.when(m, F.col("_h")).otherwise(0.0)).over(own) for i, m in enumerate(inside)})
        c = c.withColumn("_first", F.row_number().over(own.orderBy(*others, "tokens")) == 1)
        off = F.max(F.abs(F.col("_g")) / F.greatest(F.coalesce("to", "_sum"), F.lit(1.0)))
        once = lambda x: F.sum(F.when(F.col("_first"), x).otherwise(0.0))  # noqa: E731  a stratum of the first family counts once
        a = [[F.sum(F.when(inside[i] & inside[j], F.col("_h")).otherwise(0.0)) - once(F.col(f"_b{i}") * F.col(f"_b{j}") / F.col("_d")) for j in k] for i in k]
        left = [F.lit(t) - F.sum(F.when(m, F.col("_got")).otherwise(0.0)) for m, (_, _, t) in zip(inside, strata, strict=True)]
        b = [left[i] - once(F.col(f"_b{i}") * F.col("_g") / F.col("_d")) for i in k]
        names = {f"a{i}_{j}": a[i][j] for i in k for j in k} | {f"b{i}": b[i] for i in k} | {f"o{i}": F.abs(left[i]) / max(1.0, strata[i][2]) for i in k}
        row = c.agg(off.alias("off"), *[v.alias(n) for n, v in names.items()])
        step = _solved([[F.col(f"a{i}_{j}") for j in k] for i in k], [F.col(f"b{i}") for i in k]) if strata else F.array().cast("array<double>")
        row = row.select(F.greatest("off", *[F.col(f"o{i}") for i in k], F.lit(0.0)).alias("off"), step.alias("step")).first()
        if row["off"] is None or row["off"] <= TOLERANCE:
            break
        # one scale for all, so that the direction stays Newton's
        scale = min(1.0, 1.0 / max([abs(x) for x in row["step"]], default=0.0)) if any(row["step"]) else 1.0
        moved = reduce(lambda x, i: x - F.col(f"_b{i}") * F.lit(row["step"][i]), k, F.col("_g")) / F.col("_d")
        move = F.when(F.col("to").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), scale * moved))).otherwise(0.0)
        old, cells = cells, scratch(c.withColumn("dual", F.col("dual") + move).select(lead, *others, "tokens", "to", "dual"), "cells")
        discard(old)
        small = [x + scale * d for x, d in zip(small, row["step"], strict=True)]
    return cells.select(lead, *others, F.least(F.lit(float(cap)), tilt).alias("rate"))


def _fill(rows: DataFrame, open_: DataFrame, eligible: Column) -> DataFrame:
    """Marks rows of eligible (no extra copy yet) for an extra copy, in hash order, while they fit what is open."""
    may = (F.col("extra") == 0) & (F.col("size") > 0) & eligible
    r = rows.join(_small(open_), rows["source"].eqNullSafe(open_["s"]), "left").drop("s")
    sums = r.where(may).groupBy("source", "bucket").agg(F.sum("size").alias("t"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = sums.withColumn("upto", F.sum("t").over(run)).join(_small(open_), F.col("source").eqNullSafe(F.col("s")))
    cut = cut.where(F.col("upto") > F.col("open")).groupBy(F.col("s").alias("cs")).agg(
        F.min("bucket").alias("edge"), F.min(F.col("upto") - F.col("t")).alias("below"))
    cut = scratch(cut, "edges")
    j = r.join(_small(cut), F.col("source").eqNullSafe(F.col("cs")), "left").drop("cs")
    inside = may & (F.col("edge").isNull() | (F.col("bucket") < F.col("edge")))
    j = j.withColumn("at_edge", F.coalesce(may & (F.col("bucket") == F.col("edge")), F.lit(False)))
    rest = j.where("not at_edge").withColumn("extra", F.when(inside, 1).otherwise(F.col("extra")))
    order = Window.partitionBy("source", "bucket").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = j.where("at_edge").withColumn("_run", F.sum("size").over(order) + F.col("below"))
    edge = edge.withColumn("extra", F.when(F.col("_run") <= F.col("open"), 1).otherwise(0)).drop("_run")
    return rest.unionByName(edge).select(*rows.columns)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken per row of docs (doc_id, text, source), and the columns
    named in also.

    Size: the words of the text (null: 0); taken = copies * size, copies <= cap. Other columns are ignored. Documents
    without words are taken 0 times. Null sources are one source, last in order. Repeated rows are documents of their
    own. The order of copies is a hash of doc_id and text, so reruns agree and rows without doc_id are spread; equal rows may
    get different copies. An empty table gives an empty result. Texts are read inside the row, at a few times their size.
    """
    text = F.col("text").cast("string")
    sizes = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(F.lit(7), "doc_id", text).alias("u"), *also,
    )
    sizes = scratch(sizes, "sizes")
    targets = scratch(source_targets(sizes, weights, cap), "targets")
    rates = entropy_rates(sizes, {"source": targets.select("source", "target")}, cap)
    per_source = targets.join(rates.withColumnRenamed("source", "rs"), F.col("source").eqNullSafe(F.col("rs"))).drop("rs")
    per_source = scratch(per_source.withColumnRenamed("source", "ps"), "per_source")
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    rows = sizes.join(_small(per_source), F.col("source").eqNullSafe(F.col("ps"))).drop("ps").select(
        *sizes.columns, "source_size", "target", "rate", whole.alias("base"), F.lit(0).alias("extra"),
        F.pmod(F.shiftrightunsigned("u", 20), F.lit(BUCKETS)).alias("bucket"),
    )
    rows = scratch(rows, "rows")
    for step in range(FILLS):
        open_ = rows.where(F.col("base") < cap).groupBy(F.col("source").alias("s")).agg(
            (F.first("target") - F.sum((F.col("base") + F.col("extra")) * F.col("size"))).alias("open"))
        open_ = scratch(open_.where("open >= 1"), "open")
        fits = F.lit(True) if step == 0 else F.col("size") * max(1, 2 ** (FILLS - 1 - step)) <= F.col("open")
        old, rows = rows, scratch(_fill(rows, open_, F.col("open").isNotNull() & fits), "rows")
        discard(old, open_)
    discard(sizes, targets, per_source)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + F.col("extra")).cast("int")
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *also
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; all columns stay. Equal rows are met once, with all their copies."""
    keyed = row_key(docs, *docs.columns)
    taken = mix(keyed, weights, cap, also=("_a", "_b")).groupBy("_a", "_b").agg(F.sum("copies").alias("copies")).where("copies > 0")
    whole = keyed.select("_a", "_b", F.struct(*docs.columns).alias("doc")).dropDuplicates(["_a", "_b"])
    j = whole.join(taken, ["_a", "_b"])
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
