"""Operator 4 [native]: rule statistics, and rejection of multivariate outliers by minimum-covariance-determinant estimates.

Each document becomes a vector of transformed statistics. Per language and source, over its distinct vectors, concentration
steps (keep the half nearest by Mahalanobis distance, take its mean and covariance, repeat) run from two robust starts; the
start with the smaller determinant is kept, its distances are scaled so that their median is that of normal data, and
mean and covariance are taken once more over all vectors within the 0.975 quantile. A document goes if it lies further than
``CUT`` says from that estimate, scaled in the same way.

Variances are the data's own. A variance is replaced only where the central half hardly varies: by that of two of the
statistic's smallest steps in a document of the group's median size (one symbol, one line, one repeated window more), or by a
quarter of the square of the groups' median spread, so that a group made up of near copies does not call all else outliers.

Only DataFrame expressions are used: statistics are computed inside the row without a shuffle, moments and quantiles are
pre-aggregated per group, and matrices are inverted by higher-order functions on the one row per group.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, row_key, scratch, words_of

#: Names of the vector's parts.
PARTS = ("f_size", "f_length", "f_symbols", "f_repeats", "f_lines", "f_capitals")
#: 0.5 and 0.975 quantiles of chi-square with 6 degrees of freedom.
CHI_MEDIAN, CHI_WIDE = 5.348, 14.449
#: Squared distance from which documents go: ten robust standard deviations, since sizes and repeats of clean text have long
#: tails. Scales are taken as no smaller than LEAST_SCALE, as replaced variances make central distances small.
CUT, LEAST_SCALE = 100.0, 0.5
#: Groups with fewer distinct vectors (five for each part) are pooled by language, then with all rows.
MIN_GROUP = 30
#: With fewer distinct vectors altogether (no half of them determines a covariance) no document is an outlier.
MIN_ALL = 2 * len(PARTS) + 1
STEPS = 3
#: Estimates are broadcast up to so many groups and joined by shuffle beyond.
BROADCAST_GROUPS = 20_000
D = len(PARTS)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words inside a 3-word window that the array holds twice or more."""

    def covered(p: Column) -> Column:
        n = F.size(p)
        same = lambda i, j: F.get(p, i)["h"] == F.get(p, j)["h"]
        at = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda j: ((j > 0) & same(j, j - 1)) | ((j < n - 1) & same(j, F.least(j + 1, n - 1))),
        )
        at = F.array_sort(F.transform(at, lambda j: F.get(p, j)["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    def of(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(pairs, covered))

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(_let(hashes, of))


def statistics(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source, the base statistics, base_failed and the transformed vector, one row per row of docs, and the
    columns named in also."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    drop = lambda c, chars: F.length(c) - F.length(F.translate(c, chars, ""))
    gaps = " \t\n\x0b\x0c\r"
    counts = _let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    s = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        counts.alias("c"),
        F.length(F.translate(text, gaps, "")).cast("long").alias("word_chars"),
        drop(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        drop(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("capitals"), *also,
    )
    s = s.select("*", F.col("c.n").cast("long").alias("n_words"), F.col("c.r").cast("long").alias("n_repeat_words")).drop("c")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    share = lambda a, b: F.col(a) * 100.0 / (F.col(b) + 1)
    return s.withColumns({
        "base_failed": failed,
        "f_size": F.log1p("n_words"),
        "f_length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        "f_symbols": F.log1p(share("n_symbols", "word_chars")),
        "f_repeats": F.log1p(share("n_repeat_words", "n_words")),
        "f_lines": F.log1p("n_dup_lines"),
        "f_capitals": F.log1p(share("capitals", "word_chars")),
    }).drop("capitals")


def _inverse(m: Column) -> Column:
    """(inverse, log determinant) of a symmetric positive matrix given as array of rows, by elimination."""
    wide = F.transform(m, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), F.lit(D - 1)), lambda j: F.when(i == j, 1.0).otherwise(0.0))))

    def step(a: Column, k: Column) -> Column:
        row_k = F.get(a["m"], k)
        pivot = F.get(row_k, k)
        out = F.transform(
            a["m"],
            lambda row, i: F.when(i == k, F.transform(row, lambda x: x / pivot)).otherwise(
                F.zip_with(row, row_k, lambda x, y: x - F.get(row, k) * y / pivot)
            ),
        )
        return F.struct(out.alias("m"), (a["logdet"] + F.log(pivot)).alias("logdet"))

    start = F.struct(wide.alias("m"), F.lit(0.0).alias("logdet"))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(D - 1)), start, step,
        lambda a: F.struct(F.flatten(F.transform(a["m"], lambda r: F.slice(r, D + 1, D))).alias("inv"), a["logdet"].alias("logdet")),
    )


def _estimate(weight: Column) -> list[Column]:
    """Aggregates for mean and second moments of the rows that weight marks."""
    f = PARTS
    when = lambda c: F.coalesce(F.sum(F.when(weight, c)), F.lit(0.0))
    return [
        F.count(F.when(weight, 1)).alias("k"),
        F.array(*[when(F.col(x)) for x in f]).alias("s1"),
        F.array(*[F.array(*[when(F.col(x) * F.col(y)) for y in f]) for x in f]).alias("s2"),
    ]


def _shape(s: Column, floors: Column) -> Column:
    """(mean, inverse, log determinant) from the moments in struct s; no variance under the square of its floor."""
    k = F.greatest(s["k"], F.lit(1)).cast("double")
    mean = F.transform(s["s1"], lambda x: x / k)
    cov = F.transform(s["s2"], lambda row, i: F.transform(
        row, lambda x, j: _let(x / k - F.get(mean, i) * F.get(mean, j), lambda v: F.when(i == j, F.greatest(v, F.pow(F.get(floors, i), F.lit(2.0)))).otherwise(v))))
    return F.struct(mean.alias("mean"), _let(cov, _inverse).alias("fit"))


def _distance(mean: Column, inv: Column) -> Column:
    z = [F.col(x) - F.get(mean, F.lit(i)) for i, x in enumerate(PARTS)]
    terms = [z[i] * z[j] * F.get(inv, F.lit(i * D + j)) * (1.0 if i == j else 2.0) for i in range(D) for j in range(i, D)]
    return reduce(lambda a, b: a + b, terms)


def _with(rows: DataFrame, est: DataFrame, groups: int) -> DataFrame:
    return rows.join(F.broadcast(est) if groups <= BROADCAST_GROUPS else est, "g")


def _median(x: Column) -> Column:
    return F.percentile_approx(x, 0.5, 1000)


def estimates(vectors: DataFrame) -> DataFrame:
    """g, e (mean, fit with inverse), scale, n of each group g of vectors (g, PARTS, n_words, word_chars).

    Distinct vectors count once. Ties at a median or at the edge of the half are inside.
    """
    rows = scratch(vectors.distinct(), "vectors")
    mid = rows.groupBy("g").agg(*[_median(F.col(x)).alias(x) for x in PARTS], _median(F.col("n_words")).alias("w"), _median(F.col("word_chars")).alias("c"))
    mid = scratch(mid, "medians")
    groups = mid.count()
    m = mid.select("g", F.struct(*PARTS).alias("m"), "w", "c")
    mads = _with(rows.select("g", *PARTS), m, groups).groupBy("g").agg(
        *[F.first(x).alias(x) for x in ("m", "w", "c")], F.array(*[1.4826 * _median(F.abs(F.col(x) - F.col("m")[x])) for x in PARTS]).alias("mad")
    )
    mads = scratch(mads, "deviations")
    spread = mads.agg(*[_median(F.get("mad", F.lit(i))).alias(x) for i, x in enumerate(PARTS)]).first()
    steps = {
        "f_size": 1 / (F.col("w") + 1), "f_length": 1 / (F.col("c") + 1), "f_symbols": F.log1p(100 / (F.col("c") + 1)),
        "f_repeats": F.log1p(600 / (F.col("w") + 1)), "f_lines": F.lit(math.log(2)), "f_capitals": F.log1p(100 / (F.col("c") + 1)),
    }
    floors = F.array(*[F.greatest(2 * steps[x], F.lit(0.5 * (spread[x] or 0.0))) for x in PARTS])
    table = scratch(mads.select("g", "m", "mad", floors.alias("floors")), "floors")
    z = [F.abs(F.col(x) - F.col("m")[x]) / F.greatest(F.get("mad", F.lit(i)), F.get("floors", F.lit(i))) for i, x in enumerate(PARTS)]
    starts = {"d1": reduce(lambda a, b: a + b, [x * x for x in z]), "d2": F.greatest(*z)}
    made = [mid, mads, table]

    def moved(near: DataFrame, weights: dict[str, Column], cuts: DataFrame) -> DataFrame:
        """g, floors and the estimates of the rows that weigh."""
        agg = _with(near, cuts, groups).groupBy("g").agg(F.first("floors").alias("floors"), *[F.struct(*_estimate(w)).alias(c) for c, w in weights.items()])
        made.append(scratch(agg.select("g", "floors", *[_shape(F.col(c), F.col("floors")).alias(c) for c in weights]), "shapes"))
        return made[-1]

    for _ in range(STEPS + 1):
        near = _with(rows, table, groups).select("g", "floors", *PARTS, *[d.alias(c) for c, d in starts.items()])
        cut = scratch(near.groupBy("g").agg(*[_median(F.col(c)).alias(f"{c}_cut") for c in starts]), "halves")
        made.append(cut)
        table = moved(near, {c: F.col(c) <= F.col(f"{c}_cut") for c in starts}, cut)
        starts = {c: _distance(F.col(c)["mean"], F.col(c)["fit"]["inv"]) for c in starts}
    best = F.when(F.col("d1")["fit"]["logdet"] <= F.col("d2")["fit"]["logdet"], F.col("d1")).otherwise(F.col("d2"))
    far = _distance(F.col("e")["mean"], F.col("e")["fit"]["inv"])
    near = _with(rows, table.select("g", "floors", best.alias("e")), groups).select("g", "floors", *PARTS, far.alias("d"))
    scale = F.greatest(_median(F.col("d")) / CHI_MEDIAN, F.lit(LEAST_SCALE))
    cut = scratch(near.groupBy("g").agg(scale.alias("scale")), "scales")
    wide = moved(near, {"e": F.col("d") <= CHI_WIDE * F.col("scale")}, cut)
    out = _with(rows, wide, groups).groupBy("g").agg(F.first("e").alias("e"), F.count("*").alias("n"), F.greatest(_median(far) / CHI_MEDIAN, F.lit(LEAST_SCALE)).alias("scale"))
    out = scratch(out, "estimates")
    discard(rows, cut, *made)
    return out


def judged(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance per row of docs, and
    the columns named in also.

    docs: doc_id, text, lang, source; other columns are ignored. Words are runs of other characters than ASCII white
    space; a null text has none, so it fails the base. base_failed: under 50 words, or more than half of them in
    repeated 3-word windows. kept: not base_failed and within CUT of its group's estimate; estimates come from rows
    that pass the base. Null languages and sources are groups of their own; groups of under MIN_GROUP distinct vectors are
    pooled by language, and rows of still smaller pools are judged by the estimate of all rows (tables of under MIN_ALL vectors: kept). Repeated rows come back as often as they came,
    and every row is judged by its own text. An empty table gives an empty result. Statistics are computed inside the row, at
    some 100 bytes of memory for each word of its text.
    """
    s = statistics(docs, also)
    own, lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct(F.col("lang").alias("pool")))
    s = scratch(s.withColumns({"own": own, "by_lang": lang}), "stats")
    vector = [*PARTS, "n_words", "word_chars"]
    ok = s.where("not base_failed").select("own", "by_lang", *vector)
    small = ok.distinct().groupBy("own", "by_lang").agg(F.count("*").alias("n"))
    sums = small.groupBy("by_lang").agg(F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n"))).alias("pool"))
    names = small.join(sums, "by_lang").select(
        "own", F.when(F.col("n") >= MIN_GROUP, F.col("own")).when(F.col("pool") >= MIN_GROUP, F.col("by_lang")).otherwise(F.lit("all")).alias("g"),
    )
    names = scratch(names, "groups")
    n_names = names.count()
    rows = ok.join(F.broadcast(names) if n_names <= BROADCAST_GROUPS else names, "own").select("g", *vector)
    if names.where("g = 'all'").limit(1).count():
        rows = rows.where("g <> 'all'").unionByName(ok.select(F.lit("all").alias("g"), *vector))
    found = estimates(rows)
    full = names.join(found, "g").select("own", "e", "scale", "n")
    out = s.join(F.broadcast(full) if n_names <= BROADCAST_GROUPS else full, "own", "left")
    d = _distance(F.col("e")["mean"], F.col("e")["fit"]["inv"]) / F.col("scale")
    kept = ~F.col("base_failed") & ((d <= CUT) | (F.col("n") < MIN_ALL))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(kept, F.lit(False)).alias("kept"), d.alias("distance"), *also,
    )


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, each by its own verdict whatever its doc_id; all columns stay."""
    keyed = row_key(docs, "doc_id", "text", "lang", "source")
    good = judged(keyed, also=("_a", "_b")).where("kept").select("_a", "_b").distinct()
    return keyed.join(good, ["_a", "_b"], "left_semi").select(*docs.columns)
