"""Statistics of blocks of rows, in the catalog's own schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import BBOX, COLUMN_STAT, stat_value


def block_statistics(
    rows: DataFrame, keys: list[str], columns: list[str], x: str | None = None, y: str | None = None, distinct: str = "approx"
) -> DataFrame:
    """keys, num_rows, columns array<column_stat>, bbox: what a footer would say of each block of rows.

    One pre-aggregated groupBy. distinct: "approx", "exact" (costs a row per block and value) or "none". NaN values are
    left out of bounds, as writers of footers leave them out; a column of nulls has no bounds. Sizes are those of plain
    values: eight bytes each, the bytes of texts.
    """
    types = dict(rows.dtypes)
    valid = lambda c: F.when(~F.isnan(c), F.col(c)) if types[c] in ("double", "float") else F.col(c)
    aggs = [F.count("*").alias("num_rows")]
    for i, c in enumerate(columns):
        count = {"approx": F.approx_count_distinct(c), "exact": F.countDistinct(c), "none": F.lit(None).cast("bigint")}[distinct]
        wide = F.length(F.col(c).cast("binary")) if types[c] in ("string", "binary") else F.when(F.col(c).isNotNull(), 8)
        aggs += [
            F.min(valid(c)).alias(f"lo{i}"), F.max(valid(c)).alias(f"hi{i}"), F.count(c).alias(f"n{i}"),
            (F.first(count) if distinct == "none" else count).alias(f"d{i}"), F.coalesce(F.sum(wide), F.lit(0)).cast("bigint").alias(f"b{i}"),
        ]
    if x and y:
        aggs += [f(valid(c)).cast("double").alias(n) for n, f, c in (("xmin", F.min, x), ("ymin", F.min, y), ("xmax", F.max, x), ("ymax", F.max, y))]
    g = rows.groupBy(*keys).agg(*aggs)
    stats = [
        F.struct(
            F.lit(c).alias("path"), F.lit(types[c]).alias("type"), F.lit("PLAIN").alias("codec"), F.col("num_rows").alias("num_values"),
            F.col(f"b{i}").alias("compressed_bytes"), F.col(f"b{i}").alias("uncompressed_bytes"),
            stat_value(F.col(f"lo{i}"), types[c]).alias("min_raw"), stat_value(F.col(f"hi{i}"), types[c]).alias("max_raw"),
            (F.col("num_rows") - F.col(f"n{i}")).alias("null_count"), F.col(f"d{i}").cast("bigint").alias("distinct_count"),
            F.lit(None).cast(BBOX).alias("geo_bbox"), F.lit(None).cast("array<int>").alias("geo_types"), F.lit(None).cast("array<string>").alias("segments"),
        ).cast(COLUMN_STAT)
        for i, c in enumerate(columns)
    ]
    box = F.lit(None).cast(BBOX)
    if x and y:
        edges = [F.col(e) for e in ("xmin", "ymin", "xmax", "ymax")]
        known = edges[0].isNotNull() & edges[1].isNotNull()
        box = F.when(known, F.struct(*edges)).cast(BBOX)
    return g.select(*keys, "num_rows", F.array(*stats).alias("columns"), box.alias("bbox"))


def total(field: str, columns: Column | str = "columns") -> Column:
    """Sum of a field over the column records of a row group: no shuffle."""
    return F.aggregate(columns, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c[field], F.lit(0).cast("bigint")))


def with_totals(row_groups: DataFrame) -> DataFrame:
    """total_compressed_bytes and total_uncompressed_bytes of each row group."""
    return row_groups.withColumns({f"total_{f}": total(f) for f in ("compressed_bytes", "uncompressed_bytes")})
