"""Summaries, drill-down and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MISSING, bbox_text, bytes_text, grouped, or_missing, stat_text

KEY = ["file", "rg_index"]


def drill_down(row_groups: DataFrame, selected: DataFrame) -> DataFrame:
    """The column records of the selected row groups (file, rg_index)."""
    return row_groups.join(selected.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, F.posexplode("columns").alias("ordinal", "c")).select(*KEY, "ordinal", "c.*")


def kept_selection(selection: DataFrame, matched: DataFrame) -> DataFrame:
    """Selected row groups that still match."""
    return selection.join(matched.select(*KEY), KEY, "left_semi")


def dropped_selection(selection: DataFrame, matched: DataFrame) -> DataFrame:
    """Selected row groups that no longer match."""
    return selection.join(matched.select(*KEY), KEY, "left_anti")


def with_visibility(row_groups: DataFrame, flags: DataFrame) -> DataFrame:
    """Visible from sparse flags (file, rg_index, visible), true where there is none."""
    f = flags.select(*KEY, F.col("visible").alias("_flag"))
    return row_groups.join(f, KEY, "left").withColumn("visible", F.coalesce("_flag", F.lit(True))).drop("_flag")


def file_summary(files: DataFrame, row_groups: DataFrame) -> DataFrame:
    """One row per file of files, also of those without row groups.

    row_groups needs num_rows, columns and the totals; ratio is 0 without compressed bytes, n_columns is that of the first
    row group.
    """
    g = row_groups.where("rg_index is not null").groupBy("file").agg(
        F.count("*").alias("n_row_groups"), F.sum("num_rows").alias("n_rows"), F.sum("total_compressed_bytes").alias("compressed_bytes"),
        F.sum("total_uncompressed_bytes").alias("uncompressed_bytes"), F.max(F.when(F.col("rg_index") == 0, F.size("columns"))).alias("n_columns"),
    )
    sums = ["n_row_groups", "n_rows", "compressed_bytes", "uncompressed_bytes", "n_columns"]
    out = files.join(g, "file", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in sums})
    ratio = F.when(F.col("compressed_bytes") > 0, F.col("uncompressed_bytes") / F.col("compressed_bytes")).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio)


def tri_state(row_groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By, n_visible, n_total, state all, some or none; no row groups count as all."""
    g = row_groups.groupBy(*(by or [])).agg(F.count_if("visible").alias("n_visible"), F.count("*").alias("n_total"))
    state = F.when(F.col("n_visible") == F.col("n_total"), "all").when(F.col("n_visible") == 0, "none").otherwise("some")
    return g.withColumn("state", state)


def column_paths(row_groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct column paths in order; only the paths are read and shuffled."""
    by = by or []
    return row_groups.select(*by, F.explode(F.transform("columns", lambda c: c["path"])).alias("path")).distinct().orderBy(*by, "path")


def row_group_report(row_groups: DataFrame) -> DataFrame:
    """The catalog for reading."""
    return row_groups.select(
        "file", "rg_index", "num_rows", bytes_text(F.col("total_compressed_bytes")).alias("compressed"),
        bytes_text(F.col("total_uncompressed_bytes")).alias("uncompressed"), or_missing(grouped(F.col("file_offset"))).alias("offset"),
        "bbox_source", or_missing(bbox_text(F.col("bbox"))).alias("bbox"),
        or_missing(F.array_join(F.col("geometry_types").cast("array<string>"), ", ")).alias("types"),
    )


def column_report(column_records: DataFrame) -> DataFrame:
    """Column records (as of drill_down) for reading. An empty text as bound is shown as such."""
    count = lambda c: or_missing(grouped(F.col(c))).alias(c)
    bound = lambda c: F.coalesce(stat_text(F.col(c)), F.lit(MISSING))
    return column_records.select(
        *KEY, "ordinal", "path", "type", "codec", "num_values", count("null_count"), count("distinct_count"),
        bytes_text(F.col("compressed_bytes")).alias("compressed"), bytes_text(F.col("uncompressed_bytes")).alias("uncompressed"),
        bound("min_raw").alias("min"), bound("max_raw").alias("max"), or_missing(bbox_text(F.col("geo_bbox"))).alias("geo_bbox"),
    )
