"""Schemas of the catalog, and small expressions on its nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A typed statistic; a null struct is unknown. kind: num, int, str, ts, bool or bin.
STAT_VALUE = "struct<kind: string, num: double, int: decimal(20,0), str: string, ts: timestamp, bool: boolean, bin: binary>"
BBOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
COLUMN_STAT = (
    "struct<path: string, type: string, codec: string, num_values: bigint, compressed_bytes: bigint, "
    f"uncompressed_bytes: bigint, min_raw: {STAT_VALUE}, max_raw: {STAT_VALUE}, null_count: bigint, "
    f"distinct_count: bigint, geo_bbox: {BBOX}, geo_types: array<int>, segments: array<string>>"
)
#: One row per row group, file-level fields repeated; a file without row groups or with an error has rg_index null.
RAW_ROW_GROUPS = (
    "file string, file_size bigint, geo_json string, rg0_paths array<string>, rg0_segments array<array<string>>, rg_index int, num_rows bigint, "
    f"file_offset bigint, columns array<{COLUMN_STAT}>, error string"
)
EDGES = ("xmin", "ymin", "xmax", "ymax")


def column_by_path(path: Column | str, columns: Column | str = "columns") -> Column:
    """The first column record with this dotted path; null if there is none."""
    path = F.lit(path) if isinstance(path, str) else path
    return F.get(F.filter(columns, lambda c: c["path"] == path), F.lit(0))


def column_by_segments(names: Column, columns: Column | str = "columns") -> Column:
    """The first column record with these names from the root on; a record without segments has its path cut at the dots."""
    return F.get(F.filter(columns, lambda c: F.coalesce(c["segments"], F.split(c["path"], r"\.")) == names), F.lit(0))


def finite(x: Column) -> Column:
    """True only for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def as_double(stat: Column) -> Column:
    """A numeric statistic as double; null for other kinds."""
    return F.when(stat["kind"] == "num", stat["num"]).when(stat["kind"] == "int", stat["int"].cast("double"))


def stat_value(value: Column, dtype: str) -> Column:
    """A plain value of a Spark type as typed statistic; null for null values and types without an order of their own."""
    kind, field, cast = {
        "bigint": ("int", "int", "decimal(20,0)"), "int": ("num", "num", "double"), "smallint": ("num", "num", "double"),
        "tinyint": ("num", "num", "double"), "float": ("num", "num", "double"), "double": ("num", "num", "double"),
        "string": ("str", "str", "string"), "date": ("ts", "ts", "timestamp"), "timestamp": ("ts", "ts", "timestamp"),
        "timestamp_ntz": ("ts", "ts", "timestamp"), "boolean": ("bool", "bool", "boolean"), "binary": ("bin", "bin", "binary"),
    }.get(dtype, ("", "", ""))
    if not kind:
        return F.lit(None).cast(STAT_VALUE)
    types = {"num": "double", "int": "decimal(20,0)", "str": "string", "ts": "timestamp", "bool": "boolean", "bin": "binary"}
    parts = [F.lit(kind).alias("kind")]
    parts += [(value.cast(cast) if f == field else F.lit(None).cast(t)).alias(f) for f, t in types.items()]
    return F.when(value.isNotNull(), F.struct(*parts)).cast(STAT_VALUE)
