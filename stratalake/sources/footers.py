"""Parquet footers of many files as a table of row groups. Data pages are never read."""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import RAW_ROW_GROUPS
from .stores import opened, options

#: Row groups that a worker holds before it hands them on; files of a task.
HOLD, FILES_PER_TASK = 200, 256


def list_files(spark: SparkSession, path: str, globs: tuple[str, ...] = ("*.parquet", "*.geoparquet"), modified: bool = False) -> DataFrame:
    """file, file_size (and, if asked for, modified) of the Parquet files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{%s}" % ",".join(globs))
    more = [F.col("modificationTime").alias("modified")] if modified else []
    return reader.load(path).select(F.col("path").alias("file"), F.col("length").alias("file_size"), *more)


def _typed(v) -> dict | None:
    """A footer's statistic as typed value; anything else than numbers, texts, dates, bytes and booleans is unknown."""
    out = dict.fromkeys(("kind", "num", "int", "str", "ts", "bool", "bin"))
    if isinstance(v, bool):
        out |= {"kind": "bool", "bool": v}
    elif isinstance(v, int):
        out |= {"kind": "int", "int": decimal.Decimal(v)}
    elif isinstance(v, float | decimal.Decimal):
        out |= {"kind": "num", "num": float(v)}
    elif isinstance(v, str):
        out |= {"kind": "str", "str": v}
    elif isinstance(v, datetime.datetime):
        out |= {"kind": "ts", "ts": v if v.tzinfo else v.replace(tzinfo=datetime.UTC)}
    elif isinstance(v, datetime.date):
        out |= {"kind": "ts", "ts": datetime.datetime(v.year, v.month, v.day, tzinfo=datetime.UTC)}
    elif isinstance(v, bytes):
        out |= {"kind": "bin", "bin": v}
    else:
        return None
    return out


def _bounds(s, physical: str) -> tuple[dict | None, dict | None]:
    if s is None or not s.has_min_max:
        return None, None
    try:
        low, high = s.min, s.max
    except (NotImplementedError, OverflowError, ValueError):
        return None, None
    if physical == "INT32" and isinstance(low, int) and not isinstance(low, bool):
        low, high = float(low), float(high)
    return _typed(low), _typed(high)


def _leaves(t) -> int:
    """Columns that a field of this type takes in a file."""
    import pyarrow as pa

    if isinstance(t, pa.ExtensionType):
        return _leaves(t.storage_type)
    if pa.types.is_dictionary(t):
        return 1
    return sum(_leaves(t.field(i).type) for i in range(t.num_fields)) if t.num_fields else 1


def _below(fields: list, paths: list[str], before: tuple[str, ...], cut: int) -> Iterator[list[str]]:
    import pyarrow as pa

    at = 0
    for f in fields:
        mine, at = paths[at : at + _leaves(f.type)], at + _leaves(f.type)
        if any(p[cut : cut + len(f.name)] != f.name for p in mine):
            raise ValueError("the schema is not that of the columns")
        names, end = (*before, f.name), cut + len(f.name) + 1
        kind = f.type.storage_type if isinstance(f.type, pa.ExtensionType) else f.type
        if pa.types.is_struct(kind) and kind.num_fields:
            yield from _below([kind.field(i) for i in range(kind.num_fields)], mine, names, end)
        else:  # below lists and maps the names are the format's own
            yield from ([*names, *(p[end:].split(".") if p[end:] else [])] for p in mine)


def path_segments(schema, paths: list[str]) -> list[list[str]]:
    """The names from the root to each column, in a file's Arrow schema: a flat column "a.b" is one name, a field b of a is two."""
    try:
        out = list(_below(list(schema), paths, (), 0))
    except ValueError:
        out = []
    return out if len(out) == len(paths) else [p.split(".") for p in paths]


def _column(c, segments: list[str]) -> dict:
    s = c.statistics if c.is_stats_set else None
    low, high = _bounds(s, c.physical_type)
    geo = getattr(c, "geo_statistics", None)
    box = {"xmin": geo.xmin, "ymin": geo.ymin, "xmax": geo.xmax, "ymax": geo.ymax} if geo is not None else None
    return {
        "path": c.path_in_schema, "type": c.physical_type, "codec": c.compression, "num_values": c.num_values,
        "compressed_bytes": c.total_compressed_size, "uncompressed_bytes": c.total_uncompressed_size, "min_raw": low, "max_raw": high,
        "null_count": s.null_count if s is not None and s.has_null_count else None,
        "distinct_count": s.distinct_count if s is not None and s.has_distinct_count else None,
        "geo_bbox": box, "geo_types": list(geo.geospatial_types or []) if geo is not None else None, "segments": segments,
    }


def _segments(meta, paths: list[str]) -> list[list[str]]:
    try:
        schema = meta.schema.to_arrow_schema()
    except Exception:  # a type that Arrow has no counterpart of
        schema = ()
    return path_segments(schema, paths)


def _rows(file: str, size: int, settings: dict, mounts: dict | None) -> Iterator[dict]:
    import pyarrow.parquet as pq

    base = {"file": file, "file_size": size, "geo_json": None, "rg0_paths": None, "rg0_segments": None, "rg_index": None, "num_rows": None, "file_offset": None, "columns": None, "error": None}
    try:
        with opened(file, settings, mounts) as f:
            meta = pq.read_metadata(f)
        geo = (meta.metadata or {}).get(b"geo")
        base["geo_json"] = geo.decode("utf-8", "replace") if geo is not None else None
        groups = []
        for i in range(meta.num_row_groups):
            g = meta.row_group(i)
            groups.append((g, [g.column(j) for j in range(g.num_columns)]))
        base["rg0_paths"] = [c.path_in_schema for c in groups[0][1]] if groups else []
        base["rg0_segments"] = names = _segments(meta, base["rg0_paths"])
        for i, (g, columns) in enumerate(groups):
            starts = [x for c in columns for x in (c.dictionary_page_offset, c.data_page_offset) if x]
            yield base | {"rg_index": i, "num_rows": g.num_rows, "file_offset": min(starts, default=None), "columns": [_column(c, n) for c, n in zip(columns, names, strict=True)]}
        if not groups:
            yield base
    except Exception as e:  # a broken file is a row, not the end of the job
        yield base | {"error": f"{type(e).__name__}: {e}"[:500]}


def _scan(settings: dict[str, str], mounts: dict[str, str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[dict] = []

        def frame() -> pd.DataFrame:
            df = pd.DataFrame(held)
            for c in ("rg_index", "num_rows", "file_offset", "file_size"):
                df[c] = df[c].astype("Int64")
            return df

        for batch in batches:
            for file, size in zip(batch["file"], batch["file_size"], strict=True):
                for row in _rows(file, int(size), settings, mounts):
                    held.append(row)
                    if len(held) >= HOLD:
                        yield frame()
                        held.clear()
        if held:
            yield frame()

    return run


def scan(files: DataFrame, mounts: dict[str, str] | None = None) -> DataFrame:
    """Row groups of files (file, file_size): schema RAW_ROW_GROUPS.

    Names are taken as Spark lists them, whatever signs they hold, and opened in the store of their scheme (see stores) with the
    credentials of the cluster's configuration. mounts: beginnings of names, and the places that tasks find them under.

    A file without row groups gives one row with rg_index null, an unreadable one a row with error. Files are dealt out
    by their number, since footers cost about the same whatever the file's size.
    """
    tasks = max(1, -(-files.count() // FILES_PER_TASK))
    parts = max(tasks, files.sparkSession.sparkContext.defaultParallelism)
    run = _scan(options(files.sparkSession), mounts)
    return files.select("file", "file_size").repartition(parts).mapInPandas(run, RAW_ROW_GROUPS)


def column_statistics(row_groups: DataFrame) -> DataFrame:
    """O02 in long form: file, rg_index, ordinal and the fields of each column record."""
    return row_groups.select("file", "rg_index", F.posexplode("columns").alias("ordinal", "c")).select("file", "rg_index", "ordinal", "c.*")
