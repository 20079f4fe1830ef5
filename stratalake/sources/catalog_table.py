"""O13 kept between runs: a catalog in dated partitions that a refresh brings up to date by opening changed files only.

A table folder holds ``row_groups`` (the catalog's rows of the files that a run opened) and ``files`` (a ledger: each file that a run
found new, changed or gone), both partitioned by catalog_date and run. A run writes row groups first and its ledger last: without a
ledger entry rows do not count, so a run that breaks off leaves no trace, and the next one takes its number and place. A file's newest
entry is its state. A refresh costs a listing, a join of two small tables and the footers that changed.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import RAW_ROW_GROUPS
from ..operators.geo import catalog
from .footers import list_files, scan

LEDGER = "file string, file_size bigint, modified timestamp, state string, error string, catalog_date date, run int"
#: Columns that tell that a file is as it was.
SAME = ("file", "file_size", "modified")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def ledger(spark: SparkSession, table: str) -> DataFrame:
    """All entries: file, file_size, modified, state (new, changed, gone), error, catalog_date, run."""
    if not _there(spark, f"{table}/files"):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{table}/files")


def newest(entries: DataFrame) -> DataFrame:
    """Each file's last entry, unless it says that the file is gone."""
    names = [c for c in entries.columns if c not in ("file", "run")]
    last = entries.groupBy("file").agg(F.max(F.struct("run", *names)).alias("e"))
    return last.select("file", "e.*").where("state <> 'gone'").select(*entries.columns)


def changes(listed: DataFrame, known: DataFrame, retry: bool = True) -> DataFrame:
    """file, file_size, modified, state: files of listed (file, file_size, modified) that are new or changed against known, and those gone.

    retry: files that could not be read count as changed.
    """
    fine = known.where(F.col("error").isNull()) if retry else known
    fresh = listed.join(fine, list(SAME), "left_anti")
    seen = known.select("file", F.lit(True).alias("_known"))
    fresh = fresh.join(seen, "file", "left").select(*SAME, F.when(F.col("_known"), "changed").otherwise("new").alias("state"))
    gone = known.join(listed.select("file"), "file", "left_anti").select(*SAME, F.lit("gone").alias("state"))
    return fresh.unionByName(gone)


def refresh(spark: SparkSession, lake: str, table: str, day: datetime.date | None = None, retry: bool = True, mounts: dict[str, str] | None = None) -> DataFrame:
    """Brings the catalog in the folder table up to date with the Parquet files below lake; returns the run's ledger entries.

    Only new and changed files (by size and time of modification) are opened. Several runs may bear one date; a run that finds no
    change makes no entry.
    """
    day = day or datetime.datetime.now(datetime.UTC).date()
    entries = ledger(spark, table)
    run = (entries.agg(F.max("run")).first()[0] or 0) + 1
    place = f"catalog_date={day.isoformat()}/run={run}"
    known = newest(entries)
    todo = changes(list_files(spark, lake, modified=True), known, retry)
    todo.write.mode("overwrite").parquet(f"{table}/todo/{place}")  # the listing is made once: what is opened is what is entered
    todo = spark.read.schema("file string, file_size bigint, modified timestamp, state string").parquet(f"{table}/todo/{place}")
    rows = catalog(scan(todo.where("state <> 'gone'"), mounts=mounts))
    rows.write.mode("overwrite").parquet(f"{table}/row_groups/{place}")
    errors = spark.read.schema(RAW_ROW_GROUPS).parquet(f"{table}/row_groups/{place}").where("error is not null").groupBy("file").agg(F.max("error").alias("error"))
    todo.join(errors, "file", "left").select(*SAME, "state", "error").write.mode("overwrite").parquet(f"{table}/files/{place}")
    return ledger(spark, table).where(F.col("run") == run)


def current(spark: SparkSession, table: str) -> DataFrame:
    """The catalog's rows of all files as the last run left them, with the date and run in which each was opened."""
    rows = catalog(spark.createDataFrame([], RAW_ROW_GROUPS)).selectExpr("*", "cast(null as date) as catalog_date", "cast(null as int) as run")
    if _there(spark, f"{table}/row_groups"):
        rows = spark.read.schema(rows.schema).option("basePath", f"{table}/row_groups").parquet(f"{table}/row_groups")
    return rows.join(newest(ledger(spark, table)).select("file", "run"), ["file", "run"])
