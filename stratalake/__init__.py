"""Layout and pruning audits of Parquet lakes as Spark jobs."""
