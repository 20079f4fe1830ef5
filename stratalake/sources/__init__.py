"""Readers of Parquet footers."""
