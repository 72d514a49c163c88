"""Outputs: the clean table by year, and small tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_clean(df: DataFrame, path: str) -> None:
    """Clean person table partitioned by survey year, so analyses prune by year.

    ``maxRecordsPerFile`` splits a year that holds most rows.
    """
    df.write.option("maxRecordsPerFile", 20_000_000).partitionBy("year").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
