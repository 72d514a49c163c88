"""Counts, completeness and summaries of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Valid count and percentage per variable, from one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    long = counts.unpivot(["_n"], columns, "variable", "n_valid")
    pct = F.col("n_valid") * 100.0 / F.nullif(F.col("_n"), F.lit(0))
    return long.select("variable", "n_valid", pct.alias("pct_valid"))


def observed_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in all, rows complete in ``columns``, and their percentage."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    out = df.agg(F.count(F.lit(1)).alias("n_all"), F.count(F.when(whole, 1)).alias("n_obs"))
    return out.withColumn("pct", F.col("n_obs") * 100.0 / F.nullif(F.col("n_all"), F.lit(0)))


def count_by(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def six_numbers(counts: DataFrame, value: str, key: str) -> DataFrame:
    """Range, quartiles and mean of a column of counts, with the keys at both ends.

    Ties at an end go to the smaller key. Meant for grouped counts: the exact
    quartiles hold the distinct values of ``value`` in one task.
    """
    first = F.min_by(key, F.struct(-F.col(value), F.col(key)))
    last = F.max_by(key, F.struct(-F.col(value), F.col(key)))
    q1, q2, q3 = (F.percentile(value, F.lit(p)) for p in (0.25, 0.5, 0.75))
    return counts.agg(
        F.min(value).alias("min_n"), q1.alias("q1"), q2.alias("median"), F.avg(value).alias("mean"),
        q3.alias("q3"), F.max(value).alias("max_n"),
        first.alias("first_key"), last.alias("last_key"),
    )
