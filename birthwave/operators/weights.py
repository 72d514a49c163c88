"""Survey weights: normalisation and weighted moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sum_or_null
from .staging import join_summary


def weight_factors(df: DataFrame, by: list[str], w: str, null_policy: str = "propagate") -> DataFrame:
    """Factor per group that makes the weights sum to the number of rows.

    ``propagate``: one null weight voids its group. ``skip``: rows without a
    weight are left out of both counts. Weights that sum to zero have no factor.
    """
    if null_policy not in ("propagate", "skip"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    if null_policy == "propagate":
        factor = F.count(F.lit(1)) / F.nullif(sum_or_null(w), F.lit(0))
    else:
        factor = F.count(w) / F.nullif(F.sum(w), F.lit(0))
    return df.groupBy(*by).agg(factor.alias("_factor"))


def normalise_weights(
    df: DataFrame, by: list[str], w: str, name: str = "w", null_policy: str = "propagate"
) -> DataFrame:
    """Weights scaled to sum to the row count within each group.

    The group sums are aggregated before the join, so a group that holds most
    rows is never gathered in one task.
    """
    rows = join_summary(df, weight_factors(df, by, w, null_policy), by)
    return rows.withColumn(name, F.col(w) * F.col("_factor")).drop("_factor")


def weighted_variance(df: DataFrame, x: str, w: str, by: list[str] = ()) -> DataFrame:
    """Frequency-weighted variance and standard deviation of complete (x, w) pairs.

    Moments are taken about each group's plain mean, so a mean that is large
    against the spread does not cancel them. Weights that sum to one or less
    have no variance.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(w).isNotNull())
    centres = rows.groupBy(*by).agg(F.avg(x).alias("_centre"))
    if by:
        rows = join_summary(rows, centres, list(by))
    else:
        rows = rows.withColumn("_centre", centres.scalar())
    d = F.col(x) - F.col("_centre")
    n, s1, s2 = F.nullif(F.sum(w), F.lit(0)), F.sum(F.col(w) * d), F.sum(F.col(w) * d * d)
    out = rows.groupBy(*by).agg(F.sum(w).alias("sum_w"), (F.first("_centre") + s1 / n).alias("mean"), (s2 - s1 * s1 / n).alias("_ss"))
    variance = F.when(F.col("sum_w") > 1, F.greatest(F.col("_ss"), F.lit(0.0)) / (F.col("sum_w") - 1))
    return out.select(*by, "sum_w", "mean", variance.alias("variance"), F.sqrt(variance).alias("sd"))
