"""Quantiles and intervals over replicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import as_col


def quantile(x: Column, probs, approximate: bool = False) -> Column:
    """Interpolated sample quantiles of the values that exist."""
    if approximate:
        return F.percentile_approx(x, probs)
    return F.percentile(x, probs)


def point_and_interval(df: DataFrame, by: list[str], value, boot: str = "boot", approximate: bool = False) -> DataFrame:
    """Estimate from replicate 0, 95% percentile bounds from the other replicates, and how many of these have a value.

    One pass over the replicates; NaN counts as missing. The exact quantiles
    hold one number per replicate and group.
    """
    v = as_col(value)
    v = F.when(~F.isnan(v), v)
    again = F.when(F.col(boot) > 0, v)
    return df.groupBy(*by).agg(
        F.max(F.when(F.col(boot) == 0, v)).alias("beta"),
        quantile(again, F.lit(0.025), approximate).alias("lci"),
        quantile(again, F.lit(0.975), approximate).alias("uci"),
        F.count(again).alias("n_used"), F.count(F.when((F.col(boot) > 0) & v.isNull(), 1)).alias("n_failed"),
    )


def replicate_means(df: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Pooled point estimates: plain means over imputations."""
    return df.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])
