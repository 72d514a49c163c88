"""Coefficient tables to values: linear predictors, pivots and un-coding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import sum_or_null
from .staging import join_summary


def long_design(grid: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """One row per grid point and term, the intercept included."""
    wide = grid.select(*keys, F.lit(1.0).alias("(Intercept)"), *[F.col(c).alias(t) for t, c in columns.items()])
    return wide.unpivot(keys, ["(Intercept)", *columns], "term", "value")


def linear_predictor(
    coef: DataFrame, design: DataFrame, on: list[str], by: list[str], beta: str = "beta", name: str = "estimate"
) -> DataFrame:
    """Sum of coefficient times design value; null as soon as a term has no value."""
    rows = join_summary(coef, design, on)
    return rows.groupBy(*by).agg(sum_or_null(F.col(beta) * F.col("value")).alias(name))


def parameters_wide(long: DataFrame, by: list[str], value: str = "estimate", natural_sigma: bool = True) -> DataFrame:
    """mu, sigma and nu side by side, sigma on its own scale unless asked otherwise."""
    wide = long.groupBy(*by).pivot("param", ["mu", "sigma", "nu"]).agg(F.first(value))
    return wide.withColumn("sigma", F.exp("sigma")) if natural_sigma else wide


def uncode_levels(coef: DataFrame, by: list[str], base_level, intercept: str = "(Intercept)") -> DataFrame:
    """Level values from contrasts: the base level is the intercept, others add it.

    ``base_level`` names the level the contrasts refer to.
    """
    base = F.max(F.when(F.col("term") == intercept, F.col("beta")))
    pairs = F.collect_list(F.struct("term", "beta"))
    grouped = coef.groupBy(*by).agg(base.alias("_base"), pairs.alias("_terms"))
    is_base = F.col("_t.term") == intercept
    return grouped.withColumn("_t", F.explode("_terms")).select(
        *by,
        F.when(is_base, F.lit(base_level)).otherwise(F.col("_t.term")).alias("term"),
        F.when(is_base, F.col("_base")).otherwise(F.col("_t.beta") + F.col("_base")).alias("beta"),
    )


def nest(df: DataFrame, by: list[str], columns: list[str], name: str = "data") -> DataFrame:
    """One row per key with its rows as a sorted array; meant for grouped tables, not persons."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def unnest(df: DataFrame, by: list[str], name: str = "data") -> DataFrame:
    return df.select(*by, F.inline(name))
