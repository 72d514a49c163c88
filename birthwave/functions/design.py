"""Design columns computed from the distinct values of a covariate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spline_knots(df: DataFrame, x: str, df_terms: int, by: list[str]) -> DataFrame:
    """Knots per group: quantiles of the distinct values, and their range.

    The percentiles run over distinct values only, so a group's state is
    bounded by the number of values and not by its rows.
    """
    probs = [i / df_terms for i in range(1, df_terms)]
    distinct = df.select(*by, F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull()).distinct()
    inner = F.percentile(x, F.array(*[F.lit(p) for p in probs]))
    knots = F.concat(F.array(F.min(x)), inner, F.array(F.max(x)))
    return distinct.groupBy(*by).agg(knots.alias("knots"), F.count(F.lit(1)).alias("n_values"))


def natural_spline(x, knots, df_terms: int) -> list[Column]:
    """Natural cubic basis without intercept, on x scaled to its boundary knots."""
    x = F.col(x) if isinstance(x, str) else x
    knots = F.col(knots) if isinstance(knots, str) else knots
    n_knots = df_terms + 1
    low, high = knots[0], knots[n_knots - 1]
    width = F.nullif(high - low, F.lit(0.0))

    def scaled(v):
        return F.coalesce((v - low) / width, F.lit(0.0))

    s = scaled(x.cast("double"))
    last = F.lit(1.0)

    def cube(at):
        return F.pow(F.greatest(s - at, F.lit(0.0)), F.lit(3.0))

    def truncated(k):
        at = scaled(knots[k])
        return F.coalesce((cube(at) - cube(last)) / F.nullif(last - at, F.lit(0.0)), F.lit(0.0))

    tail = truncated(n_knots - 2)
    return [s] + [truncated(k) - tail for k in range(n_knots - 2)]


def ortho_poly(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Orthonormal linear and quadratic terms on the distinct values of x.

    One aggregate row per group (size, mean and central moments of the distinct
    values) gives the recurrence; it is joined back, so no task holds the values
    of a group. A group needs two values for the linear term and three for the
    quadratic one, and has null where a term is not defined.
    """
    rows = df.select(*by, F.col(x).cast("double").alias(x)).where(F.col(x).isNotNull()).distinct()
    moments = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt")]
    if by:
        # A struct, unlike its fields, is equal to itself where a key is null.
        rows = rows.withColumn("_g", F.struct(*by))
        rows = rows.join(rows.groupBy("_g").agg(F.struct(*moments).alias("_m")), "_g")
    else:
        rows = rows.withColumn("_m", rows.agg(F.struct(*moments)).scalar())
    m = {c: F.col(f"_m.{c}") for c in ("n", "mean", "var", "skew", "kurt")}
    d = F.col(x) - m["mean"]
    s2 = F.when(m["n"] >= 2, m["n"] * m["var"])
    a, b = m["skew"] * F.sqrt(m["var"]), m["var"]
    norm = F.when(m["n"] >= 3, m["n"] * m["var"] * m["var"] * (m["kurt"] + 2 - m["skew"] * m["skew"]))
    return rows.select(*by, x, (d / F.sqrt(s2)).alias("p1"), ((d * d - a * d - b) / F.sqrt(norm)).alias("p2"))
