"""Analysis samples: age windows, follow-up, strata, bands and rescaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import band, range_label
from .staging import join_summary


def in_window(df: DataFrame, x: str, low, high) -> DataFrame:
    return df.where(F.col(x).between(low, high))


def follow_up(df: DataFrame, by: list[str], x: str, max_at_least: int, min_at_most: int) -> DataFrame:
    """Rows of the groups whose range of x covers the required span.

    Group ranges come from one aggregation; no window sorts the rows of a group.
    """
    kept = (
        df.groupBy(*by)
        .agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        .where((F.col("_hi") >= max_at_least) & (F.col("_lo") <= min_at_most))
        .select(*by)
    )
    return join_summary(df, kept, by, "left_semi")


def expand_strata(df: DataFrame, sex: str = "sex", name: str = "stratum") -> DataFrame:
    """One row per stratum a person belongs to: their own sex, and ``all``."""
    return df.where(F.col(sex).isNotNull()).withColumn(
        name, F.explode(F.array(F.lower(sex), F.lit("all")))
    )


def rescale(df: DataFrame, x: str, name: str, by: list[str] = ()) -> DataFrame:
    """Min-max rescaling of x to [0, 1], over the whole table or per group.

    The whole-table range is a scalar subquery, so rows keep their partitions.
    """
    by = list(by)
    span = [F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")]
    if by:
        ranges = df.groupBy(*by).agg(F.struct(*span).alias("_span"))
        rows = join_summary(df, ranges, by)
    else:
        rows = df.withColumn("_span", df.agg(F.struct(*span).alias("_span")).scalar())
    low, high = F.col("_span.lo"), F.col("_span.hi")
    return rows.withColumn(name, (F.col(x) - low) / F.nullif(high - low, F.lit(0.0))).drop("_span")


def birth_age_bands(
    df: DataFrame, width: int = 5, age_from: int = 20, age_to: int = 59, bmi_from: float = 9.0, bmi_to: float = 90.0
) -> DataFrame:
    """Aligned birth and age bands: the ages a birth band has in the survey year."""
    rows = df.withColumn("birth_lb", band("birth", width))
    rows = rows.withColumn("birth_ub", F.col("birth_lb") + (width - 1))
    rows = rows.withColumns(
        {"age_lb": F.col("year") - F.col("birth_ub"), "age_ub": F.col("year") - F.col("birth_lb")}
    )
    rows = rows.where(
        F.col("bmi").between(bmi_from, bmi_to)
        & (F.col("age_lb") >= age_from)
        & (F.pmod("age_lb", F.lit(width)) == 0)
        & (F.col("age_ub") <= age_to)
    )
    return rows.withColumns(
        {"birth_range": range_label("birth_lb", width), "age_range": range_label("age_lb", width)}
    )


def value_grid(df: DataFrame, x: str, low: int, high: int) -> DataFrame:
    """Distinct values of an integer x in a window: at most ``high - low + 1`` rows."""
    return in_window(df, x, low, high).select(x).distinct()


def right_join_grid(rows: DataFrame, grid: DataFrame, x: str) -> DataFrame:
    """Rows right-joined to a grid of values: grid values without rows are kept.

    Written as matched rows plus the unmatched grid values, because a right
    join cannot broadcast its right side and would move every row.
    """
    seen = rows.select(x).distinct()
    matched = join_summary(rows, grid, [x], "left_semi")
    empty = grid.join(seen, [x], "left_anti")
    return matched.unionByName(empty, allowMissingColumns=True)


def cohort_sample(clean: DataFrame, params) -> DataFrame:
    """Complete cases of birth decades with enough follow-up, as used for centiles.

    The upper bound on the youngest age keeps the window length above the age
    limit, so it never binds; the follow-up is judged before rows with missing
    values leave.
    """
    rows = in_window(clean.drop("edu"), "age", params.age_low, params.age_high)
    rows = rows.withColumn("cohort", band("birth", 10))
    rows = follow_up(rows, ["cohort"], "age", params.youngest_end, params.age_high + params.follow_up + 1)
    return rows.where(F.col("cohort") > 1920).na.drop()


def age_band_sample(clean: DataFrame, params, width: int = 5) -> DataFrame:
    """Complete cases by age band, without a follow-up condition."""
    rows = clean.drop("edu").withColumn("cohort", band("age", width))
    return in_window(rows, "age", params.age_low, params.age_high).na.drop()
