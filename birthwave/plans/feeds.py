"""Tables behind the figures: selection, clean labels and category lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import centile_label, range_label, signed_label
from ..params import BMI_LINES, PARAMETER_NAMES

FIGURE_CENTILES = [10, 25, 50, 75, 90]
FIGURE_AGES = [25, 35, 45, 55]


def centile_feed(centiles: DataFrame, x: str, width: int, percents=FIGURE_CENTILES) -> DataFrame:
    """Selected centile curves with cohort, stratum and centile labels."""
    rows = centiles.where(F.col("centile").isin(list(percents)))
    return rows.select(
        range_label("cohort", width).alias("cohort"), F.initcap("stratum").alias("stratum"), x,
        centile_label("centile").alias("centile"), "beta", "lci", "uci", "n_used", "n_failed",
    )


def age_feed(centiles: DataFrame, width: int = 10, ages=FIGURE_AGES) -> DataFrame:
    """All centiles at selected ages."""
    rows = centiles.where(F.col("age").isin(list(ages)))
    return rows.select(
        range_label("cohort", width).alias("cohort"), F.initcap("stratum").alias("stratum"),
        F.concat(F.lit("Age "), F.col("age").cast("string")).alias("age_f"), "centile", "beta", "lci", "uci", "n_used", "n_failed",
    )


def parameter_feed(parameters: DataFrame, width: int = 10) -> DataFrame:
    """Parameter curves under their display names, in display order."""
    names = F.create_map(*[F.lit(v) for pair in PARAMETER_NAMES.items() for v in pair])
    order = F.array_position(F.array(*[F.lit(p) for p in PARAMETER_NAMES]), F.col("parameter"))
    return parameters.select(
        range_label("cohort", width).alias("cohort"), F.initcap("stratum").alias("stratum"), "age",
        names[F.col("parameter")].alias("param_clean"), order.cast("int").alias("param_order"), "beta", "lci", "uci", "n_used", "n_failed",
    )


def category_lines(feed: DataFrame, panel: str) -> DataFrame:
    """Body-mass category lines for every panel of a feed."""
    lines = F.array(*[F.struct(F.lit(v).alias("bmi"), F.lit(n).alias("label")) for v, n in BMI_LINES])
    return feed.select(panel).distinct().select(panel, F.inline(lines))


def trajectory_feed(trajectories: DataFrame) -> DataFrame:
    """Trajectories with display names of stratum and outcome."""
    outcome = F.when(F.col("outcome") == "bmi", "Predicted BMI").otherwise("Probability of\nObesity")
    return trajectories.withColumns({"sex_clean": F.initcap("sex"), "outcome_clean": outcome})


def pattern_feed(pattern: DataFrame) -> DataFrame:
    """Pattern-mixture predictions under signed labels of the shift."""
    return pattern.select(signed_label("diff", "kg/m2").alias("diff_clean"), "diff", "birth", "age", "pred")


def pattern_effects_feed(pattern: DataFrame) -> DataFrame:
    """Random effects by shift and birth year, long."""
    distinct = pattern.groupBy("diff", "birth").agg(F.first("re_1").alias("re_1"), F.first("re_2").alias("re_2"))
    long = distinct.unpivot(["diff", "birth"], ["re_1", "re_2"], "name", "value")
    name = F.when(F.col("name") == "re_1", "Random Intercept").otherwise("Random Slope")
    return long.withColumn("name", name)
