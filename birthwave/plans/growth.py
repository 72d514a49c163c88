"""Multilevel growth analysis over the specification grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import mixed
from ..operators.lms import with_spline
from ..operators.staging import stage
from ..operators.strata import follow_up, in_window
from ..params import Params

SAMPLE = ["sex", "cohort_y", "last_year"]


def specification_cells(clean: DataFrame, specs: list[dict], params: Params = Params()) -> DataFrame:
    """Cells of all samples; the persons are aggregated once and staged."""
    rows = in_window(clean, "age", params.age_low, params.age_high)
    cells = stage(mixed.person_cells(rows, threshold=params.obese_from), "person-cells")
    return mixed.sample_cells(cells, specs, params)


def fit_specifications(cells: DataFrame, specs: list[dict]) -> DataFrame:
    """One fit per specification: linear for the measure, logistic for the indicator."""
    randoms = tuple(sorted({s["ran_pars"] for s in specs}, reverse=True))
    linear = mixed.fit_lmm(mixed.sufficient_statistics(cells, SAMPLE), SAMPLE, randoms)
    logistic = mixed.fit_glmm(mixed.binary_cells(cells, SAMPLE), SAMPLE, randoms)
    wanted = {s["outcome"] for s in specs}
    parts = [f for f, o in ((linear, "bmi"), (logistic, "obese")) if o in wanted]
    fits = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    table = mixed.spec_table(cells.sparkSession, specs)
    return table.join(fits, [*SAMPLE, "outcome", "ran_pars"]).select("spec_id", *fits.columns)


def specification_results(clean: DataFrame, specs: list[dict], params: Params = Params()) -> dict[str, DataFrame]:
    """Staged fits, trajectories and random effects of all specifications."""
    cells = stage(specification_cells(clean, specs, params), "sample-cells")
    fits = stage(fit_specifications(cells, specs), "spec-fits")
    ids = fits.select("spec_id", *SAMPLE, "outcome")
    ranges = cells.groupBy(*SAMPLE, "birth").agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    ranges = ids.join(ranges, SAMPLE).select("spec_id", "birth", "min_age", "max_age")
    design = cells.select(*SAMPLE, "age", "age_s").distinct()
    design = ids.join(design, SAMPLE).select(
        "spec_id", "age", F.lit(1.0).alias(mixed.INTERCEPT), F.col("age_s").alias(mixed.SLOPE)
    ).unpivot(["spec_id", "age"], [mixed.INTERCEPT, mixed.SLOPE], "term", "value")
    effects = mixed.random_effects(fits, ["spec_id"])
    curves = mixed.group_trajectories(mixed.fixed_effects(fits, ["spec_id"]), effects, ranges, design, ["spec_id"])
    curves = curves.join(ids, "spec_id")
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("estimate")))
    curves = curves.withColumn(
        "estimate", F.when(F.col("outcome") == "obese", probability).otherwise(F.col("estimate"))
    )
    return {
        "fits": fits, "trajectories": curves,
        "random_effects": mixed.random_effect_intervals(effects, ["spec_id"]),
        "terms": mixed.model_terms(mixed.as_models(fits, ["spec_id"]), ["spec_id"]),
        "summaries": mixed.model_summaries(mixed.as_models(fits, ["spec_id"]), ["spec_id"]),
    }


SPLINE = "1 + age_ns1 + age_ns2"


def spline_growth(clean: DataFrame, outcome: str = "bmi", random: str = SPLINE, params: Params = Params()) -> dict[str, DataFrame]:
    """One growth model with a spline of age whose terms vary by birth year: summaries, effects and trajectories.

    ``outcome`` is ``bmi`` (linear, unweighted) or ``obese`` (logistic).
    """
    rows = in_window(clean, "age", params.age_low, params.age_high).where(F.col("bmi").between(params.bmi_low, params.bmi_high))
    rows = follow_up(rows, ["birth"], "age", params.age_low + params.follow_up, params.age_high - params.follow_up)
    rows = rows.withColumns({"obese": (F.col("bmi") >= params.obese_from).cast("int"), "one": F.lit(1)})
    rows, terms = with_spline(rows, "age", 2, ["one"], "age_ns")
    rows = stage(rows.select("one", "birth", "age", "bmi", "obese", *terms), "growth-rows")
    fit = mixed.fit_logistic if outcome == "obese" else mixed.fit_linear
    models = stage(fit(rows, ["one"], "birth", outcome, None, SPLINE, random), "growth-model")
    ranges = rows.groupBy("one", "birth").agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    design = rows.select("one", "age", F.lit(1.0).alias(mixed.INTERCEPT), *terms).distinct()
    design = design.unpivot(["one", "age"], [mixed.INTERCEPT, *terms], "term", "value")
    effects = mixed.model_effects(models, ["one"])
    curves = mixed.group_trajectories(mixed.model_fixed(models, ["one"]), effects, ranges, design, ["one"], outcome == "obese")
    return {
        "models": models, "terms": mixed.model_terms(models, ["one"]).drop("one"), "summaries": mixed.model_summaries(models, ["one"]).drop("one"),
        "effects": effects.drop("one"), "trajectories": curves.drop("one"),
    }
