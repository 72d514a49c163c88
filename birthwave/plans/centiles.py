"""Centile analyses: birth cohorts over age, age bands over survey year, birth bands within age bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lms import PARAMS, fit_lms, lms_parameters, score_columns, score_sums, with_spline
from ..operators.staging import join_summary, stage
from ..operators.strata import age_band_sample, birth_age_bands, cohort_sample, expand_strata
from ..operators.weights import normalise_weights
from ..params import Params

BY = ["cohort", "stratum"]


def cohort_strata(clean: DataFrame, params: Params = Params()) -> DataFrame:
    """Persons by cohort and stratum with weights normalised by year within each."""
    rows = expand_strata(stage(cohort_sample(clean, params), "cohort-sample"))
    return normalise_weights(rows, [*BY, "year"], "wt_int")


def age_band_strata(clean: DataFrame, params: Params = Params()) -> DataFrame:
    rows = expand_strata(stage(age_band_sample(clean, params), "age-band-sample"))
    return normalise_weights(rows, [*BY, "year"], "wt_int")


def _splined(rows: DataFrame, x: str, df_terms: int) -> tuple[DataFrame, list[str]]:
    rows, terms = with_spline(rows, x, df_terms, BY)
    return stage(rows.select(*BY, "row_id", x, "bmi", "w", *terms), "centile-rows"), terms


def _fit(rows: DataFrame, x: str, df_terms: int, reps: int, seed: int) -> tuple[DataFrame, DataFrame]:
    rows, terms = _splined(rows, x, df_terms)
    coef = fit_lms(rows, "bmi", terms, "w", BY, "row_id", reps, seed)
    grid = rows.select(*BY, x, *terms).distinct()
    return coef, lms_parameters(coef, grid, BY, x, {t: t for t in terms})


def fit_certificate(rows: DataFrame, x: str, df_terms: int, least: int = 100) -> DataFrame:
    """Point fits of strata with ``least`` rows or more, judged by a scoring pass at their solutions.

    ``slope`` is the largest score of a coefficient in units of its standard
    error, ``concave`` whether every coefficient's own information is positive.
    """
    large = rows.groupBy(*BY).count().where(F.col("count") >= least).select(*BY)
    rows, terms = _splined(join_summary(rows, large, BY, "left_semi"), x, df_terms)
    coef = fit_lms(rows, "bmi", terms, "w", BY, "row_id")
    names = ["(Intercept)", *terms]
    p = len(names)
    at = [(b, i, (F.col("param") == PARAMS[b]) & (F.col("term") == t)) for b in range(3) for i, t in enumerate(names)]
    wide = coef.groupBy(*BY).agg(F.max("converged").alias("converged"), *[F.max(F.when(c, F.col("beta"))).alias(f"c{b * p + i}") for b, i, c in at])
    met = join_summary(rows, wide, BY, "inner")
    sums = score_sums(score_columns(met, "bmi", terms), [*BY, "converged"], "w", terms)
    own = [(F.abs(F.col(f"g{b}_{i}")), F.col(f"i{b}{b}_{i}_{i}")) for b, i, _ in at]
    slope = F.greatest(*[g / F.sqrt(F.when(v > 0, v)) for g, v in own])
    concave = F.least(*[v for _, v in own]) > 0
    return sums.select(*BY, "n", "converged", concave.alias("concave"), slope.alias("slope"))


def cohort_centiles(clean: DataFrame, reps: int, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Coefficients, and mu, sigma, nu by cohort, stratum, replicate and age."""
    return _fit(cohort_strata(clean, params), "age", 2, reps, params.seed)


def age_band_centiles(clean: DataFrame, reps: int, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """The same by age band over survey year, with one more spline term."""
    return _fit(age_band_strata(clean, params), "year", 3, reps, params.seed)


def birth_band_centiles(clean: DataFrame, params: Params = Params()) -> DataFrame:
    """Log-link centile parameters per birth band within each age band, unweighted.

    With one factor in all three parameters each level is fitted on its own,
    so levels are strata and need no contrasts.
    """
    rows = birth_age_bands(clean).where(F.col("bmi").isNotNull()).withColumn("one", F.lit(1.0))
    rows = stage(rows.select("age_range", "birth_range", "row_id", "bmi", "one"), "band-rows")
    by = ["age_range", "birth_range"]
    coef = fit_lms(rows, "bmi", [], "one", by, "row_id", mu_link="log")
    wide = coef.groupBy(*by, "boot", "converged").pivot("param", ["mu", "sigma", "nu"]).agg(F.first("beta"))
    return wide.withColumn("sigma", F.exp("sigma"))
