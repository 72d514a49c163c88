"""Multilevel growth models from cells and sufficient statistics.

Persons are read once, into cells by sex, year, birth and age. Every
specification, its weights and its sums follow exactly from the cells, whose
number is bounded by survey years times ages and not by persons.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import band, interval, inverse_logit
from ..params import Params
from .reshape import linear_predictor
from .solvers import laplace, laplace_fit, reml, reml_fit
from .staging import join_summary

INTERCEPT, SLOPE = "(Intercept)", "age_s"
FIT_SCHEMA = (
    "outcome string, ran_pars string, n double, beta array<double>, vcov array<double>, sd array<double>, "
    "cor double, singular boolean, sigma double, loglik double, aic double, bic double, converged boolean, "
    "groups array<struct<birth:int,re0:double,re1:double,v00:double,v01:double,v11:double>>"
)


def spec_grid(
    sexes=("male", "female", "all"), widths=(1, 5), last_years=(2014, 2019), outcomes=("bmi", "obese"),
    randoms=("1 + age_s", "-1 + age_s"),
) -> list[dict]:
    """Specifications in order: every width is paired with the latest year, width one with all."""
    latest = max(last_years)
    rows = [
        dict(sex=s, cohort_y=c, last_year=y, outcome=o, ran_pars=r)
        for s, c, y, o, r in product(sexes, widths, last_years, outcomes, randoms)
        if c == 1 or y == latest
    ]
    return [dict(spec_id=i + 1, **row) for i, row in enumerate(rows)]


def spec_table(spark: SparkSession, specs: list[dict] | None = None) -> DataFrame:
    schema = "spec_id int, sex string, cohort_y int, last_year int, outcome string, ran_pars string"
    specs = spec_grid() if specs is None else specs
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in specs], schema)


def _samples(specs: list[dict]) -> list[tuple[int, int]]:
    return sorted({(s["cohort_y"], s["last_year"]) for s in specs})


def expand_samples(rows: DataFrame, specs: list[dict]) -> DataFrame:
    """One row per sample it enters: sex stratum, cohort width and last survey year."""
    table = [
        F.struct(F.lit(c).alias("cohort_y"), F.lit(y).alias("last_year")) for c, y in _samples(specs)
    ]
    rows = rows.where(F.col("sex").isNotNull())
    rows = rows.withColumn("sex", F.explode(F.array(F.lower("sex"), F.lit("all"))))
    rows = rows.where(F.col("sex").isin(sorted({s["sex"] for s in specs})))
    rows = rows.withColumn("_s", F.explode(F.array(*table)))
    rows = rows.withColumns({"cohort_y": F.col("_s.cohort_y"), "last_year": F.col("_s.last_year")}).drop("_s")
    rows = rows.where(F.col("year") <= F.col("last_year"))
    return rows.withColumn("birth", band("birth", F.col("cohort_y")))


def person_cells(rows: DataFrame, y: str = "bmi", w: str = "wt_int", threshold: float = 30.0, by=()) -> DataFrame:
    """The only pass over persons: counts and weighted sums by sex, year, birth and age."""
    has = F.col(y).isNotNull() & F.col(w).isNotNull()

    def total(value):
        return F.coalesce(F.sum(F.when(has, value)), F.lit(0.0))

    weight, value = F.col(w), F.col(y)
    return rows.groupBy(*by, "sex", "year", "birth", "age").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(w).alias("n_w"),
        F.coalesce(F.sum(w), F.lit(0.0)).alias("w_all"),
        F.count(F.when(has, 1)).alias("n"),
        total(weight).alias("sw"),
        total(weight * value).alias("swy"),
        total(weight * value * value).alias("swyy"),
        total(F.log(weight)).alias("slw"),
        total(F.when(value >= threshold, weight).otherwise(0.0)).alias("swo"),
    )


def sample_cells(cells: DataFrame, specs: list[dict], params: Params = Params()) -> DataFrame:
    """Cells of every sample with rescaled age, follow-up applied and weights normalised by year.

    A missing weight voids its survey year. The windows run over cells.
    """
    rows = expand_samples(cells, specs)
    sample = ["sex", "cohort_y", "last_year"]
    per_sample = Window.partitionBy(*sample)
    low, high = F.min("age").over(per_sample), F.max("age").over(per_sample)
    rows = rows.withColumn("age_s", (F.col("age") - low) / F.nullif((high - low).cast("double"), F.lit(0.0)))
    per_birth = Window.partitionBy(*sample, "birth")
    rows = rows.withColumns({"_lo": F.min("age").over(per_birth), "_hi": F.max("age").over(per_birth)})
    rows = rows.where((F.col("_lo") <= params.oldest_start) & (F.col("_hi") >= params.youngest_end))
    per_year = Window.partitionBy(*sample, "year")
    known = F.sum("n_w").over(per_year) == F.sum("n_all").over(per_year)
    factor = F.when(known, F.sum("n_all").over(per_year) / F.nullif(F.sum("w_all").over(per_year), F.lit(0.0)))
    rows = rows.withColumn("f", factor)
    return rows.withColumns(
        {c: F.col(c) * F.col("f") for c in ("sw", "swy", "swyy", "swo")}
        | {"slw": F.col("slw") + F.col("n") * F.log("f"), "n_used": F.when(F.col("f").isNotNull(), F.col("n")).otherwise(0)}
    ).drop("_lo", "_hi")


def sufficient_statistics(cells: DataFrame, by: list[str]) -> DataFrame:
    """Sums per group that determine the Gaussian likelihood of a linear growth model."""
    x = F.col("age_s")
    return cells.groupBy(*by, "birth").agg(
        F.sum("n_used").cast("double").alias("n"), F.sum("sw").alias("sw"), F.sum(F.col("sw") * x).alias("swx"),
        F.sum(F.col("sw") * x * x).alias("swxx"), F.sum("swy").alias("swy"),
        F.sum(F.col("swy") * x).alias("swxy"), F.sum("swyy").alias("swyy"), F.sum("slw").alias("slw"),
    ).where("n > 0")


def binary_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Weighted trials and events per group and age: all a logistic growth model needs."""
    return cells.where(F.col("f").isNotNull()).groupBy(*by, "birth", "age_s").agg(
        F.sum("n_used").cast("double").alias("n"), F.sum("sw").alias("sw"), F.sum("swo").alias("swo")
    ).where("sw > 0")


def _fit_row(keys: tuple, names: list[str], births, fit: dict) -> pd.DataFrame:
    groups = [
        dict(birth=int(b), re0=float(u[0]), re1=float(u[1]), v00=float(v[0, 0]), v01=float(v[0, 1]), v11=float(v[1, 1]))
        for b, u, v in zip(births, fit.pop("re"), fit.pop("re_var"))
    ]
    return pd.DataFrame([dict(zip(names, keys)) | fit | {"groups": groups}])


def fit_lmm(suff: DataFrame, by: list[str], randoms=("1 + age_s",)) -> DataFrame:
    """Weighted linear mixed models by REML, one row per key and random part.

    A key's input is one row of sums per group, so a task never sees persons.
    """
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in suff.select(*by).schema)
    names = [*by, "outcome", "ran_pars"]
    rows = suff.withColumn("ran_pars", F.explode(F.array(*[F.lit(r) for r in randoms])))

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("birth")
        result = reml_fit(pdf, slope_only=keys[-1].startswith("-1"))
        return _fit_row((*keys[:-1], "bmi", keys[-1]), names, pdf["birth"], result)

    return rows.groupBy(*by, "ran_pars").applyInPandas(fit, f"{key_schema}, {FIT_SCHEMA}")


def fit_glmm(cells: DataFrame, by: list[str], randoms=("1 + age_s",)) -> DataFrame:
    """Weighted logistic mixed models by the Laplace approximation, one row per key and random part."""
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*by).schema)
    names = [*by, "outcome", "ran_pars"]
    rows = cells.withColumn("ran_pars", F.explode(F.array(*[F.lit(r) for r in randoms])))

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        births, result = laplace_fit(pdf, slope_only=keys[-1].startswith("-1"))
        return _fit_row((*keys[:-1], "obese", keys[-1]), names, births, result)

    return rows.groupBy(*by, "ran_pars").applyInPandas(fit, f"{key_schema}, {FIT_SCHEMA}")


def terms_of(formula: str) -> list[str]:
    """Term columns of a formula such as ``1 + x1 + x2``; ``-1`` or ``0`` leaves the intercept out."""
    names = [t.strip() for t in formula.split("+")]
    return [INTERCEPT if t == "1" else t for t in names if t not in ("-1", "0")]


def _model_schema(rows: DataFrame, by: list[str], group: str) -> str:
    keys = [f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*by).schema]
    kind = rows.schema[group].dataType.simpleString()
    return "".join(keys) + (
        "n double, terms array<string>, beta array<double>, vcov array<double>, random array<string>, cov array<double>, "
        "sigma double, loglik double, aic double, bic double, singular boolean, converged boolean, reml boolean, "
        f"groups array<struct<level:{kind},effect:array<double>,var:array<double>>>"
    )


def _model_row(keys: tuple, by: list[str], levels, fit: dict, fixed: list[str], random: list[str], by_reml: bool) -> pd.DataFrame:
    groups = [dict(level=g, effect=u.tolist(), var=v.ravel().tolist()) for g, u, v in zip(levels, fit["re"], fit["re_var"])]
    row = dict(zip(by, keys)) | {k: fit[k] for k in ("n", "sigma", "loglik", "aic", "bic", "singular", "converged")}
    lists = {k: np.asarray(fit[k]).ravel().tolist() for k in ("beta", "vcov", "cov")}
    return pd.DataFrame([row | lists | {"terms": fixed, "random": random, "reml": by_reml, "groups": groups}])


def _term(name: str) -> Column:
    return F.lit(1.0) if name == INTERCEPT else F.col(name).cast("double")


def _random_places(fixed: list[str], random: list[str]) -> list[int]:
    missing = [t for t in random if t not in fixed]
    if missing or not random:
        raise ValueError(f"random terms must be some of the fixed terms {fixed}; got {random}")
    return [fixed.index(t) for t in random]


def fit_linear(rows: DataFrame, by: list[str], group: str, y: str, w: str | None, fixed: str, random: str) -> DataFrame:
    """Linear mixed models by REML with any terms, the random ones among the fixed; one row per key.

    Rows are read once, into cross products per key and group; rows without an
    outcome, a weight or a term take no part. A key's solver sees one row of
    sums per group. An empty ``by`` fits one model.
    """
    names, vary = terms_of(fixed), terms_of(random)
    places, p = _random_places(names, vary), len(names)
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    data = rows.select(*by, F.col(group), F.col(y).cast("double").alias("_y"), weight.alias("_w"), *[_term(t).alias(f"_t{i}") for i, t in enumerate(names)])
    data = data.na.drop(subset=[group, "_y", "_w", *[f"_t{i}" for i in range(p)]]).where("_w > 0")
    at = [(i, j) for i in range(p) for j in range(p)]
    wide = data.groupBy(*by, group).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.log("_w")).alias("_slw"), F.sum(F.expr("_w * _y * _y")).alias("_q"),
        F.array(*[F.sum(F.expr(f"_w * _t{i} * _t{j}")) for i, j in at]).alias("_a"),
        F.array(*[F.sum(F.expr(f"_w * _t{i} * _y")) for i in range(p)]).alias("_c"),
    )

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group)
        a, c = np.stack(pdf["_a"].to_numpy()).reshape(-1, p, p), np.stack(pdf["_c"].to_numpy())
        result = reml(a, c, pdf["_q"].sum(), pdf["_n"].sum(), pdf["_slw"].sum(), places)
        return _model_row(keys, by, pdf[group], result, names, vary, True)

    return wide.groupBy(*by).applyInPandas(fit, _model_schema(wide, by, group))


def fit_logistic(rows: DataFrame, by: list[str], group: str, y: str, w: str | None, fixed: str, random: str) -> DataFrame:
    """Logistic mixed models of a 0/1 outcome by the Laplace approximation, with any terms; one row per key.

    Rows shrink to weighted trials and events per key, group and combination of term values.
    """
    names, vary = terms_of(fixed), terms_of(random)
    places, p = _random_places(names, vary), len(names)
    weight = F.lit(1.0) if w is None else F.col(w).cast("double")
    data = rows.select(*by, F.col(group), F.col(y).cast("double").alias("_y"), weight.alias("_w"), *[_term(t).alias(f"_t{i}") for i, t in enumerate(names)])
    terms = [f"_t{i}" for i in range(p)]
    data = data.na.drop(subset=[group, "_y", "_w", *terms]).where("_w > 0")
    cells = data.groupBy(*by, group, *terms).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_w").alias("_sw"), F.sum(F.expr("_w * _y")).alias("_so")
    )

    def fit(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        levels, g = np.unique(pdf[group].to_numpy(), return_inverse=True)
        result = laplace(pdf[terms].to_numpy(float), pdf["_sw"].to_numpy(float), pdf["_so"].to_numpy(float), pdf["_n"].sum(), g, places)
        return _model_row(keys, by, levels.tolist(), result, names, vary, False)

    return cells.groupBy(*by).applyInPandas(fit, _model_schema(cells, by, group))


def as_models(fits: DataFrame, by: list[str]) -> DataFrame:
    """Fits of the specification grid in the layout of ``fit_linear`` and ``fit_logistic``."""
    slope_only = F.col("ran_pars").startswith("-1")
    v, sd = F.col("vcov"), F.col("sd")
    cross = F.col("cor") * sd[0] * sd[1]
    both = F.array(F.lit(INTERCEPT), F.lit(SLOPE))
    groups = F.transform("groups", lambda g: F.struct(
        g["birth"].alias("level"),
        F.when(slope_only, F.array(g["re1"])).otherwise(F.array(g["re0"], g["re1"])).alias("effect"),
        F.when(slope_only, F.array(g["v11"])).otherwise(F.array(g["v00"], g["v01"], g["v01"], g["v11"])).alias("var"),
    ))
    return fits.select(
        *by, "n", both.alias("terms"), "beta", F.array(v[0], v[1], v[1], v[2]).alias("vcov"),
        F.when(slope_only, F.array(F.lit(SLOPE))).otherwise(both).alias("random"),
        F.when(slope_only, F.array(sd[1] * sd[1])).otherwise(F.array(sd[0] * sd[0], cross, cross, sd[1] * sd[1])).alias("cov"),
        "sigma", "loglik", "aic", "bic", "singular", "converged", (F.col("outcome") == "bmi").alias("reml"), groups.alias("groups"),
    )


def model_terms(models: DataFrame, by: list[str], group: str = "birth") -> DataFrame:
    """Long summary: fixed effects with standard errors and statistics, then deviations and correlations of the random part.

    A logistic model has no residual deviation.
    """
    fixed = F.expr("""transform(terms, (t, i) -> struct(
        'fixed' AS effect, cast(null AS string) AS `group`, t AS term, get(beta, i) AS estimate, sqrt(get(vcov, i * size(terms) + i)) AS se))""")
    spread = F.expr(f"""transform(random, (t, i) -> struct(
        'ran_pars' AS effect, '{group}' AS `group`, 'sd__' || t AS term, sqrt(get(cov, i * size(random) + i)) AS estimate, cast(null AS double) AS se))""")
    linked = F.expr(f"""flatten(transform(random, (t, i) -> transform(slice(random, i + 2, size(random)), (o, j) -> struct(
        'ran_pars' AS effect, '{group}' AS `group`, 'cor__' || t || '.' || o AS term,
        get(cov, i * size(random) + i + 1 + j) / nullif(sqrt(get(cov, i * size(random) + i) * get(cov, (i + 1 + j) * size(random) + i + 1 + j)), 0D) AS estimate,
        cast(null AS double) AS se))))""")
    left = F.expr("""if(reml, array(struct('ran_pars' AS effect, 'Residual' AS `group`, 'sd__Observation' AS term, sigma AS estimate, cast(null AS double) AS se)),
        array())""")
    rows = models.select(*by, F.inline(F.concat(fixed, spread, linked, left)))
    return rows.withColumn("statistic", F.col("estimate") / F.nullif(F.col("se"), F.lit(0.0)))


def model_summaries(models: DataFrame, by: list[str]) -> DataFrame:
    """One line per model: size, residual deviation, likelihood and criteria."""
    parameters = F.size("terms") + F.expr("size(random) * (size(random) + 1) div 2") + F.col("reml").cast("int")
    return models.select(
        *by, F.col("n").cast("bigint").alias("nobs"), "sigma", "loglik", "aic", "bic", (-2 * F.col("loglik")).alias("deviance"),
        (F.col("n") - parameters).cast("bigint").alias("df_residual"), F.size("groups").alias("n_groups"), "singular", "converged",
    )


def model_effects(models: DataFrame, by: list[str], group: str = "birth") -> DataFrame:
    """Group effects of any random part with conditional standard errors, long."""
    g = models.select(*by, "random", F.inline("groups"))
    rows = F.expr("transform(random, (t, i) -> struct(t AS term, get(effect, i) AS ranef, sqrt(greatest(get(var, i * size(random) + i), 0D)) AS se))")
    return g.select(*by, F.col("level").alias(group), F.inline(rows))


def model_fixed(models: DataFrame, by: list[str]) -> DataFrame:
    """Fixed effects with standard errors, long."""
    rows = F.expr("transform(terms, (t, i) -> struct(t AS term, get(beta, i) AS fixef, sqrt(get(vcov, i * size(terms) + i)) AS se))")
    return models.select(*by, F.inline(rows))


def fixed_effects(fits: DataFrame, by: list[str]) -> DataFrame:
    """Fixed effects with standard errors, long."""
    rows = F.array(
        F.struct(F.lit(INTERCEPT).alias("term"), F.col("beta")[0].alias("fixef"), F.sqrt(F.col("vcov")[0]).alias("se")),
        F.struct(F.lit(SLOPE).alias("term"), F.col("beta")[1].alias("fixef"), F.sqrt(F.col("vcov")[2]).alias("se")),
    )
    return fits.select(*by, F.inline(rows))


def random_effects(fits: DataFrame, by: list[str]) -> DataFrame:
    """Group effects with conditional standard errors, long; absent terms are left out."""
    g = fits.select(*by, "ran_pars", F.inline("groups"))
    rows = F.array(
        F.struct(F.lit(INTERCEPT).alias("term"), F.col("re0").alias("ranef"), F.sqrt("v00").alias("se")),
        F.struct(F.lit(SLOPE).alias("term"), F.col("re1").alias("ranef"), F.sqrt("v11").alias("se")),
    )
    long = g.select(*by, "ran_pars", "birth", F.inline(rows))
    return long.where(~((F.col("term") == INTERCEPT) & F.col("ran_pars").startswith("-1"))).drop("ran_pars")


def random_effect_intervals(effects: DataFrame, by: list[str]) -> DataFrame:
    low, high = interval("ranef", "se")
    name = F.when(F.col("term") == INTERCEPT, "Random Intercept").otherwise("Random Slope")
    return effects.select(*by, "birth", name.alias("term_clean"), "ranef", low.alias("lci"), high.alias("uci"))


def group_trajectories(
    fixed: DataFrame, effects: DataFrame, ranges: DataFrame, design: DataFrame, by: list[str], logit: bool = False
) -> DataFrame:
    """Predicted curve of every group over the ages at which it was observed.

    ``fixed`` (by, term, fixef), ``effects`` (by, birth, term, ranef), ``ranges``
    (by, birth, min_age, max_age) and ``design`` (by, age, term, value) are all
    coefficient-sized; a group without an effect for a term has effect zero.
    """
    base = fixed.select(*by, "term", "fixef").join(ranges, by)
    both = base.join(effects.select(*by, "birth", "term", "ranef"), [*by, "birth", "term"], "full")
    both = both.fillna(0.0, subset=["fixef", "ranef"])
    ages = both.withColumn("age", F.explode(F.sequence("min_age", "max_age")))
    ages = ages.withColumn("beta", F.col("fixef") + F.col("ranef"))
    out = linear_predictor(ages, design, [*by, "age", "term"], [*by, "birth", "age"])
    return out.withColumn("estimate", inverse_logit("estimate")) if logit else out


def clip_to_range(curves: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Curve points at ages between the youngest and oldest seen in their group."""
    rows = join_summary(curves, ranges.select(*by, "birth", "min_age", "max_age"), [*by, "birth"])
    return rows.where(F.col("age").between(F.col("min_age"), F.col("max_age"))).drop("min_age", "max_age")
