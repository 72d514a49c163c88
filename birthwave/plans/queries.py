"""Registered queries: each takes (spark, folder of the supplied tables) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.design import ortho_poly
from ..functions.scalar import at_least, band, centile_label, inverse_logit, range_label, signed_label
from ..operators import impute, intervals, lms, mixed, ols, profile, quantiles, ranks, resample, reshape, strata, weights
from ..operators.harmonise import age_from_band, band_bounds
from ..operators.staging import stage
from ..params import EDUCATION_LABELS, Params
from ..sources.catalog import file_catalog, rank_files, variable_dictionary
from ..sources.survey_view import AGE_BAND_LABELS, raw_survey
from ..sources.waves import scan_columns, union_waves
from . import centiles, feeds, growth
from .survey import clean_survey, clean_table, clean_through_files

P = Params()
SEXES = ["cohort", "stratum"]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


# Harmonisation and sources


def harmonised_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(clean_survey(spark, sf), "bmi", "wt_int")


def harmonised_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return clean_survey(spark, sf).groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("bmi").alias("n_bmi"), F.count("age").alias("n_age"),
        F.count("edu").alias("n_edu"), r6(F.sum("bmi")).alias("sum_bmi"), r6(F.sum("wt_int")).alias("sum_wt"),
    )


def wave_union(spark: SparkSession, sf: str) -> DataFrame:
    """Three eras read with their own columns, then united by name."""
    raw = raw_survey(spark, sf)
    early = raw.where(F.col("wave") <= 2002).select("row_id", "wave", "age", "ethnic", "nethnic", "ethnici")
    middle = raw.where(F.col("wave").between(2003, 2013)).select("row_id", "wave", "age", "samptype", "wt_int")
    late = raw.where(F.col("wave") >= 2014).select("row_id", "wave", "age90", "age35g", "wt_int")
    return union_waves([early, middle, late]).groupBy("wave").agg(
        F.count(F.lit(1)).alias("n"), F.count("age").alias("n_age"), F.count("age90").alias("n_age90"),
        F.count("age35g").alias("n_age35g"), F.count("ethnic").alias("n_ethnic"),
        F.count("samptype").alias("n_samptype"), F.count("wt_int").alias("n_wt"),
    )


def wave_files_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Raw wave files to the clean table on disk, read back for the years from 2000 on."""
    clean = clean_through_files(spark, sf, P).where(F.col("year") >= 2000)
    return clean.groupBy("year").agg(
        F.count(F.lit(1)).alias("n"), F.count("bmi").alias("n_bmi"), F.count("age").alias("n_age"), F.count("edu").alias("n_edu"),
        F.count_distinct("row_id").alias("n_ids"), r6(F.sum("bmi")).alias("sum_bmi"), r6(F.sum("wt_int")).alias("sum_wt"),
    )


def pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Listed columns and a pattern family of the order table, lower-cased."""
    df = scan_columns(spark.read.parquet(f"{sf}/orders.parquet"), ["O_OrderKey", "missing"], "(PRICE|status)")
    return df.groupBy("o_orderstatus").agg(
        F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Files of the data folder with size, ranked within their folder."""
    parent = sf.rstrip("/").rsplit("/", 1)[0]
    files = file_catalog(spark, parent, folder_pattern="^sf", whole_folders=[sf.rstrip("/").rsplit("/", 1)[1]], file_pattern="^$")
    return rank_files(files)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    found = variable_dictionary(spark, [f"{sf}/{t}.parquet" for t in TABLES])
    return found.select(F.regexp_extract("path", r"/([a-z]+)\.parquet", 1).alias("table_name"), "name", "label").distinct()


def file_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as files and their year as folder: count per folder and rank by size."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    files = orders.select(F.col("o_custkey").alias("fld"), F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"))
    return rank_files(files).drop("size")


def band_age_draw(spark: SparkSession, sf: str) -> DataFrame:
    """Random integer age inside the band of every banded row."""
    rows = raw_survey(spark, sf).where(F.col("age35g").isNotNull())
    low, high = band_bounds(F.col("age35g"), AGE_BAND_LABELS)
    return rows.select(
        "row_id", "age35g", low.alias("lo"), high.alias("hi"),
        age_from_band(F.col("age35g"), AGE_BAND_LABELS, "row_id", P.seed).alias("age"),
    )


def uniform_draws(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_table(spark, sf)
    return rows.select(
        "row_id", r6(draws.uniform("demo", F.lit(1), "row_id")).alias("u"),
        r6(draws.normal("demo", F.lit(1), "row_id")).alias("z"),
        draws.poisson_count(draws.uniform("demo", F.lit(1), "row_id")).alias("k"),
    )


# Samples, strata and weights


def cohort_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.cohort_sample(clean_table(spark, sf), P)
    return profile.count_by(rows, ["cohort", "sex"]).orderBy(F.desc("n"), "cohort", "sex")


def followup_kept(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high)
    kept = strata.follow_up(rows, ["birth"], "age", P.youngest_end, P.oldest_start)
    return kept.groupBy("birth").agg(
        F.count(F.lit(1)).alias("n"), F.min("age").alias("min_age"), F.max("age").alias("max_age")
    )


def stratum_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(strata.age_band_sample(clean_table(spark, sf), P))
    return profile.count_by(rows, ["cohort", "stratum"]).withColumn("label", range_label("cohort", 5))


def normalised_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = centiles.cohort_strata(clean_table(spark, sf), P)
    return rows.select("cohort", "stratum", "row_id", r6("w").alias("w"))


def weights_null_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of one in eleven persons removed: a year is voided or its others rescaled."""
    rows = clean_table(spark, sf).withColumn("w0", F.when(F.col("row_id") % 11 != 0, F.col("wt_int")))
    out = None
    for policy in ("propagate", "skip"):
        part = weights.normalise_weights(rows, ["year"], "w0", "w", policy).groupBy("year").agg(
            F.count("w").alias("n_w"), r6(F.sum("w")).alias("sum_w")
        ).withColumn("policy", F.lit(policy))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_mean_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    rows = centiles.cohort_strata(clean_table(spark, sf), P)
    wx = F.sum(F.col("w") * F.col("bmi")) / F.sum("w")
    return rows.groupBy("cohort", "stratum", "year").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("w")).alias("sum_w"), r6(wx).alias("mean_bmi")
    )


def obesity_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high)
    rows = strata.expand_strata(rows).withColumns(
        {"birth5": band("birth", 5), "obese": at_least("bmi", 30.0), "over": at_least("bmi", 30.0, strict=True)}
    )
    share = F.sum(F.col("wt_int") * F.col("obese")) / F.sum(F.when(F.col("obese").isNotNull(), F.col("wt_int")))
    return rows.groupBy("birth5", "stratum").agg(
        F.count("obese").alias("n"), F.sum("obese").alias("n_obese"), F.sum("over").alias("n_over"), r6(share).alias("share")
    )


def birth_age_bands(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.birth_age_bands(clean_table(spark, sf))
    return rows.groupBy("birth_range", "age_range", "birth_lb", "age_lb").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("bmi")).alias("mean_bmi")
    )


def rescaled_age(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high)
    rows = strata.rescale(rows, "age", "age_s")
    rows = strata.rescale(rows, "age", "age_b", ["birth"])
    return rounded(rows.select("row_id", "age_s", "age_b"), "age_s", "age_b")


def right_join_age_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Persons on the grid of all ages in the window."""
    clean = clean_table(spark, sf)
    grid = strata.value_grid(clean, "age", P.age_low, P.age_high)
    rows = strata.right_join_grid(clean.select("row_id", "age", "bmi"), grid, "age")
    return rows.groupBy("age").agg(F.count("row_id").alias("n"), r6(F.max("bmi")).alias("max_bmi"))


# Profiles


def completeness_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_table(spark, sf)
    out = profile.completeness(rows, ["year", "sex", "age", "bmi", "edu", "wt_int", "birth"])
    return rounded(out, "pct_valid")


def observed_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profile.observed_share(impute.missingness_frame(clean_table(spark, sf), P), ["sex", "bmi"]), "pct")


def count_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high)
    rows = strata.follow_up(rows, ["birth"], "age", P.youngest_end, P.age_high + P.follow_up + 1)
    return rounded(profile.six_numbers(profile.count_by(rows, ["year"]), "n", "year"), "q1", "median", "mean", "q3")


def weighted_variance(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(impute.missingness_frame(clean_table(spark, sf), P))
    return rounded(weights.weighted_variance(rows, "bmi", "wt_int", ["stratum"]), "sum_w", "mean", "variance", "sd")


def education_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Levels in their own order; levels that do not occur are dropped."""
    order = F.array_position(F.array(*[F.lit(e) for e in EDUCATION_LABELS]), F.col("edu")).cast("int")
    rows = clean_table(spark, sf).where(F.col("edu").isNotNull())
    return rows.groupBy("edu").agg(F.count(F.lit(1)).alias("n")).withColumn("edu_order", order)


def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Labels, cases, text tests and links on every clean row."""
    rows = clean_table(spark, sf)
    shift = F.col("age") - 40
    return rows.select(
        "row_id", F.lower("sex").alias("low"), F.initcap(F.lower("sex")).alias("title"),
        F.right(F.concat(F.lit("factor(year)"), F.col("year").cast("string")), F.lit(4)).cast("int").alias("last4"),
        F.regexp_replace("edu", "NVQ", "Level ").alias("edu_text"), F.col("edu").rlike("NVQ[0-9]").alias("is_nvq"),
        F.split("edu", " ")[0].alias("edu_head"), range_label(band("birth", 10), 10).alias("decade"),
        centile_label("age").alias("cent"), F.concat(F.lit("Age "), F.col("age").cast("string")).alias("age_label"),
        signed_label(shift, "kg/m2").alias("signed"), r6(inverse_logit(shift / 10.0)).alias("prob"),
        r6(F.sqrt(F.abs(shift.cast("double")))).alias("root"),
    )


# Design columns


def spline_basis(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    rows, terms = lms.with_spline(rows, "age", 2, SEXES)
    return rounded(rows.select(*SEXES, "age", *terms).distinct(), *terms)


def spline_basis_year(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(strata.age_band_sample(clean_table(spark, sf), P))
    rows, terms = lms.with_spline(rows, "year", 3, SEXES)
    return rounded(rows.select(*SEXES, "year", *terms).distinct(), *terms)


def poly_basis_by_cohort(spark: SparkSession, sf: str) -> DataFrame:
    """The same within birth decades; a decade seen at one or two ages lacks terms."""
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high).withColumn("cohort", band("birth", 10))
    return rounded(ortho_poly(rows, "age", ["cohort"]), "p1", "p2")


def poly_basis(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.in_window(clean_table(spark, sf), "age", P.age_low, P.age_high)
    return rounded(ortho_poly(rows, "age", []), "p1", "p2")


# Coefficients to predictions, at given coefficients

# Given coefficients of a centile model (parameter, term, value).
GIVEN_CENTILE_COEFFICIENTS = [
    ("mu", "(Intercept)", 25.0), ("mu", "ns1", 3.0), ("mu", "ns2", -0.4),
    ("sigma", "(Intercept)", -1.9), ("sigma", "ns1", 0.1), ("sigma", "ns2", 0.02),
    ("nu", "(Intercept)", -0.5), ("nu", "ns1", 0.2), ("nu", "ns2", 0.1),
]


def _given_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    rows, terms = lms.with_spline(rows, "age", 2, SEXES)
    grid = rows.select(*SEXES, "age", *terms).distinct()
    design = reshape.long_design(grid, [*SEXES, "age"], {t: t for t in terms})
    given = F.array(*[
        F.struct(F.lit(p).alias("param"), F.lit(t).alias("term"), F.lit(b).alias("beta"))
        for p, t, b in GIVEN_CENTILE_COEFFICIENTS
    ])
    coef = grid.select(*SEXES).distinct().select(*SEXES, F.lit(0).alias("boot"), F.inline(given))
    return reshape.linear_predictor(coef, design, [*SEXES, "term"], [*SEXES, "boot", "age", "param"])


def linear_predictor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_given_parameters(spark, sf).drop("boot"), "estimate")


def params_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = reshape.parameters_wide(_given_parameters(spark, sf), [*SEXES, "age"])
    return rounded(wide, "mu", "sigma", "nu")


def _replicate_parameters(spark: SparkSession, sf: str, reps: int = 20) -> DataFrame:
    """Given mu, sigma and nu by replicate on the observed grid; replicate 13 has nu zero."""
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    grid = rows.select(*SEXES, "age").distinct().withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    b = F.col("boot")
    return grid.withColumns(
        {
            "mu": F.lit(22.0) + F.lit(0.08) * F.col("age") + F.lit(0.01) * (b * 7 % 11),
            "sigma": F.lit(0.14) + F.lit(0.001) * (b * 3 % 7),
            "nu": F.when(b == 13, 0.0).otherwise(F.lit(-0.8) + F.lit(0.05) * (b * 5 % 9)),
        }
    )


def lms_centiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lms.lms_centiles(_replicate_parameters(spark, sf), [*SEXES, "age"]), "beta", "lci", "uci")


def centile_contrast(spark: SparkSession, sf: str) -> DataFrame:
    pairs = ((25, 75), (10, 90), (50, 90))
    return rounded(lms.centile_contrast(_replicate_parameters(spark, sf), [*SEXES, "age"], pairs), "beta", "lci", "uci")


def parameter_interval(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(lms.parameter_intervals(_replicate_parameters(spark, sf), [*SEXES, "age"]), "beta", "lci", "uci")


def centile_log_link(spark: SparkSession, sf: str) -> DataFrame:
    """Point centiles of a log-link model; a negative base has no value."""
    rows = _replicate_parameters(spark, sf, 0).withColumns({"mu": F.log("mu"), "sigma": F.lit(0.9), "nu": F.lit(0.6)})
    out = lms.expand_centiles(rows, (2, 5, 10, 50, 90, 95, 98), log_mu=True)
    return rounded(out.select(*SEXES, "age", "centile", "value"), "value")


def uncoded_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level means from reference-coded contrasts, per stratum."""
    rows = strata.expand_strata(clean_table(spark, sf)).where(F.col("edu").isNotNull())
    means = rows.groupBy("stratum", "edu").agg(F.avg("bmi").alias("m"))
    base = rows.where(F.col("edu") == "None").groupBy("stratum").agg(F.avg("bmi").alias("b"))
    joined = means.join(base, "stratum")
    contrast = F.when(F.col("edu") == "None", F.col("b")).otherwise(F.col("m") - F.col("b"))
    term = F.when(F.col("edu") == "None", "(Intercept)").otherwise(F.col("edu"))
    coef = joined.select("stratum", term.alias("term"), contrast.alias("beta"))
    return rounded(reshape.uncode_levels(coef, ["stratum"], "None"), "beta")


# Given coefficients of a distribution so wide that the cut at zero matters.
CUT_CENTILE_COEFFICIENTS = [
    ("mu", "(Intercept)", 25.0), ("mu", "ns1", 3.0), ("mu", "ns2", -0.4),
    ("sigma", "(Intercept)", -0.8), ("sigma", "ns1", 0.1), ("sigma", "ns2", 0.02),
    ("nu", "(Intercept)", -0.9), ("nu", "ns1", 0.05), ("nu", "ns2", 0.1),
]


def _score_pass(spark: SparkSession, sf: str, given) -> DataFrame:
    rows, terms = lms.with_spline(centiles.cohort_strata(clean_table(spark, sf), P), "age", 2, SEXES)
    rows = rows.withColumns({f"c{i}": F.lit(c[2]) for i, c in enumerate(given)})
    sums = lms.score_sums(lms.score_columns(rows, "bmi", terms), SEXES, "w", terms)
    names = [c for c in sums.columns if c not in (*SEXES, "n")]
    return sums.select(*SEXES, "n", *[F.round(n, 4).alias(n) for n in names])


def lms_score_pass(spark: SparkSession, sf: str) -> DataFrame:
    """One scoring pass of the centile model at given coefficients."""
    return _score_pass(spark, sf, GIVEN_CENTILE_COEFFICIENTS)


def lms_score_pass_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _score_pass(spark, sf, CUT_CENTILE_COEFFICIENTS)


# Resampling


def _boot_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    # Each row meets all replicates, so the rows are spread by number and not by size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.select("stratum", "row_id", "bmi", "wt_int").repartition(parts, "stratum", "row_id"), "boot-rows")


def bootstrap_counts(spark: SparkSession, sf: str) -> DataFrame:
    boot = resample.bootstrap(_boot_rows(spark, sf), ["stratum"], "row_id", 10, P.seed, "exact")
    return boot.select("stratum", "boot", "row_id", "k")


def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    boot = resample.bootstrap(_boot_rows(spark, sf), ["stratum"], "row_id", 50, P.seed, "exact")
    means = resample.replicate_weighted_mean(boot, ["stratum"], "bmi", "wt_int")
    return rounded(intervals.point_and_interval(means, ["stratum"], "value"), "beta", "lci", "uci")


def poisson_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    boot = resample.bootstrap(_boot_rows(spark, sf), ["stratum"], "row_id", 200, P.seed)
    means = resample.replicate_weighted_mean(boot, ["stratum"], "bmi", "wt_int")
    return rounded(intervals.point_and_interval(means, ["stratum"], "value"), "beta", "lci", "uci")


def replicate_interval(spark: SparkSession, sf: str) -> DataFrame:
    """Survey years as replicates of the mean measure by birth decade; the first year is the estimate."""
    rows = clean_table(spark, sf).withColumns({"cohort": band("birth", 10), "boot": F.col("year") - 1991})
    means = rows.where(F.col("cohort").isNotNull()).groupBy("cohort", "boot").agg(F.avg("bmi").alias("value"))
    return rounded(intervals.point_and_interval(means, ["cohort"], "value"), "beta", "lci", "uci")


def price_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact quantiles of all line prices by status, however large a status is."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_extendedprice")
    out = quantiles.exact_quantiles(items, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99])
    names = ("p1", "q1", "median", "q3", "p99")
    return out.select("l_returnflag", "l_linestatus", *[r6(F.col("quantiles")[i]).alias(n) for i, n in enumerate(names)])


def measure_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Figure percentages of the measure by stratum, over persons."""
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    out = quantiles.exact_quantiles(rows, SEXES, "bmi", [p / 100 for p in feeds.FIGURE_CENTILES])
    return out.select(*SEXES, *[r6(F.col("quantiles")[i]).alias(f"c{p}") for i, p in enumerate(feeds.FIGURE_CENTILES)])


def global_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = clean_table(spark, sf).where(F.col("bmi").isNotNull()).select("sex", "row_id", "bmi")
    return ranks.global_rank(rows, ["sex"], ["bmi", "row_id"]).select("sex", "row_id", "rank")


# Missingness regressions


def missing_by_year_ols(spark: SparkSession, sf: str) -> DataFrame:
    out = ols.factor_effects(impute.missingness_frame(clean_table(spark, sf), P), "miss_bmi", "year")
    return rounded(out, "estimate", "se", "conf_low", "conf_high")


def missing_two_factor_ols(spark: SparkSession, sf: str) -> DataFrame:
    out = ols.two_factor_effects(impute.missingness_frame(clean_table(spark, sf), P), "miss_bmi", "birth", "year")
    return rounded(out, "estimate", "se", "conf_low", "conf_high")


def missing_spline_ols(spark: SparkSession, sf: str) -> DataFrame:
    out = ols.spline_mean(impute.missingness_frame(clean_table(spark, sf), P), "miss_bmi", "age", 3)
    return rounded(out, "predicted", "se", "conf_low", "conf_high")


# Multilevel models


def spec_sample_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every specification with its persons, birth groups and normalised weight."""
    specs = mixed.spec_grid()
    cells = growth.specification_cells(clean_table(spark, sf), specs, P)
    sizes = cells.groupBy(*growth.SAMPLE).agg(
        F.sum("n_all").alias("n_all"), F.sum("n_used").alias("n_used"),
        F.countDistinct("birth").alias("n_birth"), r6(F.sum(F.col("w_all") * F.col("f"))).alias("sum_w"),
    )
    return mixed.spec_table(spark, specs).join(sizes, growth.SAMPLE)


def mixed_suffstats(spark: SparkSession, sf: str) -> DataFrame:
    cells = growth.specification_cells(clean_table(spark, sf), mixed.spec_grid(), P)
    out = mixed.sufficient_statistics(cells, growth.SAMPLE)
    return rounded(out, "n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw")


def binary_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = growth.specification_cells(clean_table(spark, sf), mixed.spec_grid(), P)
    return rounded(mixed.binary_cells(cells, growth.SAMPLE), "age_s", "n", "sw", "swo")


def lmm_fit(spark: SparkSession, sf: str) -> DataFrame:
    specs = mixed.spec_grid(outcomes=("bmi",))
    return growth.specification_results(clean_table(spark, sf), specs, P)["fits"].drop("groups")


def glmm_fit(spark: SparkSession, sf: str) -> DataFrame:
    specs = mixed.spec_grid(outcomes=("obese",))
    return growth.specification_results(clean_table(spark, sf), specs, P)["fits"].drop("groups")


def spec_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    out = growth.specification_results(clean_table(spark, sf), mixed.spec_grid(), P)["trajectories"]
    return feeds.trajectory_feed(out)


def spec_random_effects(spark: SparkSession, sf: str) -> DataFrame:
    return growth.specification_results(clean_table(spark, sf), mixed.spec_grid(), P)["random_effects"]


def spec_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed effects, deviations and correlations of every specification, long."""
    return growth.specification_results(clean_table(spark, sf), mixed.spec_grid(), P)["terms"]


def spec_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return growth.specification_results(clean_table(spark, sf), mixed.spec_grid(), P)["summaries"]


def spline_growth_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Growth model whose intercept and both spline terms vary by birth year."""
    return growth.spline_growth(clean_table(spark, sf), "bmi", params=P)["terms"]


def spline_growth_effects(spark: SparkSession, sf: str) -> DataFrame:
    return growth.spline_growth(clean_table(spark, sf), "bmi", params=P)["effects"]


def spline_growth_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    return growth.spline_growth(clean_table(spark, sf), "bmi", params=P)["trajectories"]


def spline_growth_obese(spark: SparkSession, sf: str) -> DataFrame:
    """The logistic model of the indicator with a varying intercept and first spline term."""
    return growth.spline_growth(clean_table(spark, sf), "obese", "1 + age_ns1", P)["terms"]


def _given_effects(birth: str = "birth") -> tuple[Column, Column]:
    """Given group effects: a short pattern over birth years."""
    return (F.pmod(birth, F.lit(7)) - 3) * F.lit(0.1), (F.pmod(birth, F.lit(5)) - 2) * F.lit(0.1)


def lmm_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories at given fixed and group effects; every fifth birth year has none."""
    frame = strata.rescale(impute.missingness_frame(clean_table(spark, sf), P), "age", "age_s")
    frame = strata.expand_strata(frame)
    ranges = frame.groupBy("stratum", "birth").agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    r0, r1 = _given_effects()
    long = F.array(
        F.struct(F.lit(mixed.INTERCEPT).alias("term"), r0.alias("ranef")),
        F.struct(F.lit(mixed.SLOPE).alias("term"), r1.alias("ranef")),
    )
    effects = ranges.where(F.pmod("birth", F.lit(5)) != 0).select("stratum", "birth", F.inline(long))
    given = F.array(
        F.struct(F.lit(mixed.INTERCEPT).alias("term"), F.lit(-0.9).alias("fixef")),
        F.struct(F.lit(mixed.SLOPE).alias("term"), F.lit(0.8).alias("fixef")),
    )
    fixed = ranges.select("stratum").distinct().select("stratum", F.inline(given))
    design = frame.select("stratum", "age", F.lit(1.0).alias(mixed.INTERCEPT), F.col("age_s").alias(mixed.SLOPE)).distinct()
    design = design.unpivot(["stratum", "age"], [mixed.INTERCEPT, mixed.SLOPE], "term", "value")
    out = mixed.group_trajectories(fixed, effects, ranges, design, ["stratum"], logit=True)
    return rounded(out, "estimate")


def random_effect_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of birth-year deviations with their standard error."""
    frame = impute.missingness_frame(clean_table(spark, sf), P).where(F.col("bmi").isNotNull())
    groups = strata.expand_strata(frame).groupBy("stratum", "birth").agg(
        (F.avg("bmi") - F.lit(27.0)).alias("ranef"), (F.lit(4.0) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se")
    )
    effects = groups.withColumn("term", F.explode(F.array(F.lit(mixed.INTERCEPT), F.lit(mixed.SLOPE))))
    return rounded(mixed.random_effect_intervals(effects, ["stratum"]), "ranef", "lci", "uci")


def observed_range(spark: SparkSession, sf: str) -> DataFrame:
    """The whole age window laid out per birth year, then cut to the ages it was seen at."""
    frame = strata.expand_strata(impute.missingness_frame(clean_table(spark, sf), P))
    ranges = frame.groupBy("stratum", "birth").agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))
    window = F.explode(F.sequence(F.lit(P.age_low), F.lit(P.age_high)))
    curves = ranges.select("stratum", "birth", window.alias("age"))
    return mixed.clip_to_range(curves, ranges, ["stratum"])


def nested_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Age counts nested per cohort and stratum, then unnested with the number of ages."""
    rows = strata.expand_strata(strata.cohort_sample(clean_table(spark, sf), P))
    nested = reshape.nest(profile.count_by(rows, [*SEXES, "age"]), SEXES, ["age", "n"])
    return reshape.unnest(nested.withColumn("ages", F.size("data")), [*SEXES, "ages"])


# Imputation


def imputation_frame(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(impute.imputation_frame(clean_table(spark, sf), P), "bmi", "age_s", "wt_int")


def _given_draws(frame: DataFrame, imps: int) -> DataFrame:
    """Posterior draws around a given fit, for the birth years of the frame."""
    fixed = frame.sparkSession.createDataFrame(
        [(27.0, 2.5, 0.01, -0.004, 0.02, 4.4)], "b0 double, b1 double, v00 double, v01 double, v11 double, sigma double"
    )
    r0, r1 = _given_effects()
    groups = frame.select("birth").distinct().select(
        "birth", r0.alias("re0"), r1.alias("re1"), F.lit(0.04).alias("v00"), F.lit(-0.01).alias("v01"), F.lit(0.05).alias("v11")
    )
    return impute.posterior_draws(fixed, groups, imps, P.ridge, P.seed)


def posterior_draws(spark: SparkSession, sf: str) -> DataFrame:
    frame = impute.imputation_frame(clean_table(spark, sf), P)
    return rounded(_given_draws(frame, P.imputations), "a0", "a1")


def _given_predictions(spark: SparkSession, sf: str, imps: int) -> tuple[DataFrame, DataFrame]:
    frame = stage(impute.imputation_frame(clean_table(spark, sf), P), "imputation-frame")
    return frame, impute.noisy_predictions(frame, _given_draws(frame, imps), imps, P.seed)


def noisy_predictions(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _given_predictions(spark, sf, P.imputations)
    return rounded(rows.select("imp", "row_id", "yhat"), "yhat")


def pooled_means(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _given_predictions(spark, sf, P.imputations)
    cells = rows.groupBy("imp", "birth", "age").agg(F.avg("yhat").alias("pred"))
    return rounded(intervals.replicate_means(cells, ["birth", "age"], ["pred"]), "pred")


def pmm_impute(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = _given_predictions(spark, sf, P.imputations)
    return rounded(impute.pmm(rows, ["imp"], "yhat", "bmi", "row_id", P.donors, P.seed), "imputed")


def delta_suffstats(spark: SparkSession, sf: str) -> DataFrame:
    frame, rows = _given_predictions(spark, sf, P.imputations)
    values = stage(impute.pmm(rows, ["imp"], "yhat", "bmi", "row_id", P.donors, P.seed), "imputed")
    filled = frame.where(~F.col("obs")).drop("bmi").join(values, "row_id")
    imputed = stage(impute.frame_statistics(filled, "imputed", by=["imp"]), "imputed-sums")
    out = impute.delta_statistics(impute.frame_statistics(frame), imputed, range(-5, 6))
    return rounded(out, "n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw")


def pattern_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return impute.impute_and_shift(clean_table(spark, sf), P)[1]


def pattern_figures(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.pattern_effects_feed(pattern_mixture(spark, sf))


# Centile fits


def lms_fit(spark: SparkSession, sf: str) -> DataFrame:
    return centiles.cohort_centiles(clean_table(spark, sf), P.bootstrap_reps, P)[0]


def lms_fit_certificate(spark: SparkSession, sf: str) -> DataFrame:
    """Both spline analyses' point fits in strata of 100 rows or more: settled, concave and without a slope left."""
    clean = clean_table(spark, sf)
    parts = [
        centiles.fit_certificate(centiles.cohort_strata(clean, P), "age", 2).withColumn("over", F.lit("age")),
        centiles.fit_certificate(centiles.age_band_strata(clean, P), "year", 3).withColumn("over", F.lit("year")),
    ]
    return parts[0].unionByName(parts[1]).withColumn("slope", F.round("slope", 1))


def lms_fit_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter curves of the cohort fits with bootstrap intervals."""
    _, params = centiles.cohort_centiles(clean_table(spark, sf), P.bootstrap_reps, P)
    return feeds.parameter_feed(lms.parameter_intervals(params, [*SEXES, "age"]))


def lms_fit_contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between centiles of the cohort fits with bootstrap intervals."""
    _, params = centiles.cohort_centiles(clean_table(spark, sf), P.bootstrap_reps, P)
    return lms.centile_contrast(params, [*SEXES, "age"])


def lms_fit_centiles(spark: SparkSession, sf: str) -> DataFrame:
    _, params = centiles.cohort_centiles(clean_table(spark, sf), P.bootstrap_reps, P)
    return feeds.centile_feed(lms.lms_centiles(params, [*SEXES, "age"]), "age", 10, range(1, 100))


def lms_age_band_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Age-band centiles over survey year with bootstrap intervals."""
    _, params = centiles.age_band_centiles(clean_table(spark, sf), P.bootstrap_reps, P)
    return lms.lms_centiles(params, [*SEXES, "year"])


def lms_birth_band_fit(spark: SparkSession, sf: str) -> DataFrame:
    return centiles.birth_band_centiles(clean_table(spark, sf), P)


# Figure tables


def figure_feed(spark: SparkSession, sf: str) -> DataFrame:
    curves = lms.lms_centiles(_replicate_parameters(spark, sf), [*SEXES, "age"], feeds.FIGURE_CENTILES)
    return rounded(feeds.centile_feed(curves, "age", 10), "beta", "lci", "uci")


def age_figure_feed(spark: SparkSession, sf: str) -> DataFrame:
    curves = lms.lms_centiles(_replicate_parameters(spark, sf), [*SEXES, "age"])
    return rounded(feeds.age_feed(curves), "beta", "lci", "uci")


def parameter_figure_feed(spark: SparkSession, sf: str) -> DataFrame:
    out = lms.parameter_intervals(_replicate_parameters(spark, sf), [*SEXES, "age"])
    return rounded(feeds.parameter_feed(out), "beta", "lci", "uci")


def category_lines(spark: SparkSession, sf: str) -> DataFrame:
    curves = lms.lms_centiles(_replicate_parameters(spark, sf), [*SEXES, "age"], feeds.FIGURE_CENTILES)
    return feeds.category_lines(feeds.centile_feed(curves, "age", 10), "centile")


QUERIES = [
    harmonised_rows, harmonised_by_year, wave_files_by_year, wave_union, pruned_scan, catalogue, dictionary, file_ranks, band_age_draw,
    uniform_draws, cohort_counts, followup_kept, stratum_sizes, normalised_weights, weights_null_policy,
    weighted_mean_by_stratum, obesity_prevalence, birth_age_bands, rescaled_age, right_join_age_grid,
    completeness_profile, observed_share, count_summary, weighted_variance, education_shares, scalar_functions,
    spline_basis, spline_basis_year, poly_basis, poly_basis_by_cohort, linear_predictor, params_wide, lms_centiles, centile_contrast,
    parameter_interval, centile_log_link, uncoded_levels, lms_score_pass, lms_score_pass_cut, bootstrap_counts, bootstrap_mean_ci,
    poisson_mean_ci, replicate_interval, price_quantiles, measure_quantiles, global_ranks, missing_by_year_ols, missing_two_factor_ols,
    missing_spline_ols, spec_sample_sizes, mixed_suffstats, binary_cells, lmm_fit, glmm_fit, spec_trajectories,
    spec_random_effects, spec_terms, spec_summaries, spline_growth_terms, spline_growth_effects, spline_growth_trajectories,
    spline_growth_obese, lmm_trajectories, random_effect_ci, observed_range, nested_counts, imputation_frame,
    posterior_draws, noisy_predictions, pooled_means, pmm_impute, delta_suffstats, pattern_mixture, pattern_figures,
    lms_fit, lms_fit_certificate, lms_fit_parameters, lms_fit_contrasts, lms_fit_centiles, lms_age_band_fit,
    lms_birth_band_fit, figure_feed, age_figure_feed, parameter_figure_feed, category_lines,
]
