"""Multiple imputation with predictive mean matching, and pattern-mixture sensitivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..params import Params
from .intervals import replicate_means
from .mixed import fit_lmm
from .ranks import range_ordered
from .staging import join_summary, stage
from .strata import follow_up, in_window, rescale


def missingness_frame(clean: DataFrame, params: Params = Params()) -> DataFrame:
    """Persons in the age window with enough follow-up by birth year, flagged by observation."""
    rows = in_window(clean, "age", params.age_low, params.age_high)
    rows = follow_up(rows, ["birth"], "age", params.youngest_end, params.oldest_start)
    return rows.withColumn("miss_bmi", F.col("bmi").isNull().cast("int"))


def imputation_frame(clean: DataFrame, params: Params = Params()) -> DataFrame:
    rows = rescale(missingness_frame(clean, params), "age", "age_s")
    return rows.select("row_id", "bmi", "age_s", "age", "birth", "wt_int", F.col("bmi").isNotNull().alias("obs"))


def frame_statistics(frame: DataFrame, y: str = "bmi", w: str = "wt_int", by=()) -> DataFrame:
    """Sums per birth year that determine the fit, for rows with an outcome and a weight."""
    x, v, wt = F.col("age_s"), F.col(y), F.col(w)
    rows = frame.where(v.isNotNull() & wt.isNotNull())
    return rows.groupBy(*by, "birth").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(wt).alias("sw"), F.sum(wt * x).alias("swx"),
        F.sum(wt * x * x).alias("swxx"), F.sum(wt * v).alias("swy"), F.sum(wt * v * x).alias("swxy"),
        F.sum(wt * v * v).alias("swyy"), F.sum(F.log(wt)).alias("slw"),
    )


def _correlated(v00, v01, v11, z0, z1):
    """Two normal deviates with the given covariance, from two independent ones."""
    l00 = F.sqrt(F.greatest(v00, F.lit(0.0)))
    l10 = F.coalesce(v01 / F.nullif(l00, F.lit(0.0)), F.lit(0.0))
    l11 = F.sqrt(F.greatest(v11 - l10 * l10, F.lit(0.0)))
    return l00 * z0, l10 * z0 + l11 * z1


def posterior_draws(fixed: DataFrame, groups: DataFrame, imps: int, ridge: float = 1e-6, seed: int = 1) -> DataFrame:
    """Intercept and slope per imputation and group, drawn around the fit.

    ``fixed`` has one row (b0, b1, v00, v01, v11, sigma); ``groups`` has birth,
    re0, re1, v00, v01, v11. Fixed effects share one draw per imputation.
    """
    imp = F.explode(F.sequence(F.lit(1), F.lit(imps)))
    one = fixed.select(F.struct("*").alias("f")).scalar()
    rows = groups.withColumn("f", one).withColumn("imp", imp)
    key = F.lit(seed)
    f0, f1 = _correlated(
        F.col("f.v00"), F.col("f.v01"), F.col("f.v11"), draws.normal("fixed0", key, "imp"), draws.normal("fixed1", key, "imp")
    )
    g0, g1 = _correlated(
        F.col("v00") + ridge, F.col("v01"), F.col("v11") + ridge,
        draws.normal("group0", key, "imp", "birth"), draws.normal("group1", key, "imp", "birth"),
    )
    return rows.select(
        "imp", "birth", (F.col("f.b0") + f0 + F.col("re0") + g0).alias("a0"),
        (F.col("f.b1") + f1 + F.col("re1") + g1).alias("a1"), F.col("f.sigma").alias("sigma"),
    )


def noisy_predictions(frame: DataFrame, drawn: DataFrame, imps: int, seed: int = 1) -> DataFrame:
    """Prediction with residual noise for every row and imputation, observed rows included.

    Rows of a birth group without a fitted effect keep their place with a null prediction.
    """
    rows = frame.withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(imps))))
    rows = join_summary(rows, drawn, ["imp", "birth"], "left")
    noise = F.col("sigma") * draws.normal("residual", F.lit(seed), "imp", "row_id")
    return rows.withColumn("yhat", F.col("a0") + F.col("a1") * F.col("age_s") + noise).drop("a0", "a1", "sigma")


def pmm(df: DataFrame, by: list[str], yhat: str, y: str, row_id: str, donors: int = 5, seed: int = 1) -> DataFrame:
    """Observed value given to each row without y: one of its nearest donors by prediction.

    Donors and recipients share one global order. A recipient at donor position
    r can only have its nearest donors at positions r - donors + 1 to r +
    donors, so it meets those few by equi-join and never the whole group. At
    equal distance a donor at or below comes first, then the closer position.
    A recipient without a prediction or without any donor gets null.
    """
    miss = F.col(y).isNull().cast("int")
    slim = df.select(*by, F.col(yhat).alias("_p"), miss.alias("_miss"), (1 - miss).alias("_donor"), row_id, y)
    lost = slim.where("_miss = 1").select(*by, row_id)
    ordered = range_ordered(slim.where("_p is not null"), by, ["_p", "_miss", row_id], "pmm", counted="_donor")
    # Donors are counted while the sorted parts are written; a group starts in a part after ``_first`` donors of others.
    per_part = ordered.groupBy(*by, "_part").agg(F.sum("_donor").alias("_d"), F.min(F.col("_run") - F.col("_donor")).alias("_first"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(*by, "_part", (F.coalesce(F.sum("_d").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    rows = join_summary(ordered, offsets, [*by, "_part"], "inner")
    rows = rows.withColumn("_r", F.col("_run") + F.col("_shift"))
    pool = rows.where("_miss = 0").select(*by, F.col("_r").alias("_at"), F.col("_p").alias("_q"), F.col(y).alias("_y"))
    wanted = rows.where("_miss = 1").select(*by, row_id, "_p", "_r").withColumn(
        "_at", F.explode(F.sequence(F.col("_r") - (donors - 1), F.col("_r") + donors))
    )
    met = wanted.join(pool, [*by, "_at"])
    above = (F.col("_at") > F.col("_r")).cast("int")
    order = F.struct(
        F.abs(F.col("_q") - F.col("_p")).alias("d"), above.alias("s"),
        F.abs(F.col("_at") - F.col("_r")).alias("k"), F.col("_y").alias("y"),
    )
    near = met.groupBy(*by, row_id).agg(F.slice(F.sort_array(F.collect_list(order)), 1, donors).alias("_near"))
    pick = F.floor(draws.uniform("donor", F.lit(seed), *by, row_id) * F.size("_near"))
    found = near.select(*by, row_id, F.get("_near", pick.cast("int"))["y"].alias("imputed"))
    return lost.join(found, [*by, row_id], "left")


def delta_statistics(observed: DataFrame, imputed: DataFrame, deltas, imputations: int | None = None) -> DataFrame:
    """Sums per (delta, imputation, birth) after shifting imputed values by delta.

    ``observed`` holds sums per birth, ``imputed`` per (imp, birth); shifting
    changes the sums by algebra, so rows are not copied per delta. With
    ``imputations`` the numbers 1 to it are in the result even if nothing was imputed.
    """
    names = ["n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw"]
    if imputations is None:
        numbers = imputed.select("imp").distinct().agg(F.collect_list("imp").alias("imps")).scalar()
    else:
        numbers = F.sequence(F.lit(1), F.lit(imputations))
    base = observed.withColumn("imp", F.explode(numbers))
    both = base.join(imputed.select("imp", "birth", *[F.col(n).alias(f"i_{n}") for n in names]), ["imp", "birth"], "full")
    both = both.fillna(0.0).withColumn("diff", F.explode(F.array(*[F.lit(float(d)) for d in deltas])))
    d = F.col("diff")
    total = {n: F.col(n) + F.col(f"i_{n}") for n in names}
    total["swy"] = total["swy"] + d * F.col("i_sw")
    total["swxy"] = total["swxy"] + d * F.col("i_swx")
    total["swyy"] = total["swyy"] + 2 * d * F.col("i_swy") + d * d * F.col("i_sw")
    return both.select("diff", "imp", "birth", *[c.alias(n) for n, c in total.items()])


def pattern_mixture(stats: DataFrame, grid: DataFrame) -> DataFrame:
    """Pooled predictions and group effects per delta, birth and age.

    ``grid`` lists the observed (birth, age, age_s). All deltas and imputations
    are fitted in one grouped pass over their sums.
    """
    fits = stage(fit_lmm(stats, ["diff", "imp"]), "pattern-fits")
    effects = fits.select(
        "diff", "imp", F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"), F.inline("groups")
    )
    rows = effects.join(grid, "birth")
    pred = F.col("b0") + F.col("re0") + (F.col("b1") + F.col("re1")) * F.col("age_s")
    rows = rows.select("diff", "imp", "birth", "age", pred.alias("pred"), F.col("re0").alias("re_1"), F.col("re1").alias("re_2"))
    return replicate_means(rows, ["diff", "birth", "age"], ["pred", "re_1", "re_2"])


def impute_and_shift(
    clean: DataFrame, params: Params = Params(), deltas=range(-5, 6)
) -> tuple[DataFrame, DataFrame]:
    """Whole analysis: fit, impute ``params.imputations`` times, shift, refit and pool.

    Returns the imputed values and the pooled pattern-mixture table.
    """
    frame = stage(imputation_frame(clean, params), "imputation-frame")
    observed = stage(frame_statistics(frame), "observed-sums")
    fit = stage(fit_lmm(observed.withColumn("fit", F.lit(0)), ["fit"]), "base-fit")
    fixed = fit.select(
        F.col("beta")[0].alias("b0"), F.col("beta")[1].alias("b1"),
        F.col("vcov")[0].alias("v00"), F.col("vcov")[1].alias("v01"), F.col("vcov")[2].alias("v11"), "sigma",
    )
    drawn = posterior_draws(fixed, fit.select(F.inline("groups")), params.imputations, params.ridge, params.seed)
    predicted = noisy_predictions(frame, drawn, params.imputations, params.seed)
    values = stage(pmm(predicted, ["imp"], "yhat", "bmi", "row_id", params.donors, params.seed), "imputed")
    filled = frame.where(~F.col("obs")).drop("bmi").join(values, "row_id").where("imputed is not null")
    imputed = stage(frame_statistics(filled, "imputed", by=["imp"]), "imputed-sums")
    grid = frame.select("birth", "age", "age_s").distinct()
    return values, pattern_mixture(delta_statistics(observed, imputed, deltas, params.imputations), grid)
