"""One test per null or numeric trap of the survey's arithmetic."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from birthwave.functions.scalar import band, lms_value, sum_or_null, t_quantile
from birthwave.operators import intervals, ols, strata, weights
from birthwave.operators.harmonise import band_bounds
from birthwave.operators.mixed import binary_cells
from birthwave.sources.waves import pick_columns, union_waves


def test_sum_is_null_if_one_input_is(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0)], "g int, x double")
    got = dict(df.groupBy("g").agg(sum_or_null("x")).collect())
    assert got == {1: None, 2: 2.0}


def test_one_null_weight_voids_its_year_or_is_skipped(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (2, 2.0), (2, 6.0)], "year int, w double")
    got = [r["n"] for r in weights.normalise_weights(df, ["year"], "w", "n").orderBy("year", "w").collect()]
    assert got == [None, None, 0.5, 1.5]
    skip = [r["n"] for r in weights.normalise_weights(df, ["year"], "w", "n", "skip").orderBy("year", "w").collect()]
    assert skip == [None, 1.0, 0.5, 1.5]
    with pytest.raises(ValueError):
        weights.normalise_weights(df, ["year"], "w", "n", "other")


def test_a_negative_base_has_no_centile_and_leaves_the_interval(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, float("nan")), (3, 4.0)], "boot int, v double").withColumn("g", F.lit(1))
    row = intervals.point_and_interval(df, ["g"], "v").first()
    assert row["beta"] == 1.0 and row["lci"] == pytest.approx(2.05) and row["uci"] == pytest.approx(3.95)
    assert (row["n_used"], row["n_failed"]) == (2, 1)
    one = spark.range(1).select(lms_value(F.lit(25.0), F.lit(0.9), F.lit(0.6), F.lit(-2.3))).first()
    assert one[0] is None


def test_nu_zero_takes_the_limit(spark):
    row = spark.range(1).select(
        lms_value(F.lit(25.0), F.lit(0.1), F.lit(0.0), F.lit(1.0)), lms_value(F.lit(25.0), F.lit(0.1), F.lit(1e-6), F.lit(1.0))
    ).first()
    assert row[0] == pytest.approx(25 * np.exp(0.1)) and row[1] == pytest.approx(row[0], rel=1e-6)


def test_open_ended_or_unknown_bands_have_no_age(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "code int")
    low, high = band_bounds(F.col("code"), {1: "20-24", 2: "90+"})
    assert [tuple(r) for r in df.select(low, high).collect()] == [(20, 24), (None, None), (None, None), (None, None)]


def test_waves_of_different_types_and_columns_unite(spark):
    a = spark.createDataFrame([(1, 2)], "row_id bigint, age int")
    b = spark.createDataFrame([(2, 3.5)], "row_id bigint, bmi double")
    assert [tuple(r) for r in union_waves([a, b]).orderBy("row_id").collect()] == [(1, 2, None), (2, None, 3.5)]


def test_filters_drop_null_conditions(spark):
    df = spark.createDataFrame([(19,), (20,), (None,)], "age int")
    assert strata.in_window(df, "age", 20, 64).count() == 1


def test_no_replicates_give_no_interval(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "g int, boot int, v double")
    assert tuple(intervals.point_and_interval(df, ["g"], "v").first()) == (1, 5.0, None, None, 0, 0)


def test_fractional_weights_enter_the_logistic_cells(spark):
    cells = spark.createDataFrame([(1, 1990, 0.5, 2, 0.75, 0.25, 1.0)], "s int, birth int, age_s double, n_used int, sw double, swo double, f double")
    assert tuple(binary_cells(cells, ["s"]).first())[3:] == (2.0, 0.75, 0.25)


def test_names_that_differ_only_in_case_are_refused():
    assert pick_columns(["Age", "x", "Origin2"], ["age"], "origin") == {"age": "Age", "origin2": "Origin2"}
    with pytest.raises(ValueError):
        pick_columns(["Age", "age"], ["age"], None)


def test_bands_use_floor_modulo(spark):
    df = spark.createDataFrame([(-3,), (1989,)], "x int")
    assert [r[0] for r in df.select(band("x", 10)).collect()] == [-10, 1980]


def test_student_quantile(spark):
    got = spark.createDataFrame([(30,), (1000,)], "d int").select(t_quantile("d")).collect()
    assert got[0][0] == pytest.approx(2.042272, abs=1e-4) and got[1][0] == pytest.approx(1.962339, abs=1e-5)


def test_regressions_match_least_squares(spark):
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"a": rng.integers(0, 5, 500), "b": rng.integers(0, 4, 500), "age": rng.integers(20, 65, 500)})
    d["y"] = (rng.uniform(size=500) < 0.2 + 0.05 * d.a).astype(int)
    df = spark.createDataFrame(d)

    def dense(x):
        beta, *_ = np.linalg.lstsq(x, d.y, rcond=None)
        s2 = ((d.y - x @ beta) ** 2).sum() / (len(d) - x.shape[1])
        return beta, np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))

    def dummies(c):
        return (d[c].to_numpy()[:, None] == np.unique(d[c])[None, 1:]).astype(float)

    one = np.ones((500, 1))
    got = ols.factor_effects(df, "y", "a").orderBy("level").toPandas()
    beta, se = dense(np.hstack([one, dummies("a")]))
    assert np.allclose(got.estimate, beta[1:]) and np.allclose(got.se, se[1:])
    got = ols.two_factor_effects(df, "y", "a", "b").orderBy("factor", "level").toPandas()
    beta, se = dense(np.hstack([one, dummies("a"), dummies("b")]))
    assert np.allclose(got.estimate, beta[1:]) and np.allclose(got.se, se[1:])
    got = ols.spline_mean(df, "y", "age").toPandas()
    assert len(got) == d.age.nunique() and (got.conf_low < got.predicted).all()
    means = d.groupby("age").y.agg(["mean", "size"])
    fitted = got.set_index("age").predicted.sort_index()
    assert abs((means["size"] * (means["mean"] - fitted.to_numpy())).sum()) < 1e-8
