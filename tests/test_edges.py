"""Edge cases of the survey operators: nothing drawn, nothing weighed, nothing missing, nothing fitted."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from birthwave.operators import impute, ols, resample, weights
from birthwave.sources import stata, waves


def test_no_replicates_leave_the_sample(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "g string, row_id int")
    for method in ("poisson", "exact"):
        got = resample.bootstrap(df, ["g"], "row_id", 0, method=method).collect()
        assert sorted((r["row_id"], r["boot"], r["k"]) for r in got) == [(1, 0, 1), (2, 0, 1)]


def test_weights_that_sum_to_zero_have_no_mean_and_no_factor(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 0.0, 6.0)], "year int, w double, y double")
    assert [r["n"] for r in weights.normalise_weights(df, ["year"], "w", "n").collect()] == [None, None]
    boot = df.withColumns({"boot": F.lit(0), "k": F.lit(1)})
    assert resample.replicate_weighted_mean(boot, ["year"], "y", "w").first()["value"] is None
    assert weights.weighted_variance(df, "y", "w", ["year"]).first()["variance"] is None


def test_no_degrees_of_freedom_give_no_interval(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, y double")
    row = ols.factor_effects(df, "y", "g").first()
    assert (row["estimate"], row["se"], row["conf_low"]) == (1.0, None, None)


def test_a_group_without_an_effect_keeps_its_rows(spark):
    frame = spark.createDataFrame([(1, 1950, 0.5, None), (2, 1960, 0.5, 25.0)], "row_id int, birth int, age_s double, bmi double")
    drawn = spark.createDataFrame([(1, 1960, 24.0, 1.0, 2.0)], "imp int, birth int, a0 double, a1 double, sigma double")
    rows = impute.noisy_predictions(frame, drawn, 1)
    got = {r["row_id"]: r["yhat"] for r in rows.collect()}
    assert got[1] is None and got[2] is not None
    assert [tuple(r) for r in impute.pmm(rows, ["imp"], "yhat", "bmi", "row_id").select("row_id", "imputed").collect()] == [(1, None)]


def test_nothing_missing_still_has_every_imputation(spark):
    names = ["n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw"]
    observed = spark.createDataFrame([(1950, *[1.0] * 8)], "birth int, " + ", ".join(f"{n} double" for n in names))
    none = spark.createDataFrame([], "imp int, birth int, " + ", ".join(f"{n} double" for n in names))
    got = impute.delta_statistics(observed, none, [0, 1], imputations=3).collect()
    assert sorted((r["diff"], r["imp"], r["swy"]) for r in got) == [(d, i, 1.0) for d in (0.0, 1.0) for i in (1, 2, 3)]


def test_stata_names_of_any_case(spark, tmp_path):
    pd.DataFrame({"Sex": [1, 2], "BMI": [20.0, 21.0]}).to_stata(tmp_path / "a.dta", write_index=False)
    pd.DataFrame({"sex": [1], "Sex": [2]}).to_stata(tmp_path / "b.dta", write_index=False)
    schema = T.StructType.fromDDL("sex int, bmi double")
    assert sorted(map(tuple, stata.read_stata(spark, f"{tmp_path}/a.dta", schema).collect())) == [(1, 20.0), (2, 21.0)]
    with pytest.raises(Exception, match="differ in case only"):
        stata.read_stata(spark, f"{tmp_path}/b.dta", schema).collect()


def test_more_files_than_row_ids_allow_is_an_error(spark, tmp_path, monkeypatch):
    spark.range(4).selectExpr("cast(id AS int) AS sex", "1.0D AS bmi").repartition(2).write.parquet(f"{tmp_path}/w")
    assert waves.scan_wave(spark, f"{tmp_path}/w", "2006").select("row_id").distinct().count() == 4
    monkeypatch.setattr(waves, "_MAX_FILES", 2)
    with pytest.raises(Exception, match="more files than row ids allow"):
        waves.scan_wave(spark, f"{tmp_path}/w", "2006").collect()
