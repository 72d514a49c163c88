import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from birthwave.operators import impute, mixed, ranks, resample
from birthwave.params import Params
from birthwave.plans.survey import clean_table


def brute(pdf, donors=5):
    """Candidate donor values of each recipient by full search."""
    out = {}
    for imp, g in pdf.groupby("imp"):
        d = g[g.y.notna()]
        for _, r in g[g.y.isna()].iterrows():
            gap = (d.yhat - r.yhat).abs().sort_values(kind="stable")
            out[imp, r.row_id] = (gap.iloc[min(donors, len(gap)) - 1], dict(zip(d.y, (d.yhat - r.yhat).abs())))
    return out


def check(spark, pdf):
    got = impute.pmm(spark.createDataFrame(pdf), ["imp"], "yhat", "y", "row_id").toPandas()
    want = brute(pdf)
    assert len(got) == len(want)
    for r in got.itertuples():
        limit, gaps = want[r.imp, r.row_id]
        assert gaps[r.imputed] <= limit + 1e-12


def test_matching_equals_full_search(spark):
    rng = np.random.default_rng(1)
    n = 300
    pdf = pd.DataFrame({"imp": np.repeat([1, 2], n), "row_id": np.tile(np.arange(n), 2), "yhat": rng.normal(size=2 * n)})
    pdf["y"] = np.where(pdf.row_id % 3 == 0, np.nan, rng.normal(size=2 * n))
    pdf["y"] = pdf["y"].astype(object).where(pdf["y"].notna(), None).astype(float)
    check(spark, pdf.assign(y=pdf.y))


def test_matching_with_tied_predictions_and_few_donors(spark):
    tied = pd.DataFrame({"imp": 1, "row_id": range(60), "yhat": [1.0] * 30 + [float(i) for i in range(30)]})
    tied["y"] = [float(i) if i % 4 else None for i in range(60)]
    check(spark, tied)
    few = pd.DataFrame({"imp": 1, "row_id": range(6), "yhat": [0.0, 1, 2, 3, 4, 5], "y": [7.0, None, None, 8.0, None, None]})
    check(spark, few)


def test_imputed_values_are_observed_and_zero_shift_is_the_plain_fit(spark, sf_dir):
    clean = clean_table(spark, sf_dir)
    params = Params(imputations=2)
    values, pattern = impute.impute_and_shift(clean, params, deltas=(0, 2))
    frame = impute.imputation_frame(clean, params)
    observed = {r[0] for r in frame.where("obs").select("bmi").collect()}
    got = values.toPandas()
    assert set(got.imputed) <= observed
    assert len(got) == 2 * frame.where("not obs").count()
    filled = frame.join(values, "row_id", "left").where("not obs").select("imp", "birth", "age_s", "wt_int", F.col("imputed").alias("bmi"))
    both = frame.where("obs").withColumn("imp", F.explode(F.array(F.lit(1), F.lit(2)))).select(*filled.columns).unionByName(filled)
    plain = mixed.fit_lmm(impute.frame_statistics(both, by=["imp"]), ["imp"]).select(F.inline("groups"))
    plain = plain.groupBy("birth").agg(F.avg("re0").alias("re")).toPandas().set_index("birth")["re"]
    zero = pattern.where("diff = 0").select("birth", "re_1").distinct().toPandas().set_index("birth")["re_1"]
    assert np.allclose(plain.sort_index(), zero.sort_index(), atol=1e-5)
    means = pattern.groupBy("diff").agg(F.avg("pred")).toPandas().set_index("diff")["avg(pred)"]
    assert means[2] > means[0]


def test_global_rank_with_a_hot_group_and_ties(spark):
    pdf = pd.DataFrame({"g": ["hot"] * 900 + [f"k{i % 5}" for i in range(100)], "v": [1.0] * 600 + list(np.arange(400) % 7.0), "row_id": np.arange(1000)})
    want = pdf.sort_values(["g", "v", "row_id"]).assign(rank=lambda d: d.groupby("g").cumcount() + 1).set_index("row_id")["rank"]
    for parts in (1, 16):
        got = ranks.global_rank(spark.createDataFrame(pdf).repartition(parts), ["g"], ["v", "row_id"]).toPandas()
        assert (got.set_index("row_id")["rank"].sort_index() == want.sort_index()).all()


def test_bootstraps_agree_in_mean_and_spread(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": "a", "row_id": np.arange(400), "y": rng.normal(10, 3, 400), "w": 1.0})
    rows = spark.createDataFrame(pdf)
    out = {}
    for method in ("exact", "poisson"):
        boot = resample.bootstrap(rows, ["s"], "row_id", 300, 7, method)
        means = resample.replicate_weighted_mean(boot, ["s"], "y", "w").where("boot > 0").toPandas()["value"]
        out[method] = (means.mean(), means.std())
        if method == "exact":
            sizes = boot.groupBy("boot").agg(F.sum("k").alias("n")).toPandas()["n"]
            assert (sizes == 400).all()
    se = pdf.y.std() / 20
    for mean, sd in out.values():
        assert abs(mean - pdf.y.mean()) < 4 * se / np.sqrt(300) + 1e-9
        assert abs(sd / se - 1) < 0.15


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(500).selectExpr("id as row_id", "'a' as s")
    one, many = (
        sorted(map(tuple, resample.poisson_bootstrap(rows.repartition(n), ["s"], "row_id", 5).collect())) for n in (1, 9)
    )
    assert one == many


def test_exact_bootstrap_keeps_the_size(spark):
    """Each replicate has its stratum's size, strata of one row included, under any partitioning, and multinomial moments."""
    rows = spark.range(161).selectExpr("id as row_id", "if(id = 160, 'one', if(id < 3, 'few', 'many')) as s", "id as y")
    boots = [resample.exact_bootstrap(rows.repartition(n), ["s"], "row_id", 400, 5).toPandas() for n in (1, 7)]
    assert sorted(boots[0].itertuples(index=False)) == sorted(boots[1].itertuples(index=False))
    boot = boots[0]
    assert boot.k.min() == 1 and not boot.duplicated(["s", "row_id", "boot"]).any()
    sums = boot.groupby(["s", "boot"]).k.sum().unstack()
    assert sums.shape == (3, 401) and all((sums.loc[s] == n).all() for s, n in (("one", 1), ("few", 3), ("many", 157)))
    few = boot[(boot.s == "few") & (boot.boot > 0)].pivot(index="boot", columns="row_id", values="k").fillna(0)
    # All three draws on one row: 1/27 for each row; mean 1, variance 2/3, covariance -1/3.
    assert abs((few == 3).mean().mean() - 1 / 27) < 0.02 and abs(few.mean() - 1).max() < 0.15
    assert abs(few.cov().to_numpy() - (np.eye(3) - 1 / 3)).max() < 0.12
    many = boot[(boot.s == "many") & (boot.boot > 0)].pivot(index="boot", columns="row_id", values="k").fillna(0)
    assert abs(many.var().mean() - (1 - 1 / 157)) < 0.03
