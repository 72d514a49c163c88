"""Mixed models with any random part: dense likelihoods, long summaries, defined cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from birthwave.operators import mixed
from birthwave.operators.solvers import minimise, reml_fit
from birthwave.plans import growth
from birthwave.plans.survey import clean_table
from test_mixed import sums

TERMS = ["(Intercept)", "x1", "x2"]


def simulate(groups=25, per=30, seed=7):
    rng = np.random.default_rng(seed)
    g = np.repeat(np.arange(groups), per)
    x = np.column_stack([np.ones(len(g)), rng.uniform(0, 1, len(g)), rng.normal(0, 1, len(g))])
    half = np.array([[1.0, 0, 0], [0.4, 0.7, 0], [-0.2, 0.3, 0.5]])
    u = rng.normal(size=(groups, 3)) @ half.T
    mean = x @ [25.0, 3.0, -1.0] + (x * u[g]).sum(1)
    w = rng.choice([0.5, 1.0, 2.0], len(g))
    y = mean + 1.5 * rng.normal(size=len(g)) / np.sqrt(w)
    hit = (rng.uniform(size=len(g)) < 1 / (1 + np.exp(-(mean - 26.5)))).astype(int)
    return pd.DataFrame({"g": g, "x1": x[:, 1], "x2": x[:, 2], "w": w, "y": y, "hit": hit}), x


def dense_reml(d, x, cov, sigma, places):
    z = x[:, places]
    same = d.g.to_numpy()[:, None] == d.g.to_numpy()[None, :]
    v = np.where(same, z @ cov @ z.T, 0.0) + np.diag(sigma**2 / d.w)
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ d.y)
    r = d.y - x @ beta
    loglik = -(np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ vi @ r + (len(d) - x.shape[1]) * np.log(2 * np.pi)) / 2
    one = (d.g == 0).to_numpy()
    return loglik, beta, np.linalg.inv(xvx), cov @ z[one].T @ (vi @ r)[one]


@pytest.mark.parametrize("random,places", [("1 + x1 + x2", [0, 1, 2]), ("-1 + x2", [2]), ("1 + x2", [0, 2])])
def test_linear_fit_is_the_dense_maximum(spark, random, places):
    d, x = simulate()
    fit = mixed.fit_linear(spark.createDataFrame(d).repartition(3), [], "g", "y", "w", "1 + x1 + x2", random).first()
    k = len(places)
    cov = np.array(fit["cov"]).reshape(k, k)
    loglik, beta, vcov, effect = dense_reml(d, x, cov, fit["sigma"], places)
    assert fit["converged"] and fit["random"] == [TERMS[i] for i in places]
    assert abs(loglik - fit["loglik"]) < 1e-6 and np.allclose(beta, fit["beta"], atol=1e-7)
    assert np.allclose(vcov.ravel(), fit["vcov"], atol=1e-8)
    first = min(fit["groups"], key=lambda g: g["level"])
    assert np.allclose(effect, first["effect"], atol=1e-6)
    rng = np.random.default_rng(0)
    for _ in range(20):  # no covariance near by does better
        half = np.linalg.cholesky(cov) + np.tril(0.03 * rng.normal(size=(k, k)))
        assert dense_reml(d, x, half @ half.T, fit["sigma"] * np.exp(0.02 * rng.normal()), places)[0] <= loglik + 1e-6


def test_logistic_fit_has_the_dense_laplace_value(spark):
    d, x = simulate(groups=12, per=60)
    fit = mixed.fit_logistic(spark.createDataFrame(d), [], "g", "hit", "w", "1 + x1 + x2", "1 + x1 + x2").first()
    cov = np.array(fit["cov"]).reshape(3, 3) + 1e-10 * np.eye(3)
    beta, total = np.array(fit["beta"]), 0.0
    effects = {g["level"]: g["effect"] for g in fit["groups"]}
    for g in range(12):
        m = (d.g == g).to_numpy()
        z, w, s = x[m], d.w[m].to_numpy(), d.hit[m].to_numpy()

        def penalised(u):
            eta = z @ (beta + u)
            return -w @ (s * eta - np.logaddexp(0, eta)) + 0.5 * u @ np.linalg.solve(cov, u)

        u, _, _ = minimise(penalised, np.zeros(3))
        eta = z @ (beta + u)
        h = (z * (w / (1 + np.exp(-eta)) / (1 + np.exp(eta)))[:, None]).T @ z + np.linalg.inv(cov)
        total += -penalised(u) - 0.5 * (np.linalg.slogdet(h)[1] + np.linalg.slogdet(cov)[1])
        assert np.allclose(u, effects[g], atol=2e-2)
    assert fit["converged"] and abs(total - fit["loglik"]) < 1e-2


def test_rows_that_lack_something_take_no_part(spark):
    d, _ = simulate(groups=8)
    df = spark.createDataFrame(d)
    none = [(1, None, 0.1, 1.0, 9.0, 1), (1, 0.5, None, 1.0, 9.0, 1), (1, 0.5, 0.1, None, 9.0, 1), (1, 0.5, 0.1, 1.0, None, 1),
            (None, 0.5, 0.1, 1.0, 9.0, 1), (1, 0.5, 0.1, 0.0, 9.0, 1)]
    more = df.unionByName(spark.createDataFrame(none, "g bigint, x1 double, x2 double, w double, y double, hit bigint"))
    one, two = (mixed.fit_linear(f, [], "g", "y", "w", "1 + x1 + x2", "1 + x1").first() for f in (df, more))
    assert one["n"] == two["n"] and np.allclose(one["beta"], two["beta"])
    assert mixed.fit_linear(df.limit(0), [], "g", "y", None, "1 + x1", "1").collect() == []
    with pytest.raises(ValueError):
        mixed.fit_linear(df, [], "g", "y", None, "1 + x1", "1 + x2")


def test_formulas():
    assert mixed.terms_of("1 + a + b") == ["(Intercept)", "a", "b"] and mixed.terms_of("-1 + a") == ["a"]


def test_one_slope_is_the_grid_fit(spark):
    rng = np.random.default_rng(3)
    d = pd.DataFrame({"birth": np.repeat(np.arange(1950, 1970), 30), "age_s": rng.uniform(size=600), "w": rng.choice([0.5, 2.0], 600)})
    d["y"] = 25 + 2 * d.age_s + rng.normal(size=20)[d.birth - 1950] + rng.normal(size=600)
    grid = reml_fit(sums(d), False)
    fit = mixed.fit_linear(spark.createDataFrame(d), [], "birth", "y", "w", "1 + age_s", "1 + age_s").first()
    assert fit["loglik"] == pytest.approx(grid["loglik"], abs=1e-7) and np.allclose(fit["beta"], grid["beta"])


def test_long_summaries(spark):
    d, _ = simulate()
    df = spark.createDataFrame(d).withColumn("half", F.col("g") % 2)
    models = mixed.fit_linear(df, ["half"], "g", "y", "w", "1 + x1 + x2", "1 + x1 + x2").cache()
    rows = mixed.model_terms(models, ["half"], "g").where("half = 0").collect()
    assert [r["term"] for r in rows] == [
        "(Intercept)", "x1", "x2", "sd__(Intercept)", "sd__x1", "sd__x2", "cor__(Intercept).x1", "cor__(Intercept).x2", "cor__x1.x2", "sd__Observation",
    ]
    fit = models.where("half = 0").first()
    cov = np.array(fit["cov"]).reshape(3, 3)
    sd = np.sqrt(np.diag(cov))
    by = {r["term"]: r for r in rows}
    assert by["cor__x1.x2"]["estimate"] == pytest.approx(cov[1, 2] / sd[1] / sd[2]) and by["sd__x2"]["estimate"] == pytest.approx(sd[2])
    assert by["x1"]["statistic"] == pytest.approx(fit["beta"][1] / np.sqrt(fit["vcov"][4])) and by["sd__x1"]["group"] == "g"
    line = mixed.model_summaries(models, ["half"]).where("half = 0").first()
    assert line["df_residual"] == fit["n"] - 3 - 6 - 1 and line["deviance"] == pytest.approx(-2 * fit["loglik"])
    assert mixed.model_effects(models, ["half"], "g").count() == 25 * 3


def test_survey_models(spark):
    clean = clean_table(spark, "/root/testdata/sf0.01")
    out = growth.spline_growth(clean, "bmi")
    assert {r["term"] for r in out["terms"].collect()} >= {"age_ns2", "sd__age_ns2", "cor__age_ns1.age_ns2", "sd__Observation"}
    curves = out["trajectories"].toPandas()
    assert len(curves) and curves.estimate.notna().all()
    share = growth.spline_growth(clean, "obese", "1 + age_ns1")
    assert share["trajectories"].where("estimate < 0 OR estimate > 1").isEmpty()
    specs = [s for s in mixed.spec_grid() if s["spec_id"] in (1, 2, 3)]
    grid = growth.specification_results(clean, specs)
    terms = grid["terms"].groupBy("spec_id").agg(F.collect_set("term").alias("t")).collect()
    names = {r["spec_id"]: set(r["t"]) for r in terms}
    assert "cor__(Intercept).age_s" in names[1] and "sd__(Intercept)" not in names[2] and "sd__Observation" not in names[3]
    assert grid["summaries"].count() == 3
