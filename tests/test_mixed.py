import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from birthwave.operators import impute, mixed, strata, weights
from birthwave.operators.solvers import laplace_fit, minimise, reml_fit
from birthwave.params import Params
from birthwave.plans import growth
from birthwave.plans.survey import clean_table


def simulate(seed=5, groups=40, per=60):
    rng = np.random.default_rng(seed)
    birth = np.repeat(np.arange(1930, 1930 + groups), per)
    x = rng.uniform(0, 1, len(birth))
    u = rng.multivariate_normal([0, 0], [[1.0, -0.3], [-0.3, 0.8]], groups)
    g = birth - 1930
    mean = 25 + 3 * x + u[g, 0] + u[g, 1] * x
    w = rng.choice([0.5, 1.0, 2.0], len(birth))
    return pd.DataFrame({"birth": birth, "age_s": x, "y": mean + 2 * rng.standard_normal(len(birth)) / np.sqrt(w), "w": w,
                         "row_id": np.arange(len(birth)), "p": 1 / (1 + np.exp(-(mean - 26.5))), "r": rng.uniform(size=len(birth))})


def sums(d):
    rows = [
        (b, len(p), p.w.sum(), (p.w * p.age_s).sum(), (p.w * p.age_s**2).sum(), (p.w * p.y).sum(),
         (p.w * p.age_s * p.y).sum(), (p.w * p.y**2).sum(), np.log(p.w).sum())
        for b, p in d.groupby("birth")
    ]
    return pd.DataFrame(rows, columns=["birth", "n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw"])


def dense_reml(d, fit):
    """Restricted log-likelihood of the full covariance matrix at the fitted variances."""
    x = np.stack([np.ones(len(d)), d.age_s], 1)
    sd, cor = np.array(fit["sd"]), 0.0 if np.isnan(fit["cor"]) else fit["cor"]
    cov = np.outer(sd, sd) * np.array([[1, cor], [cor, 1]])
    same = d.birth.to_numpy()[:, None] == d.birth.to_numpy()[None, :]
    v = np.where(same, x @ cov @ x.T, 0.0) + np.diag(fit["sigma"] ** 2 / d.w)
    vi = np.linalg.inv(v)
    xvx = x.T @ vi @ x
    beta = np.linalg.solve(xvx, x.T @ vi @ d.y)
    r = d.y - x @ beta
    value = np.linalg.slogdet(v)[1] + np.linalg.slogdet(xvx)[1] + r @ vi @ r + (len(d) - 2) * np.log(2 * np.pi)
    return -value / 2, beta, np.linalg.inv(xvx), cov, vi, x, r


def test_sums_give_the_dense_fit():
    d = simulate(groups=12, per=20)
    for slope_only in (False, True):
        fit = reml_fit(sums(d), slope_only)
        loglik, beta, vcov, cov, vi, x, r = dense_reml(d, fit)
        assert abs(loglik - fit["loglik"]) < 1e-6
        assert np.allclose(beta, fit["beta"], atol=1e-7)
        assert np.allclose([vcov[0, 0], vcov[0, 1], vcov[1, 1]], fit["vcov"], atol=1e-7)
        one = (d.birth == 1930).to_numpy()
        effect = cov @ x[one].T @ (vi @ r)[one]
        assert np.allclose(effect, fit["re"][0], atol=1e-6)


def test_recovers_linear_truth(spark):
    d = simulate()
    suff = spark.createDataFrame(sums(d)).withColumn("spec", F.lit(1))
    fit = mixed.fit_lmm(suff, ["spec"]).first()
    assert fit["converged"] and not fit["singular"]
    for b, v, true in zip(fit["beta"], (fit["vcov"][0], fit["vcov"][2]), (25, 3)):
        assert abs(b - true) < 4 * np.sqrt(v)
    assert abs(fit["sigma"] - 2) < 0.15 and abs(fit["sd"][0] - 1) < 0.4


def test_logistic_fit_matches_a_dense_laplace_value():
    d = simulate(groups=10, per=40)
    d["swo"], d["sw"], d["n"] = d.w * (d.r < d.p), d.w, 1.0
    cells = d[["birth", "age_s", "n", "sw", "swo"]]
    births, fit = laplace_fit(cells, False)
    sd, cor = np.array(fit["sd"]), fit["cor"]
    cov = np.outer(sd, sd) * np.array([[1, cor], [cor, 1]]) + 1e-12 * np.eye(2)
    beta, total = np.array(fit["beta"]), 0.0
    for i, b in enumerate(births):
        p = cells[cells.birth == b]
        z = np.stack([np.ones(len(p)), p.age_s], 1)

        def penalised(u):
            eta = z @ (beta + u)
            return -(p.swo @ eta - p.sw @ np.logaddexp(0, eta)) + 0.5 * u @ np.linalg.solve(cov, u)

        u, _, _ = minimise(penalised, np.zeros(2))
        eta = z @ (beta + u)
        v = p.sw / (1 + np.exp(-eta)) / (1 + np.exp(eta))
        h = (z * v.to_numpy()[:, None]).T @ z + np.linalg.inv(cov)
        total += -penalised(u) - 0.5 * np.linalg.slogdet(h)[1] - 0.5 * np.linalg.slogdet(cov)[1]
        assert np.allclose(u, fit["re"][i], atol=5e-3)
    assert abs(total - fit["loglik"]) < 1e-3


def test_logistic_recovers_truth():
    d = simulate(groups=60, per=150)
    d["swo"], d["sw"], d["n"] = 1.0 * (d.r < d.p), 1.0, 1.0
    _, fit = laplace_fit(d[["birth", "age_s", "n", "sw", "swo"]], False)
    assert abs(fit["beta"][0] + 1.5) < 4 * np.sqrt(fit["vcov"][0]) and abs(fit["beta"][1] - 3) < 4 * np.sqrt(fit["vcov"][2])


def test_spec_grid_has_36_rows_in_order():
    grid = mixed.spec_grid()
    assert len(grid) == 36 and [g["spec_id"] for g in grid] == list(range(1, 37))
    assert all(g["cohort_y"] == 1 or g["last_year"] == 2019 for g in grid)


def test_cells_equal_the_row_level_sample(spark, sf_dir):
    """The cell path gives the sums of the sample built person by person."""
    params, clean = Params(), clean_table(spark, sf_dir)
    specs = [s for s in mixed.spec_grid() if (s["sex"], s["cohort_y"], s["last_year"]) == ("female", 5, 2019)]
    got = mixed.sufficient_statistics(growth.specification_cells(clean, specs, params), growth.SAMPLE).toPandas()
    rows = strata.in_window(clean, "age", params.age_low, params.age_high).where("sex = 'Female' and year <= 2019")
    rows = strata.rescale(rows.withColumn("birth", mixed.band("birth", 5)), "age", "age_s")
    rows = strata.follow_up(rows, ["birth"], "age", params.youngest_end, params.oldest_start)
    rows = weights.normalise_weights(rows, ["year"], "wt_int")
    want = impute.frame_statistics(rows, "bmi", "w").toPandas()
    both = got.merge(want, on="birth")
    assert len(both) == len(got) == len(want)
    for c in ("n", "sw", "swx", "swxx", "swy", "swxy", "swyy", "slw"):
        assert np.allclose(both[f"{c}_x"], both[f"{c}_y"], rtol=1e-9), c


def test_specification_results(spark, sf_dir):
    specs = [s for s in mixed.spec_grid() if s["spec_id"] in (1, 2, 3, 4)]
    out = growth.specification_results(clean_table(spark, sf_dir), specs)
    fits = out["fits"].toPandas()
    assert sorted(fits.spec_id) == [1, 2, 3, 4]
    curves = out["trajectories"].toPandas()
    assert curves.estimate.notna().all()
    assert curves[curves.outcome == "obese"].estimate.between(0, 1).all()
    effects = out["random_effects"].toPandas()
    slope_only = effects[effects.spec_id == 2]
    assert set(slope_only.term_clean) == {"Random Slope"}
    assert ((effects.lci <= effects.ranef) & (effects.ranef <= effects.uci)).all()
