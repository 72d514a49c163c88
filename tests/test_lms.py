import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from birthwave.operators import lms
from birthwave.params import Params
from birthwave.plans import centiles, queries
from birthwave.plans.survey import clean_table
from statistics import NormalDist


def simulate(n=6000, seed=3, strata=("a", "b")):
    """Values drawn from known parameters, linear in x on [0, 1]."""
    rng = np.random.default_rng(seed)
    parts = []
    for i, s in enumerate(strata):
        x, z = rng.uniform(0, 1, n), rng.standard_normal(n)
        mu, sigma, nu = 24 + i + 3 * x, np.exp(-1.9 + 0.2 * x), -0.8 + 0.3 * x
        y = mu * (1 + nu * sigma * z) ** (1 / nu)
        parts.append(pd.DataFrame({"stratum": s, "x": x, "y": y, "w": rng.choice([0.5, 1.0, 1.5], n)}))
    out = pd.concat(parts, ignore_index=True)
    out = out[np.isfinite(out["y"])].reset_index(drop=True)
    out["row_id"] = np.arange(len(out))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(simulate()).cache()


@pytest.fixture(scope="module")
def fit(rows):
    return lms.fit_lms(rows, "y", ["x"], "w", ["stratum"], "row_id", reps=12).toPandas()


TRUTH = {("mu", "(Intercept)"): 24, ("mu", "x"): 3, ("sigma", "(Intercept)"): -1.9, ("sigma", "x"): 0.2,
         ("nu", "(Intercept)"): -0.8, ("nu", "x"): 0.3}


def test_recovers_parameters_within_bootstrap_error(fit):
    assert fit["converged"].all()
    for (stratum, param, term), part in fit.groupby(["stratum", "param", "term"]):
        true = TRUTH[param, term] + (1 if stratum == "b" and (param, term) == ("mu", "(Intercept)") else 0)
        point, sd = part.loc[part.boot == 0, "beta"].item(), part.loc[part.boot > 0, "beta"].std()
        assert abs(point - true) < 5 * sd, (stratum, param, term, point, sd)


def _loglik(d, c):
    m, s, v = c[0] + c[1] * d.x, np.exp(c[2] + c[3] * d.x), c[4] + c[5] * d.x
    z = ((d.y / m) ** v - 1) / (v * s)
    cdf = np.vectorize(NormalDist().cdf)(1 / (s * abs(v)))
    return float((d.w * (-np.log(2 * np.pi) / 2 + (v - 1) * np.log(d.y) - v * np.log(m) - np.log(s) - z * z / 2 - np.log(cdf))).sum())


def test_sums_match_numeric_derivatives(spark):
    d = simulate(400, strata=("a",))
    c = np.array([24.0, 2.0, -1.2, 0.1, -0.9, 0.2])
    rows = spark.createDataFrame(d).withColumns({f"c{i}": F.lit(float(v)) for i, v in enumerate(c)})
    got = lms.score_sums(lms.score_columns(rows, "y", ["x"]), ["stratum"], "w", ["x"]).first()
    assert abs(got["loglik"] - _loglik(d, c)) < 1e-3
    for i in range(6):
        h = np.zeros(6)
        h[i] = 1e-5
        numeric = (_loglik(d, c + h) - _loglik(d, c - h)) / 2e-5
        assert abs(got[f"g{i // 2}_{i % 2}"] - numeric) < 1e-2 + 1e-4 * abs(numeric)


def test_solution_is_a_maximum(fit):
    d = simulate()
    d = d[d.stratum == "a"]
    point = fit[(fit.stratum == "a") & (fit.boot == 0)].set_index(["param", "term"])
    c = np.array([point.loc[k, "beta"] for k in TRUTH])
    best = _loglik(d, c)
    assert abs(point["loglik"].iloc[0] - best) < 1e-2
    for i in range(6):
        for sign in (-1, 1):
            step = np.zeros(6)
            step[i] = sign * 0.05
            assert _loglik(d, c + step) < best


def test_partitions_do_not_matter(spark, rows):
    small = rows.where("row_id % 6 = 0")
    out = [
        lms.fit_lms(small.repartition(n), "y", ["x"], "w", ["stratum"], "row_id", reps=1).toPandas()
        .sort_values(["stratum", "boot", "param", "term"])["beta"].to_numpy()
        for n in (1, 7)
    ]
    assert np.allclose(*out, atol=1e-6)


def test_log_link_is_the_same_intercept_model(spark, rows):
    a = lms.fit_lms(rows, "y", [], "w", ["stratum"], "row_id").toPandas()
    b = lms.fit_lms(rows, "y", [], "w", ["stratum"], "row_id", mu_link="log").toPandas()
    key = ["stratum", "param"]
    both = a.merge(b, on=key)
    mu = both.param == "mu"
    assert np.allclose(both.beta_x[mu], np.exp(both.beta_y[mu]), atol=2e-3)
    assert np.allclose(both.loglik_x, both.loglik_y, atol=2e-3)


def test_a_hopeless_stratum_is_flagged_and_kept(spark, rows):
    flat = spark.createDataFrame([("flat", 0.5, 20.0, 1.0, 900_000 + i) for i in range(3)], rows.schema)
    out = lms.fit_lms(rows.where("row_id < 500").unionByName(flat), "y", ["x"], "w", ["stratum"], "row_id", max_passes=8)
    got = {r["stratum"]: r["converged"] for r in out.select("stratum", "converged").distinct().collect()}
    assert got["a"] is True and got["flat"] is False


def _sums(c, x, y, w):
    """A scoring pass in NumPy, as the row that the state step takes."""
    p = x.shape[1]
    with np.errstate(all="ignore"):
        m, s, v = x @ c[:p], np.exp(x @ c[p : 2 * p]), x @ c[2 * p :]
        m = np.where(m > 0, m, np.nan)
        v = np.where(np.abs(v) >= 1e-4, v, np.where(v < 0, -1e-4, 1e-4))
        lg, t = np.log(y / m), 1 / (s * np.abs(v))
        u = np.exp(v * lg)
        z = (u - 1) / (v * s)
        cdf = np.array([NormalDist().cdf(min(i, 40.0)) if np.isfinite(i) else np.nan for i in t])
        h = np.exp(-t * t / 2) / np.sqrt(2 * np.pi) / cdf
        q, r = (u * lg / s - z) / v, 1 - t * (t + h)
        loglik = w @ ((v - 1) * np.log(y) - v * np.log(m) - np.log(s) - z * z / 2 - np.log(cdf) - np.log(2 * np.pi) / 2)
        g = [(z * u / s - v) / m, z * z - 1 + h * t, lg - z * q + h * t / v]
        info = {
            "00": (u * u / s**2 + z * u * (1 + v) / s - v) / m**2, "01": 2 * z * u / (m * s), "02": (1 - u * (q + z * lg) / s) / m,
            "11": 2 * z * z + h * t * r, "12": h * t * r / v - 2 * z * q,
            "22": q * q + z * (u * lg * lg / s - 2 * q) / v + h * t * (1 + r) / v**2,
        }
        out = {"n": len(y), "sum_w": w.sum(), "new_loglik": float(loglik), "low_es": float((x @ c[p : 2 * p]).min())}
        out |= {f"g{b}_{i}": float((w * g[b]) @ x[:, i]) for b in range(3) for i in range(p)}
        return out | {f"i{k}_{i}_{j}": float((w * e * x[:, i]) @ x[:, j]) for k, e in info.items() for i in range(p) for j in range(i, p)}


def _settle(x, y, w, start):
    """Status and coefficients of one key under the operator's own steps."""
    p = x.shape[1]
    advance = lms._advance(p, 1e-3, 100)
    state = dict(no=0, boot=0, coef=start, trial=start, grad=[], curve=[], radius=0.0, size=0.0, promised=0.0, slope=0.0,
                 loglik=float("nan"), floor=float(np.log(1e-3 * y.std() / y.mean())), cycles=0, status="run")
    while state["status"] == "run":
        row = state | _sums(np.asarray(state["trial"]), x, y, w)
        state = next(advance([pd.DataFrame([row])])).iloc[0].to_dict()
    return state["status"], np.asarray(state["coef"])


@pytest.mark.parametrize("analysis", ["cohort", "age band"])
def test_replicates_of_the_survey_settle(spark, analysis):
    """At least 99 in 100 fits of the survey's strata of 100 rows or more, samples and replicates, converge."""
    clean = clean_table(spark, "/root/testdata/sf0.01")
    make, x, terms = {"cohort": (centiles.cohort_strata, "age", 2), "age band": (centiles.age_band_strata, "year", 3)}[analysis]
    rows, names = lms.with_spline(make(clean, Params()), x, terms, ["cohort", "stratum"])
    rows = rows.select("cohort", "stratum", "row_id", "bmi", "w", *names).toPandas().sort_values("row_id")
    rng, ends = np.random.default_rng(0), []
    for _, d in rows.groupby(["cohort", "stratum"]):
        if len(d) < 100:
            continue
        design, y, w = np.column_stack([np.ones(len(d)), d[names]]), d.bmi.to_numpy(), d.w.to_numpy()
        start = np.zeros((3, len(names) + 1))
        start[:, 0] = y.mean(), np.log(max(0.01, y.std() / y.mean())), -0.5
        status, point = _settle(design, y, w, start.ravel())
        ends.append(status)
        for _ in range(6):
            k = rng.poisson(1, len(d))
            ends.append(_settle(design[k > 0], y[k > 0], (w * k)[k > 0], point)[0])
    assert len(ends) >= 100 and ends.count("converged") >= 0.99 * len(ends), ends


def test_fits_that_cannot_converge_are_given_up_early(spark):
    rng = np.random.default_rng(1)
    few = pd.DataFrame({"stratum": "few", "x": rng.uniform(size=6), "y": rng.normal(25, 3, 6)})
    point = pd.DataFrame({"stratum": "point", "x": np.append(np.zeros(1), np.linspace(0.9, 1, 20)), "y": np.append(25.0, rng.normal(27, 3, 20))})
    d = pd.concat([few, point], ignore_index=True).assign(w=1.0, row_id=range(27))
    got = {r["stratum"]: (r["converged"], r["cycles"]) for r in lms.fit_lms(spark.createDataFrame(d), "y", ["x"], "w", ["stratum"], "row_id").collect()}
    assert got["few"] == (False, 1) and not got["point"][0] and got["point"][1] < 60


def test_curves_count_used_and_failed_replicates(spark):
    rows = [("a", 0, 25.0), ("a", 1, 26.0), ("a", 2, None), ("a", 3, 24.0), ("b", 0, 25.0)]
    params = spark.createDataFrame(rows, "g string, boot int, mu double").withColumns({"sigma": F.lit(0.1), "nu": F.lit(-0.5)})
    got = {r["g"]: (r["n_used"], r["n_failed"]) for r in lms.lms_centiles(params, ["g"], [50]).collect()}
    assert got == {"a": (2, 1), "b": (0, 0)}
    got = {(r["n_used"], r["n_failed"]) for r in lms.centile_contrast(params.where("g = 'a'"), ["g"]).collect()}
    assert got == {(2, 1)}


def test_trust_step_is_the_best_within_the_radius():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.normal(size=(5, 5))
        curve, g, radius = a + a.T, rng.normal(size=5), rng.uniform(0.1, 3)
        scale = np.sqrt(np.abs(np.diag(curve)))
        step, promised, size = lms.trust_step(curve, g, radius)
        assert size <= radius * (1 + 1e-6) and promised == pytest.approx(g @ step - step @ curve @ step / 2, abs=1e-9)
        other = rng.normal(size=(2000, 5)) / scale
        other *= (radius * rng.uniform(size=2000) ** 0.2 / np.linalg.norm(other * scale, axis=1))[:, None]
        assert (other @ g - np.einsum("ij,jk,ik->i", other, curve, other) / 2).max() <= promised + 1e-6


def test_centiles_rise_and_contrasts_are_their_differences(spark):
    params = spark.createDataFrame([(1, 25.0, 0.15, -0.7), (2, 27.0, 0.2, 0.0), (3, 30.0, 0.1, 1.2)], "x int, mu double, sigma double, nu double")
    params = params.withColumn("boot", F.explode(F.array(F.lit(0), F.lit(1))))
    c = lms.lms_centiles(params, ["x"]).toPandas().pivot(index="x", columns="centile", values="beta")
    assert (np.diff(c.to_numpy(), axis=1) > 0).all()
    d = lms.centile_contrast(params, ["x"], ((50, 90),)).toPandas().set_index("x")["beta"]
    assert np.allclose(d, c[90] - c[50])
    assert np.allclose(c[50], [25, 27, 30])


def test_registered_fits_take_all_replicates_and_centiles(spark, monkeypatch):
    asked = []

    def fake(clean, reps, params):
        asked.append(reps)
        rows = [(1951, "male", "all", b, 20, 25.0 + b, 0.15, -0.7) for b in range(3)]
        df = spark.createDataFrame(rows, "cohort int, stratum string, sex string, boot int, age int, mu double, sigma double, nu double")
        return df, df.withColumn("year", F.lit(2000))

    monkeypatch.setattr(queries, "clean_table", lambda spark, sf: None)
    monkeypatch.setattr(queries.centiles, "cohort_centiles", fake)
    monkeypatch.setattr(queries.centiles, "age_band_centiles", fake)
    queries.lms_fit(spark, "")
    assert queries.lms_fit_centiles(spark, "").select("centile").distinct().count() == 99
    queries.lms_age_band_fit(spark, "")
    assert queries.lms_fit_parameters(spark, "").select("param_clean").distinct().count() == 3
    assert queries.lms_fit_contrasts(spark, "").select("comp").distinct().count() == 2
    assert asked == [Params().bootstrap_reps] * 5 == [200] * 5
