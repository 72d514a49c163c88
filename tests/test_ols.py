"""Two-factor regression against dense least squares: any level type, many levels, iterated and formed equations."""

import numpy as np
import pandas as pd
import pytest

from birthwave.operators import ols


def dense(d):
    """Contrasts and standard errors of both factors, by level."""
    la, lb = np.unique(d.a), np.unique(d.b)
    x = np.hstack([np.ones((len(d), 1)), d.a.to_numpy()[:, None] == la[None, 1:], d.b.to_numpy()[:, None] == lb[None, 1:]]).astype(float)
    beta, *_ = np.linalg.lstsq(x, d.y, rcond=None)
    s2 = ((d.y - x @ beta) ** 2).sum() / (len(d) - x.shape[1])
    se = np.sqrt(np.diag(s2 * np.linalg.inv(x.T @ x)))
    names = [("a", str(v)) for v in la[1:]] + [("b", str(v)) for v in lb[1:]]
    return {n: (b, e) for n, b, e in zip(names, beta[1:], se[1:])}


def found(df, **more):
    rows = ols.two_factor_effects(df, "y", "a", "b", **more).collect()
    return {(r["factor"], str(r["level"])): (r["estimate"], r["se"]) for r in rows}


def same(got, want):
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-8, abs=1e-10), k


@pytest.mark.parametrize("most", [256, 0])
def test_text_levels_formed_and_iterated(spark, most):
    rng = np.random.default_rng(0)
    d = pd.DataFrame({"a": rng.integers(0, 12, 400), "b": rng.choice(list("uvwxyz"), 400)})
    d["y"] = rng.normal(size=400) + 0.3 * d.a
    df = spark.createDataFrame(d)
    same(found(df, dense=most), dense(d))
    gaps = spark.createDataFrame([(None, "u", 1.0), (3, None, 1.0), (3, "v", None)], "a bigint, b string, y double")
    same(found(df.unionByName(gaps), dense=most), dense(d))


@pytest.mark.parametrize("most", [256, 0])
def test_levels_that_nothing_links_to_the_first_have_no_contrast(spark, most):
    rng = np.random.default_rng(1)
    near = pd.DataFrame({"a": rng.choice(["a", "b", "c"], 80), "b": rng.choice(["p", "q"], 80)})
    far = pd.DataFrame({"a": rng.choice(["k", "l"], 40), "b": rng.choice(["s", "t"], 40)})
    both = pd.concat([near, far], ignore_index=True)
    both["y"] = rng.normal(size=len(both))
    got = found(spark.createDataFrame(both), dense=most)
    alone = dense(both.iloc[:80])
    apart = {("a", "k"), ("a", "l"), ("b", "s"), ("b", "t")}
    assert set(got) == set(alone) | apart and all(got[k] == (None, None) for k in apart)
    # The estimates are those of the linked part; the residual variance is that of all rows.
    assert all(got[k][0] == pytest.approx(alone[k][0]) for k in alone)
    ratio = [got[k][1] / alone[k][1] for k in alone]
    assert np.allclose(ratio, ratio[0])


def test_a_hundred_thousand_levels(spark):
    df = spark.range(400_000).selectExpr(
        "id % 100000 AS a", "concat('g', (id div 7) % 5) AS b", "(id % 100000) * 0.001D + ((id div 7) % 5) * 0.5D AS y"
    )
    rows = ols.two_factor_effects(df, "y", "a", "b")
    worst = rows.selectExpr(
        "max(abs(estimate - if(factor = 'a', cast(level AS double) * 0.001D, cast(substring(level, 2) AS int) * 0.5D))) AS e", "count(*) AS n", "max(se) AS se"
    ).first()
    assert worst["n"] == 99_999 + 4 and worst["e"] < 1e-8 and worst["se"] < 1e-5


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 5.0)], "a string, b int, y double")
    rows = ols.two_factor_effects(df, "y", "a", "b").collect()
    assert [tuple(r) for r in rows] == [("a", "b", 3.0, None, None, None)]
    assert ols.two_factor_effects(df.limit(0), "y", "a", "b").collect() == []
    assert ols.spline_mean(df.limit(0).withColumn("x", df.y), "y", "x").collect() == []


def test_spline_mean_is_the_dense_fit(spark):
    rng = np.random.default_rng(2)
    d = pd.DataFrame({"x": rng.integers(0, 40, 600).astype(float)})
    d["y"] = np.sin(d.x / 8) + rng.normal(0, 0.3, 600)
    got = ols.spline_mean(spark.createDataFrame(d), "y", "x").toPandas().sort_values("x")
    # A natural spline of the same knots: truncated cubes with the linear tails.
    values = np.unique(d.x)
    k = np.quantile(values, [0, 1 / 3, 2 / 3, 1])
    cube = lambda x, a: np.maximum(x - a, 0.0) ** 3
    part = lambda x, i: (cube(x, k[i]) - cube(x, k[3])) / (k[3] - k[i])
    basis = lambda x: np.column_stack([np.ones(len(x)), x, part(x, 0) - part(x, 2), part(x, 1) - part(x, 2)])
    x = basis(d.x.to_numpy())
    beta, *_ = np.linalg.lstsq(x, d.y, rcond=None)
    s2 = ((d.y - x @ beta) ** 2).sum() / (600 - 4)
    grid = basis(values)
    assert np.allclose(got.predicted, grid @ beta)
    assert np.allclose(got.se, np.sqrt(np.einsum("ij,jk,ik->i", grid, s2 * np.linalg.inv(x.T @ x), grid)))
