"""Quantiles by selection equal ``percentile``: ties, nulls, NaN, infinities, wide ranges, few and many rounds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from birthwave.operators.quantiles import exact_quantiles

PROBS = [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]


def both(df, by, **sizes):
    got = exact_quantiles(df, by, "x", PROBS, **sizes).collect()
    want = df.where("x IS NOT NULL").groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, PROBS))).alias("quantiles")).collect()
    key = lambda r: repr(tuple(r[c] for c in by))
    return sorted(got, key=key), sorted(want, key=key)


@pytest.mark.parametrize("sizes", [{}, {"bins": 32, "small": 3}])
def test_as_percentile(spark, sizes):
    rng = np.random.default_rng(0)
    rows = [("normal", float(v)) for v in rng.normal(size=300)] + [("ties", float(v)) for v in rng.integers(0, 4, 200)]
    rows += [("one", 7.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), (None, 5.0), ("null", None), ("null", 3.0)]
    rows += [("nan", v) for v in (1.0, 2.0, math.nan, math.nan, 3.0)] + [("all nan", math.nan)]
    rows += [("wide", v) for v in (-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323, 1.0)] + [("steep", 2.0**k) for k in range(-300, 300, 7)]
    rows += [("ends", v) for v in (-math.inf, -math.inf, 0.0, 1.0, math.inf)]
    got, want = both(spark.createDataFrame(rows, "g string, x double").repartition(5), ["g"], **sizes)
    assert [r["g"] for r in got] == [r["g"] for r in want]
    for a, b in zip(got, want):
        if a["g"] == "ends":  # between an infinity and a number
            assert a["quantiles"][0] == -math.inf and a["quantiles"][3] == 0.0 and a["quantiles"][-1] == math.inf
        elif a["g"] == "wide":
            assert a["quantiles"] == pytest.approx(b["quantiles"], rel=1e-12, abs=0)
        else:
            assert a["quantiles"] == pytest.approx(b["quantiles"], rel=1e-12, nan_ok=True), a["g"]


def test_no_task_sorts_a_large_group(spark):
    """A hundred thousand rows in one group: the last intervals are small and the result exact."""
    df = spark.range(100_000).selectExpr("(id * 7919) % 100003 + 0.5D AS x")
    got, want = both(df, [], bins=64, small=50)
    assert got[0]["quantiles"] == pytest.approx(want[0]["quantiles"], rel=1e-13)


def test_no_rows(spark):
    assert exact_quantiles(spark.createDataFrame([], "g int, x double"), ["g"], "x", [0.5]).collect() == []


def test_polynomial_terms_exist_from_two_and_three_values_on(spark):
    from birthwave.functions.design import ortho_poly

    rows = [("one", 5.0), ("one", 5.0), ("two", 1.0), ("two", 3.0), (None, 2.0), (None, 4.0), (None, 9.0), ("gap", None)]
    rows += [("many", float(v)) for v in range(1960, 1990)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["x"]): (r["p1"], r["p2"]) for r in ortho_poly(df, "x", ["g"]).collect()}
    assert got["one", 5.0] == (None, None)
    assert got["two", 1.0] == (pytest.approx(-(0.5**0.5)), None) and got["two", 3.0][1] is None
    for g in (None, "many"):
        m = np.array([v for k, v in got.items() if k[0] == g])
        assert np.allclose(m.T @ m, np.eye(2), atol=1e-9) and np.allclose(m.sum(0), 0, atol=1e-9)
    assert len(got) == 1 + 2 + 3 + 30
    assert ortho_poly(df.where("g = 'one'"), "x", []).collect()[0]["p1"] is None
    assert ortho_poly(df.limit(0), "x", []).collect() == []
