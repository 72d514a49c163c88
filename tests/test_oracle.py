"""Every query with an SQL twin gives the same rows in Spark and DuckDB; the others give rows."""

import pytest

import __spark_entry__ as entry
import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
# Fits are covered by their own tests; here they only have to run.
SLOW = {"lms_fit_centiles", "lms_fit", "lms_fit_parameters", "lms_fit_contrasts", "pattern_figures", "lms_age_band_fit", "spec_random_effects"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, con, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["cohort", "stratum", "year", "n", "sum_w", "mean_bmi"]
