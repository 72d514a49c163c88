"""Column expressions: banding, labels, safe sums, links and centiles."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

Z975 = NormalDist().inv_cdf(0.975)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def band(x, width) -> Column:
    """Lower bound of the band of ``width`` that holds x (floor modulo)."""
    x = as_col(x)
    return (x - F.pmod(x, width if isinstance(width, Column) else F.lit(width))).cast("int")


def range_label(low, width: int) -> Column:
    low = as_col(low).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + F.lit(width - 1)).cast("string"))


def centile_label(p) -> Column:
    return F.concat(as_col(p).cast("string"), F.lit("th"))


def signed_label(delta, unit: str) -> Column:
    """``-5 unit``, ``+ 3 unit``: a plus sign and a blank before values from zero up."""
    d = as_col(delta).cast("int")
    return F.concat(F.when(d < 0, "").otherwise("+ "), d.cast("string"), F.lit(f" {unit}"))


def at_least(x, threshold: float, strict: bool = False) -> Column:
    """0/1 indicator; null stays null."""
    x = as_col(x)
    return ((x > F.lit(threshold)) if strict else (x >= F.lit(threshold))).cast("int")


def sum_or_null(x) -> Column:
    """Sum that is null as soon as one input is null."""
    x = as_col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def inverse_logit(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def drop_nan(x) -> Column:
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def interval(estimate, se) -> tuple[Column, Column]:
    """Normal 95% bounds."""
    e, s = as_col(estimate), as_col(se)
    return e - F.lit(Z975) * s, e + F.lit(Z975) * s


def lms_value(mu, sigma, nu, z, log_mu: bool = False) -> Column:
    """Value at normal score z of a Box-Cox Cole-Green distribution.

    A negative base under a fractional power has no value and gives null;
    the limit form serves nu near zero.
    """
    mu, sigma, nu, z = (as_col(c) for c in (mu, sigma, nu, z))
    centre = F.exp(mu) if log_mu else mu
    base = F.lit(1.0) + nu * sigma * z
    power = F.when(base > 0, centre * F.pow(base, F.lit(1.0) / F.when(F.abs(nu) >= 1e-8, nu)))
    return F.when(F.abs(nu) < 1e-8, centre * F.exp(sigma * z)).otherwise(power)


def exact_t_quantile(df: int, z: float = Z975) -> float:
    """Student-t quantile at the level of normal score z, by bisection on the finite series of its distribution."""
    level, low, high = math.erf(z / math.sqrt(2)), 0.0, 1e3
    for _ in range(200):
        t = (low + high) / 2
        angle = math.atan(t / math.sqrt(df))
        sine, cosine = math.sin(angle), math.cos(angle)
        term, total = (cosine, 0.0) if df % 2 else (1.0, 0.0)
        for k in range(2 + df % 2, df + 1, 2):
            total += term
            term *= cosine * cosine * (k - 1) / k
        inside = 2 / math.pi * (angle + sine * total) if df % 2 else sine * total
        low, high = (t, high) if inside < level else (low, t)
    return (low + high) / 2


def t_quantile(df, z: float = Z975) -> Column:
    """Student-t quantile: exact below 30 degrees of freedom, else by the Cornish-Fisher expansion; null without any."""
    d = F.when(as_col(df) > 0, as_col(df).cast("double"))
    few = F.array(*(F.lit(exact_t_quantile(k, z)) for k in range(1, 30)))
    exact = F.when((d < 30) & (d == F.floor(d)), F.get(few, (d - 1).cast("int")))
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return F.coalesce(exact, F.lit(z) + F.lit(g1) / d + F.lit(g2) / (d * d) + F.lit(g3) / (d * d * d))


def normal_cdf_positive_sql(t: str) -> str:
    """Standard normal distribution function for 0 <= t <= 7, as SQL text: a published rational form, exact to 1e-15."""
    # Coefficients of the numerator and of the denominator, highest power first.
    above = (
        3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931,
        220.206867912376,
    )
    below = (
        8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
        793.826512519948, 440.413735824752,
    )

    def polynomial(coefficients) -> str:
        text = f"{coefficients[0]!r}D"
        for c in coefficients[1:]:
            text = f"({text} * {t} + {c!r}D)"
        return text

    return f"1D - exp(-0.5D * {t} * {t}) * {polynomial(above)} / {polynomial(below)}"
