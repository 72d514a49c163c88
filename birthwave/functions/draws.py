"""Reproducible draws: pure functions of row, stream and replicate.

A draw depends on nothing but its keys, so it is the same under any
partitioning and after a lost task is run again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 52
WORD_HEX = 13


def digest(stream: str, *keys) -> Column:
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(stream), *[p.cast("string") for p in parts]))


def hex_uniform(hexed: Column, start: int, digits: int) -> Column:
    """Uniform in the open unit interval from ``digits`` hex characters."""
    number = F.conv(F.substring(hexed, start, digits), 16, 10).cast("bigint")
    return (number.cast("double") + F.lit(0.5)) / F.lit(float(16**digits))


def uniform(stream: str, *keys) -> Column:
    return hex_uniform(digest(stream, *keys), 1, WORD_HEX)


def normal(stream: str, *keys) -> Column:
    """Standard normal by the Box-Muller transform of two words of one digest."""
    hexed = digest(stream, *keys)
    radius = F.sqrt(F.lit(-2.0) * F.log(hex_uniform(hexed, 1, WORD_HEX)))
    return radius * F.cos(F.lit(2 * math.pi) * hex_uniform(hexed, 1 + WORD_HEX, WORD_HEX))


def poisson_steps(terms: int = 14) -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean one."""
    steps, total = [], 0.0
    for j in range(terms):
        total += math.exp(-1) / math.factorial(j)
        steps.append(total)
    return steps


def poisson_count(u: Column) -> Column:
    """Poisson(1) count by inversion of a uniform."""
    count = F.lit(0)
    for step in poisson_steps():
        count = count + F.when(u >= F.lit(step), 1).otherwise(0)
    return count
