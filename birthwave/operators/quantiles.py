"""Exact quantiles of groups of any size, by distributed selection.

``percentile`` holds every distinct value of a group in one task. Here the
wanted ranks narrow down instead: a histogram of the values between a rank's
bounds (a partial aggregation) tells the bin that holds it, the bin's own least
and greatest value are the next bounds, and only when few rows are left, or one
value, are these looked at. A round divides the rows of a rank by the number of
bins, so a billion rows take two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import join_summary, stage

BINS = 1024
SMALL = 10_000  # rows of a rank's last interval that are sorted

_FINITE = "abs(_v) < double('Infinity')"


def _bin(bins: int) -> Column:
    """Number of the bin of ``_v`` between ``lo`` and ``hi``; halves keep the widest range finite."""
    wide = F.greatest(F.abs("lo"), F.abs("hi")) > 1e307
    share = F.when(wide, (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(
        (F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    )
    return F.least(F.floor(share * bins), F.lit(bins - 1))


def _inside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows beside the intervals (``_g, lo, hi, before``) of their group that hold them."""
    return join_summary(rows, spans, ["_g"], "inner").where(F.col("_v").between(F.col("lo"), F.col("hi")))


def _ranked(rows: DataFrame, ranks: DataFrame, bins: int, small: int) -> DataFrame:
    """``_g, r, value`` of the wanted ranks among the finite values; ``ranks`` has the bounds ``lo, hi, before, size``."""
    found = []
    while True:
        ranks = stage(ranks, "quantile-ranks")
        open_ = (F.col("size") > small) & (F.col("lo") < F.col("hi"))
        found.append(ranks.where(~open_))
        going = ranks.where(open_)
        if going.isEmpty():
            break
        spans = going.select("_g", "lo", "hi", "before").distinct()
        cells = _inside(rows, spans).withColumn("_bin", _bin(bins)).groupBy("_g", "before", "_bin").agg(
            F.count(F.lit(1)).alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        earlier = Window.partitionBy("_g", "before").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("next", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        met = going.select("_g", "r", "before").join(cells, ["_g", "before"])
        met = met.where((F.col("r") >= F.col("next")) & (F.col("r") < F.col("next") + F.col("size")))
        ranks = met.select("_g", "r", "lo", "hi", F.col("next").alias("before"), "size")
    last = found[0]
    for part in found[1:]:
        last = last.unionByName(part)
    known = last.where("lo = hi").select("_g", "r", F.col("lo").alias("value"))
    few = stage(last.where("lo < hi"), "quantile-last")
    order = Window.partitionBy("_g", "before").orderBy("_v")
    sorted_ = _inside(rows, few.select("_g", "lo", "hi", "before").distinct()).withColumn("r", F.col("before") + F.row_number().over(order) - 1)
    seen = few.select("_g", "r").join(sorted_.select("_g", "r", F.col("_v").alias("value")), ["_g", "r"])
    return known.unionByName(seen)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], bins: int = BINS, small: int = SMALL) -> DataFrame:
    """``by`` and ``quantiles``, an array of interpolated quantiles like ``percentile`` gives them.

    Null values do not count, NaN is the greatest value, groups without a value
    are left out, and a null key is a group of its own.
    """
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("_one"))
    rows = stage(df.select(key.alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), "quantile-rows")
    infinite = float("inf")
    totals = rows.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_v") == -infinite, 1)).alias("below"), F.count(F.when(F.expr(_FINITE), 1)).alias("size"),
        F.count(F.when(F.col("_v") == infinite, 1)).alias("above"), F.min(F.when(F.expr(_FINITE), F.col("_v"))).alias("lo"), F.max(F.when(F.expr(_FINITE), F.col("_v"))).alias("hi"),
    )
    totals = stage(totals, "quantile-totals")
    wanted = totals.withColumn("_p", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])))
    at = (F.col("n") - 1) * F.col("_p.p")
    wanted = wanted.select("*", F.col("_p.i").alias("i"), at.alias("at")).withColumn("end", F.explode(F.array(F.floor("at"), F.ceil("at"))))
    wanted = wanted.withColumn("r", F.col("end") - F.col("below"))
    ranks = wanted.where((F.col("r") >= 0) & (F.col("r") < F.col("size"))).select("_g", "r", "lo", "hi", F.lit(0).cast("bigint").alias("before"), "size").distinct()
    values = _ranked(rows.where(_FINITE), ranks, bins, small)
    met = wanted.join(values, ["_g", "r"], "left").withColumn(
        "value",
        F.when(F.col("r") < 0, -infinite).when(F.col("r") < F.col("size"), F.col("value"))
        .when(F.col("r") < F.col("size") + F.col("above"), infinite).otherwise(float("nan")),
    )
    ends = met.groupBy("_g", "i", "at").agg(F.min_by("value", "end").alias("low"), F.max_by("value", "end").alias("high"))
    share = F.col("at") - F.floor("at")
    between = (1 - share) * F.col("low") + share * F.col("high")
    ends = ends.withColumn("q", F.when((share == 0) | (F.col("low") == F.col("high")), F.col("low")).otherwise(between))
    out = ends.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
    return out.select(*[F.col("_g")[c].alias(c) for c in by], "quantiles")
