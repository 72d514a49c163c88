"""Mixing sources to target weights by exponential keys.

Each document gets the key ``-ln(u) / w``: ``u`` from a digest of its id (of
its text where the id is null), ``w`` a quality weight. Within a source,
documents sorted by key are a weighted sample without replacement at every
prefix. A source whose target is r times its size takes floor(r) complete
epochs and then the prefix that comes nearest to the rest.

The prefix sum has two levels, so that a source with a third of all rows never
meets in one task: word sums per (source, key bin), then the documents of the
one bin in which the budget ends. The decision is a cut key per source, applied
to the documents where they lie. One row per source is the only global order.

Defined results: null texts have size 0; sources are ordered by code point with
null last and take the shares in turn; rows with equal keys (repeated ids) are
taken together; a source without words has target 0; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carry, join_small, outputs, stage
from .quality import SYMBOLS

BINS = 65_536
UNIT = float(2**52 + 1)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: falls with the share of symbols among the characters."""
    symbols, chars = F.regexp_count(text, F.lit(SYMBOLS)), F.length(text)
    weight = F.greatest(F.lit(0.1), F.lit(1.0) - 5 * symbols.cast("double") / chars)
    return F.when(chars > 0, weight).otherwise(F.lit(0.1))


def key_of(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.md5(text))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / UNIT
    return -F.log(u) / weight


def bin_of(key: Column) -> Column:
    """Grows with the key; near to even for weights near to 1."""
    return F.floor((1 - F.exp(-key)) * BINS).cast("long")


def targets(sizes: DataFrame, shares: tuple[int, ...], cap: float) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Capped sources are those with the lowest size to weight ratio: in that order
    the level is the first one not above its own source's ratio.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(s)) for s in shares))
    ranked = sizes.withColumn("_w", F.element_at(weights, (F.pmod(F.row_number().over(by_name) - 1, len(shares)) + 1).cast("int")))
    ranked = ranked.withColumn("_ratio", cap * F.col("source_size") / F.col("_w"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ranked = ranked.withColumn("_level", left / F.sum("_w").over(onward))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("_level").alias("level")))).over(every)
    ranked = ranked.withColumn("_lambda", F.coalesce(level["level"], F.lit(0.0)))
    capped = F.col("_ratio") < F.col("_lambda")
    return ranked.select(
        "source", "source_size",
        F.when(capped, cap * F.col("source_size")).otherwise(F.col("_lambda") * F.col("_w")).cast("double").alias("target"),
    )


def cuts(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Per source the complete epochs and the last key of the partial one (null: none)."""
    plan = goals.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stage(plan.withColumnRenamed("source", "_s"), "mix-plan")
    bins = sized.groupBy("source", bin_of(F.col("key")).alias("bin")).agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = join_small(bins, plan, F.col("source").eqNullSafe(F.col("_s")), "inner")
    # Bins before the last one that starts inside the budget are taken whole.
    last = bins.filter("_before < _rest").groupBy("_s").agg(F.max_by(F.struct("bin", "_before"), "bin").alias("_last"))
    edge = stage(plan.join(last.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t"), "mix-edge")
    near = join_small(sized.withColumn("_bin", bin_of(F.col("key"))), edge, F.col("source").eqNullSafe(F.col("_s")), "inner")
    # Rows of equal key are one step of the prefix sum.
    ties = near.filter(F.col("_bin") == F.col("_last.bin")).groupBy("_s", "key").agg(
        F.sum("size").alias("n"), F.first("_last._before").alias("_before"), F.first("_rest").alias("_rest")
    )
    upto = Window.partitionBy("_s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("_start", F.col("_before") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
    inside = ties.filter(F.col("_start") + F.col("n") / 2 <= F.col("_rest")).groupBy("_s").agg(F.max("key").alias("cut"))
    inside = inside.withColumnRenamed("_s", "_t")
    return edge.join(inside, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
        F.col("_s"), "source_size", "target", "epochs", "cut", F.col("_last.bin").alias("last_bin")
    )


def mix(
    docs: DataFrame, shares: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix",
    text: str = "text", source: str = "source", doc_id: str = "doc_id",
) -> DataFrame:
    """Input columns with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted)."""
    df = carry(docs, text, source, doc_id)
    content = F.coalesce(F.col(f"_{text}"), F.lit(""))
    df = df.select(
        "_row", F.col(f"_{source}").alias("source"), size_of(content).alias("size"),
        key_of(F.col(f"_{doc_id}"), content, quality_weight(content), seed).alias("key"),
    )
    sized = stage(df.select("source", "size", "key"), "mix-sizes")
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), shares, cap)
    plan = stage(cuts(sized, goals), "mix-cuts")
    rows = join_small(df, plan, F.col("source").eqNullSafe(F.col("_s")), "left")
    partial = (bin_of(F.col("key")) < F.col("last_bin")) | F.coalesce(F.col("key") <= F.col("cut"), F.lit(False))
    rows = rows.withColumn("copies", F.coalesce(F.col("epochs"), F.lit(0)) + F.coalesce(partial, F.lit(False)).cast("long"))
    made = {c: F.col(c) for c in ("size", "source_size", "target", "copies")}
    return rows.select(*outputs(docs.columns, made | {"taken": F.col("copies") * F.col("size")}))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with the input columns alone."""
    packed = docs.select(
        F.struct(*(docs[c] for c in docs.columns)).alias("_mixed_row"),
        *(docs[options.get(k, k)].alias(f"_mixed_{k}") for k in ("text", "source", "doc_id")),
    )
    named = {k: f"_mixed_{k}" for k in ("text", "source", "doc_id")}
    mixed = mix(packed, **{**options, **named}).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_mixed_row.*")
