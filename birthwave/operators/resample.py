"""Bootstrap replicates as integer row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from .ranks import global_rank

# A digest of 128 bits serves four replicates with 32 bits each.
_WORDS = 4
_WORD_SIZE = 1 << 32
_DRAWS_PER_CHUNK = 65_536


def replicate_block(boot) -> Column:
    """Block of replicates that share one digest."""
    return F.floor((boot - 1) / _WORDS).cast("int")


def poisson_draws(
    df: DataFrame, by: list[str], row_id: str, blocks: Column, seed: int = 1, stream: str = "poisson", extra: str | None = None
) -> DataFrame:
    """Rows times the replicates of the listed blocks, with positive Poisson(1) counts ``k``.

    The count is a function of stratum, row and replicate, so replicates need
    neither a shuffle nor storage: they are laid out and aggregated within the
    task that reads the row. ``extra`` names a column that maps replicates to
    what their count is changed by.
    """
    digest = draws.digest(stream, F.lit(seed), *by, row_id, "_block")
    halves = {f"_h{i}": F.conv(F.substring("_hex", 1 + 16 * i, 16), 16, -10).cast("bigint") for i in (0, 1)}
    words = [w for h in halves for w in (F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(_WORD_SIZE - 1)))]
    uniforms = [(w.cast("double") + F.lit(0.5)) / F.lit(float(_WORD_SIZE)) for w in words]
    # The first step of the distribution is the chance of a zero count.
    some, count = F.col("_u") >= F.lit(draws.poisson_steps()[0]), draws.poisson_count(F.col("_u"))
    if extra:
        some = some | F.map_contains_key(extra, F.col("boot"))
        count = count + F.coalesce(F.try_element_at(extra, F.col("boot")), F.lit(0))
    return (
        df.withColumn("_block", F.explode(blocks))
        .withColumn("_hex", digest)
        .withColumns(halves)
        .select("*", F.posexplode(F.array(*uniforms)).alias("_word", "_u"))
        .withColumn("boot", F.col("_block") * _WORDS + F.col("_word") + 1)
        .where(some)
        .withColumn("k", count)
        .drop("_block", "_word", "_hex", "_h0", "_h1", "_u")
    )


def poisson_bootstrap(df: DataFrame, by: list[str], row_id: str, reps: int, seed: int = 1) -> DataFrame:
    """Rows times replicates with a Poisson(1) count ``k``; replicate 0 is the sample."""
    sample = df.withColumns({"boot": F.lit(0), "k": F.lit(1)})
    if reps < 1:
        return sample
    blocks = F.sequence(F.lit(0), replicate_block(F.lit(reps)))
    drawn = poisson_draws(df, by, row_id, blocks, seed).where(F.col("boot") <= reps)
    return sample.unionByName(drawn)


def exact_bootstrap(df: DataFrame, by: list[str], row_id: str, reps: int, seed: int = 1) -> DataFrame:
    """With-replacement samples of the stratum's own size, as counts ``k`` per row and replicate.

    Independent Poisson(1) counts are a multinomial sample once their sum is
    given. So the counts are drawn where the rows are, and only the difference
    of a replicate's sum to the stratum's size n, about the root of n, moves:
    missing draws are added at uniform positions, and surplus ones are taken
    away, each drawn unit with the same chance. ``row_id`` is unique in a stratum.
    """
    sample = df.withColumns({"boot": F.lit(0), "k": F.lit(1)})
    if reps < 1:
        return sample
    blocks = F.sequence(F.lit(0), replicate_block(F.lit(reps)))
    # Rows meet all replicates here, so they are spread by number and not by size; totals, names and changes share this order.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = global_rank(df, by, [row_id], "_idx").repartition(parts, *by, "_idx")
    slim = ranked.select(*by, row_id, "_idx")
    changes = _size_changes(slim, by, row_id, reps, blocks, seed)
    entry = F.struct("boot", "_d")
    changed = changes.groupBy(*by, "_idx").agg(F.map_from_entries(F.collect_list(entry)).alias("_extra"))
    rows = ranked.join(changed, [*by, "_idx"], "left").drop("_idx")
    drawn = poisson_draws(rows, by, row_id, blocks, seed, "exact", "_extra").where(F.col("boot").between(1, reps) & (F.col("k") > 0))
    return sample.unionByName(drawn.drop("_extra"))


def _size_changes(slim: DataFrame, by: list[str], row_id: str, reps: int, blocks: Column, seed: int) -> DataFrame:
    """Changes ``_d`` of the count at position ``_idx`` that give each replicate its stratum's size.

    Surplus units are named by (position, number of the unit in its row's count)
    and picked as the first different ones that exist in a series of uniform
    names. The series is so long that it falls short with a chance below 1e-9.
    """
    units = len(draws.poisson_steps())
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = poisson_draws(slim, by, row_id, blocks, seed, "exact").groupBy(*by, "boot").agg(F.sum("k").alias("_s"))
    sizes = slim.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    gaps = sizes.withColumn("boot", F.explode(F.sequence(F.lit(1), F.lit(reps)))).join(totals, [*by, "boot"], "left")
    gaps = gaps.select(*by, "_n", "boot", (F.col("_n") - F.coalesce("_s", F.lit(0))).alias("_gap")).where("_gap <> 0")
    surplus = F.col("_gap") < 0
    wanted = F.when(surplus, units * (40 - 2 * F.col("_gap"))).otherwise(F.col("_gap"))
    chunks = gaps.withColumn("_many", wanted).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("_many") - 1) / _DRAWS_PER_CHUNK)))
    )
    first = F.col("_chunk") * _DRAWS_PER_CHUNK + 1
    numbers = F.sequence(first, F.least(F.col("_many"), first + (_DRAWS_PER_CHUNK - 1)))
    chunks = chunks.repartition(parts, *by, "boot", "_chunk").withColumn("_draw", F.explode(numbers))
    u = draws.uniform("fill", F.lit(seed), *by, "boot", "_draw")
    named = chunks.withColumn("_name", F.floor(u * (F.col("_n") * F.when(surplus, units).otherwise(1))).cast("bigint"))
    added = named.where(~surplus).withColumn("_idx", F.col("_name") + 1).groupBy(*by, "boot", "_idx").agg(F.count(F.lit(1)).cast("int").alias("_d"))
    names = named.where(surplus).withColumns({"_idx": F.floor(F.col("_name") / units) + 1, "_unit": F.col("_name") % units})
    names = names.withColumnRenamed("boot", "_want").repartition(parts, *by, "_idx")
    there = poisson_draws(names.join(slim, [*by, "_idx"]), by, row_id, F.array(replicate_block(F.col("_want"))), seed, "exact")
    there = there.where("boot = _want and _unit < k").groupBy(*by, "boot", "_gap", "_idx", "_unit").agg(F.min("_draw").alias("_draw"))
    order = F.row_number().over(Window.partitionBy(*by, "boot").orderBy("_draw"))
    removed = there.withColumn("_order", order).where("_order <= -_gap").groupBy(*by, "boot", "_idx").agg((-F.count(F.lit(1))).cast("int").alias("_d"))
    return added.unionByName(removed)


def bootstrap(df: DataFrame, by: list[str], row_id: str, reps: int, seed: int = 1, method: str = "poisson") -> DataFrame:
    methods = {"poisson": poisson_bootstrap, "exact": exact_bootstrap}
    if method not in methods:
        raise ValueError(f"unknown bootstrap method {method!r}")
    return methods[method](df, by, row_id, reps, seed)


def replicate_weighted_mean(boot: DataFrame, by: list[str], y: str, w: str) -> DataFrame:
    """Weighted mean per stratum and replicate; null where the weights sum to zero."""
    kw = F.col("k") * F.col(w)
    return boot.groupBy(*by, "boot").agg((F.sum(kw * F.col(y)) / F.nullif(F.sum(kw), F.lit(0))).alias("value"))
