"""Row numbers that never gather a group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import join_summary, stage

_ROW_BITS = 33


def running_sum(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sum of an integer column over the rows of a partition up to each row, in the order they have."""

    def run(batches):
        total = 0
        for batch in batches:
            sums = np.cumsum(batch.column(column).to_numpy(zero_copy_only=False), dtype=np.int64) + total
            if len(sums):
                total = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def range_ordered(df: DataFrame, by: list[str], order: list[str], name: str, counted: str | None = None) -> DataFrame:
    """Staged table in global order, with the sorted part and the position in it.

    Parts are cut by ``by`` and ``order`` together, so a group that holds most
    rows is spread over many parts. ``order`` should end in a unique column.
    With ``counted``, ``_run`` is the running sum of that column in the part.
    """
    keys = [*by, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    staged = stage(running_sum(ordered, counted, "_run") if counted else ordered, name)
    return staged.withColumns(
        {"_part": F.shiftright("_pos", _ROW_BITS), "_pos": F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}
    )


def global_rank(df: DataFrame, by: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``row_number`` within ``by``: position in the sorted part plus the rows of earlier parts."""
    staged = range_ordered(df, by, order, "ranked")
    runs = staged.groupBy(*by, "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")
    )
    rows = join_summary(staged, offsets, [*by, "_part"], "inner")
    return rows.withColumn(name, F.col("_pos") + F.col("_shift")).drop("_pos", "_part", "_shift")
