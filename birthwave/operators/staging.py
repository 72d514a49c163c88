"""Written stage tables and joins whose broadcast side has a measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A summary of more rows than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000

_local_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir`` of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    app = spark.conf.get("spark.app.id", "local")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="birthwave-")
    return _local_roots[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the table read back, with a flat lineage."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(summary: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """The summary as a driver-known table, or None if it exceeds ``max_rows``."""
    head = summary.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows:
        return None
    return summary.sparkSession.createDataFrame(head, schema=summary.schema)


def join_summary(
    df: DataFrame,
    summary: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a grouped summary back to rows.

    The summary is evaluated first. If it is small the rows stay where they
    are; otherwise the join shuffles and adaptive execution splits hot keys.
    """
    small = measured(summary, max_rows)
    if small is None:
        return df.join(summary, on, how)
    return df.join(F.broadcast(small), on, how)
