"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from birthwave.operators.staging import stage, stage_root

__all__ = [
    "WHITE", "BROADCAST_ROWS", "blocks_for", "carry", "digest_hex", "documents", "join_small", "outputs",
    "stage", "stage_root", "sub_batches", "words",
]

# White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"

# A staged table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def carry(docs: DataFrame, *names: str) -> DataFrame:
    """The input row as struct ``_row`` beside the named columns as ``_<name>``, so no name can clash."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *(docs[n].alias(f"_{n}") for n in names))


def outputs(columns: Iterable[str], made: dict[str, Column]) -> list[Column]:
    """Input columns out of ``_row`` followed by the made ones; a made column replaces an input one of its name."""
    taken = {m.lower() for m in made}
    return [F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in taken] + [v.alias(k) for k, v in made.items()]


def join_small(df: DataFrame, staged: DataFrame, on: Column, how: str = "left", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a staged summary: broadcast if its counted rows are few, else by shuffle."""
    return df.join(F.broadcast(staged) if staged.count() <= max_rows else staged, on, how)


def blocks_for(docs: DataFrame, text: str, block_bytes: int) -> int:
    """Number of blocks that hold about ``block_bytes`` of text each."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(1, -(-int(total) // block_bytes))


def sub_batches(batches: Iterable[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``max_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def digest_hex(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)
