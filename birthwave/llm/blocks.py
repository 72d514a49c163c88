"""Documents in blocks, and digests that travel between blocks and buckets.

A block is a set of documents of about ``BLOCK_BYTES`` of text, given by a hash
of the document; texts move once, to the task of their block, and every later
step of the same plan reads that exchange again. A step sends digests from
blocks to buckets (ranges of the digest), at most one per block and digest, so
even a passage that is in every document stays small; the bucket answers to the
blocks. Both sizes follow the amount of text. What does grow with the input is
the answer to a digest that stands in every block: one small entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 32 << 20  # text behind the digests of one bucket
PARTITION_BYTES = 64 << 20
LAST_ID = np.iinfo(np.int64).max

U64 = np.uint64


class Layout:
    """Documents as (``blk``, ``_doc``, ``_text``, ``_rest``), partitioned by block, with the numbers of parts and buckets."""

    def __init__(self, docs: DataFrame, text: str, doc_id: str, block_bytes: int):
        spark = docs.sparkSession
        total = int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)
        shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.blocks = max(1, -(-total // block_bytes))
        self.parts = max(shuffle, total // PARTITION_BYTES)
        self.buckets = max(4 * shuffle, total // BUCKET_BYTES)
        self.kept = [c for c in docs.columns if c != text]
        rest = F.struct(*(docs[c] for c in self.kept)) if self.kept else F.struct(F.lit(0).alias("_none"))
        where = F.xxhash64(docs[doc_id], F.octet_length(docs[text]), F.substring(docs[text], 1, 64))
        self.rows = docs.select(
            F.pmod(where, F.lit(self.blocks)).alias("blk"), docs[doc_id].cast("long").alias("_doc"),
            F.coalesce(docs[text], F.lit("")).alias("_text"), rest.alias("_rest"),
        ).repartition(self.parts, "blk")

    def schema(self, made: list[tuple[str, T.DataType]]) -> T.StructType:
        """``_rest`` as it is, followed by the made columns."""
        return T.StructType([self.rows.schema["_rest"], *(T.StructField(n, t) for n, t in made)])

    def send(self, run, fields: str) -> DataFrame:
        """Digests of each block, from ``run(block rows)``."""
        return self.rows.groupBy("blk").applyInArrow(run, f"bucket long, blk long, {fields}").repartition(self.parts, "bucket")

    def answer(self, sent: DataFrame, run, fields: str) -> DataFrame:
        """What each bucket tells the blocks, from ``run(bucket rows)``."""
        return sent.groupBy("bucket").applyInArrow(run, f"blk long, {fields}")

    def meet(self, answers: DataFrame, run, schema: str | T.StructType) -> DataFrame:
        """``run(block rows, answers to the block)`` per block."""
        return self.rows.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(run, schema)


def texts_of(table: pa.Table) -> list[bytes]:
    return table.column("_text").cast(pa.binary()).to_pylist()


def ids_of(table: pa.Table) -> np.ndarray:
    """Document ids; null comes after all others."""
    return table.column("_doc").fill_null(LAST_ID).to_numpy()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bucket_of(digest: np.ndarray, buckets: int) -> np.ndarray:
    return ((digest >> U64(32)) * U64(buckets)) >> U64(32)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the runs of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.concatenate([starts[1:], [len(keys)]])


def packed(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """Slices of an array as binary values; the slices follow each other."""
    offsets = np.concatenate([starts, stops[-1:]]) * values.itemsize
    if len(offsets) and offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError(f"{offsets[-1]} bytes in one row of a bucket or block, more than a binary value holds: take more buckets or smaller blocks")
    raw = np.ascontiguousarray(values).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw)])


def unpacked(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column and the row of each."""
    parts = [np.frombuffer(x or b"", kind) for x in column.to_pylist()]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.repeat(np.arange(len(parts)), lengths)


def to_buckets(blk: int, digest: np.ndarray, buckets: int, **more: np.ndarray) -> pa.Table:
    """Rows (bucket, blk, packed fields) of one block's digests; ``digest`` itself is among the fields if given."""
    bucket = bucket_of(digest, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts, stops = groups(bucket)
    columns = {"bucket": pa.array(bucket[starts].astype(np.int64)), "blk": pa.array(np.full(len(starts), blk, np.int64))}
    return pa.table(columns | {k: packed(v[order], starts, stops) for k, v in more.items()})


def to_blocks(blk: np.ndarray, **more: np.ndarray) -> pa.Table:
    """Rows (blk, packed fields) of one bucket's answers."""
    order = np.argsort(blk, kind="stable")
    blk = blk[order]
    starts, stops = groups(blk)
    return pa.table({"blk": pa.array(blk[starts])} | {k: packed(v[order], starts, stops) for k, v in more.items()})


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, start of each run of equal keys, and the run of each ordered row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            s = k[order]
            new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1
