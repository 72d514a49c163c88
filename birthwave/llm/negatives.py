"""Hard-negative mining by segment summary filtering.

Components are quantised to ``floor(scale * x)`` and scores are integer inner
products. Beside its vector each row stores, for 1, 4 and 16 segments, the mean
and the deviation of every segment. On a segment the score lies within the
product of the means plus or minus the product of the deviations (the inner
product of the centred parts is bounded by their lengths), so the sums over the
segments bound the score from both sides. Pairs are refined from one segment to
sixteen; those that cannot enter a wanted window are dropped, and only the rest
are scored exactly.

Anchors are a stated query set, in blocks of ``block``; rows lie in stripes of
``stripe`` at most. A task meets one block with one stripe and keeps the best
few per anchor and window. Thresholds first come from one row in ``SEED_SHARE``,
so a stripe hands on only what may be among the best of all rows. ``WAVE`` blocks
are worked on at a time, so the disk in use is a fixed multiple of the rows.

First the positives of each anchor are searched (same label, best scores), then,
for each positive, the best rows of other labels whose score is between ``low``
and ``high`` percent of the positive's.

Defined results: rows with a null label, a null vector or a component that is
null or not finite take no part; vectors of different lengths do not meet; each
row with an anchor's id is an anchor of its own, and an equal row beside it is
another row; ties go to the smaller id, null last; a row without an id may be
found but ``anchor`` decides whether it is an anchor; no rows give no rows; input
columns other than the three named are ignored. Scores are exact up to 2^63 and
larger ones raise an error, as the result could not hold them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LEVELS = (1, 4, 16)
BLOCK = 8192  # anchors of a task, on average
STRIPE = 65_536  # rows of a task, on average
WAVE = 2
SEED_SHARE = 32
PAIRS = 1 << 20  # pairs and windows a task looks at together

ROWS = "n long, vec_id long, label long, q array<double>, mean array<float>, dev array<float>"


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), kind).reshape(len(column), -1)


def segments(size: int) -> list[np.ndarray]:
    """Starts of the segments of each level for vectors of ``size`` components."""
    return [np.arange(s) * size // s for s in LEVELS if s <= size]


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment means times the root of the length, and deviations rounded up; all levels beside each other."""
    n, size = q.shape
    means, devs = [np.zeros((n, 0))], [np.zeros((n, 0))]
    norm = np.linalg.norm(q, axis=1, keepdims=True)
    for starts in segments(size):
        length = np.diff(np.append(starts, size))
        mean = np.add.reduceat(q, starts, axis=1) / np.sqrt(length)
        square = np.add.reduceat(q * q, starts, axis=1)
        means.append(mean)
        devs.append(np.sqrt(np.maximum(square - mean * mean, 0)) * (1 + 1e-6) + 1e-7 * norm)
    return np.concatenate(means, axis=1), np.concatenate(devs, axis=1)


def summarised(rows: DataFrame, scale: int) -> DataFrame:
    """Quantised vectors with their segment summaries from rows ``n, vec_id, label, vector``."""

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(column.value_lengths(), np.int64)
            for size in np.unique(sizes):
                some = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(some)
                q = np.floor(matrix(part.column("vector")).reshape(len(some), size) * scale)
                mean, dev = summaries(q)
                lists = [pa.array(list(q), pa.list_(pa.float64())), *(pa.array(list(x), pa.list_(pa.float32())) for x in (mean, dev))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("n", "vec_id", "label")] + lists, names=["n", "vec_id", "label", "q", "mean", "dev"])

    return rows.mapInArrow(run, ROWS)


def search(same: bool, k: int, low: int, high: int):
    """Best ``k`` rows of a stripe for each anchor and window.

    With ``same`` there is one window, any score of another row with the anchor's
    label; else one per given score, rows of other labels within its percentages.
    """

    def windows(given: list[list[int | None]], kind) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, given), default=1) or 1
        lo, hi = np.full((len(given), width), np.inf, kind), np.full((len(given), width), -np.inf, kind)
        for i, scores in enumerate(given):
            for w, p in enumerate(scores):
                lo[i, w], hi[i, w] = (-np.inf, np.inf) if p is None else (-((-low * p) // 100), (high * p) // 100)
        return lo, hi

    def one_size(anchors: pa.Table, rows: pa.Table, size: int) -> list[np.ndarray]:
        a, r = (matrix(t.column("q")).reshape(t.num_rows, size) for t in (anchors, rows))
        norm_a, norm_r = np.linalg.norm(a, axis=1), np.linalg.norm(r, axis=1)
        if norm_a.max() * norm_r.max() >= 2.0**53:  # beyond the integers of a double
            a, r = a.astype(np.longdouble), r.astype(np.longdouble)
        parts = [len(s) for s in segments(size)]
        stops = np.cumsum(parts)
        (mean_a, dev_a), (mean_r, dev_r) = ([matrix(t.column(c)).reshape(t.num_rows, -1) for c in ("mean", "dev")] for t in (anchors, rows))
        label_a, label_r, n_a, n_r = (t.column(c).to_numpy() for c in ("label", "n") for t in (anchors, rows))
        lo, hi = windows(anchors.column("given").to_pylist(), a.dtype)
        least = np.full(lo.shape, -np.inf, a.dtype)
        for i, known in enumerate(anchors.column("least").to_pylist()):
            for w, s in enumerate(known or ()):
                if s is not None:
                    least[i, w] = s
        ids = rows.column("vec_id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
        order = np.empty(len(r), np.int64)
        order[np.lexsort((n_r, ids))] = np.arange(len(r))  # by id, null last
        found: list[tuple[np.ndarray, ...]] = []
        held, limit = 0, 4 * lo.size * k + PAIRS
        chunk = max(16, PAIRS // lo.size)

        def pruned() -> list[tuple[np.ndarray, ...]]:
            """Only the best k of each anchor and window; their last score is the new threshold."""
            at, score, row = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((order[row], -score, at))
            at, score, row = at[by], score[by], row[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            full = place == k - 1
            least.reshape(-1)[at[full]] = np.maximum(least.reshape(-1)[at[full]], score[full])
            keep = place < k
            return [(at[keep], score[keep], row[keep])]

        for start in range(0, len(r), chunk):
            cols = np.arange(start, min(start + chunk, len(r)))
            alive = (label_a[:, None] == label_r[cols]) == same
            if same:
                alive &= n_a[:, None] != n_r[cols]
            need, most = np.maximum(lo, least).min(axis=1).astype(np.float64)[:, None], hi.max(axis=1).astype(np.float64)[:, None]
            for stop, width in zip(stops, parts):
                some = alive.any(axis=0)
                if not some.all():
                    cols, alive = cols[some], alive[:, some]
                if not len(cols):
                    break
                level = slice(stop - width, stop)
                middle, spread = mean_a[:, level] @ mean_r[cols, level].T, dev_a[:, level] @ dev_r[cols, level].T
                spread += 1e-6 * norm_a[:, None] * norm_r[cols] + 0.5
                alive &= (middle + spread >= need) & (middle - spread <= most)
            some = alive.any(axis=0)
            cols, alive = cols[some], alive[:, some]
            if not len(cols):
                continue
            score = a @ r[cols].T
            for w in range(lo.shape[1]):
                inside = alive & (score >= np.maximum(lo[:, w], least[:, w])[:, None]) & (score <= hi[:, w, None])
                if len(cols) > k:
                    ranked = np.partition(np.where(inside, -score, np.inf), k - 1, axis=1)[:, k - 1]
                    least[:, w] = np.maximum(least[:, w], -ranked)
                    inside &= score >= least[:, w, None]
                i, j = np.nonzero(inside)
                if len(i):
                    found.append((i * lo.shape[1] + w, score[i, j], cols[j]))
                    held += len(i)
            if held > limit:
                found = pruned()
                held = len(found[0][0])
        if not found:
            return []
        at, score, row = pruned()[0]
        if np.abs(score).max() >= 2.0**63:
            raise OverflowError("a score is too large for a 64-bit integer")
        return [n_a[at // lo.shape[1]], (at % lo.shape[1]).astype(np.int32), score.astype(np.int64), n_r[row], row]

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        sizes = [np.asarray(t.combine_chunks().column("q").combine_chunks().value_lengths(), np.int64) if t.num_rows else np.zeros(0, np.int64) for t in (anchors, rows)]
        for size in np.intersect1d(*sizes):
            one, two = (t.filter(pa.array(s == size)) for t, s in zip((anchors, rows), sizes))
            if made := one_size(one, two, int(size)):
                *columns, row = made
                out.append(pa.table([*columns, two.column("vec_id").take(pa.array(row))], names=["an", "w", "score", "n", "vec_id"]))
        kinds = pa.schema([("an", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("n", pa.int64()), ("vec_id", pa.int64())])
        return pa.concat_tables([t.cast(kinds) for t in out]) if out else kinds.empty_table()

    return run


def best(asked: DataFrame, rows: DataFrame, count: int, blocks: list[int], k: int, run, stripe: int, name: str) -> DataFrame:
    """``an, w, score, n, vec_id, place`` of the best ``k`` rows for each anchor and window of ``asked``.

    ``asked`` has the columns of the rows with ``ab`` (block), ``given`` and ``least``; ``blocks`` lists its blocks.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(parts, math.ceil(count / stripe))
    tasks = max(parts, stripes * len(blocks))
    key = ["ab", "rs"]
    left = asked.withColumn("rs", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).repartition(tasks, *key)
    right = rows.withColumns({"rs": F.pmod(F.xxhash64("n"), F.lit(stripes)).cast("int"), "ab": F.explode(F.array(*map(F.lit, blocks)))})
    found = left.groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(run, "an long, w int, score long, n long, vec_id long")
    ranked = Window.partitionBy("an", "w").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "n")
    return stage(found.withColumn("place", F.row_number().over(ranked)).filter(F.col("place") <= k), name)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK, stripe: int = STRIPE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that ``anchor`` marks."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), vectors[vector].alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("n"),
    )
    rows = rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Written with a number per row, so that later reads agree on it.
    plain = stage(rows, "negative-vectors")
    rows = stage(summarised(plain.select("n", "vec_id", "label", "vector"), scale), "negative-rows")
    count = rows.count()
    asking = plain.filter("asks").select("n")
    blocks = max(1, math.ceil(asking.count() / block))
    asking = rows.join(asking, "n", "left_semi").withColumn("ab", F.pmod(F.xxhash64(F.lit("block"), "n"), F.lit(blocks)).cast("int"))
    seed = rows.filter(F.pmod(F.xxhash64(F.lit("seed"), "n"), F.lit(SEED_SHARE)) == 0)
    out = []
    for first in range(0, blocks, WAVE):
        wave = list(range(first, min(first + WAVE, blocks)))
        asked = stage(asking.filter(F.col("ab").isin(wave)), "negative-anchors")

        def both(asked: DataFrame, k: int, same: bool) -> DataFrame:
            """Thresholds from the seed rows, then the best of all rows."""
            run = search(same, k, low, high)
            start = best(asked.withColumn("least", F.lit(None).cast("array<long>")), seed, count // SEED_SHARE, wave, k, run, stripe, "negative-seed")
            known = start.filter(F.col("place") == k).groupBy("an").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("known"))
            known = asked.join(known.withColumnRenamed("an", "n"), "n", "left")
            least = F.transform(F.sequence(F.lit(0), F.size("given") - 1), lambda w: F.try_element_at("known", w))
            return best(known.withColumn("least", least).drop("known"), rows, count, wave, k, run, stripe, "negative-best")

        near = both(asked.withColumn("given", F.array(F.lit(None).cast("long"))), positives, True)
        given = near.groupBy("an").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("near"))
        given = stage(asked.join(given.withColumnRenamed("an", "n"), "n").withColumn("given", F.col("near.score")), "negative-asked")
        hard = both(given.drop("near"), negatives, False)
        hard = hard.join(given.select(F.col("n").alias("an"), F.col("vec_id").alias("anchor_id"), "near"), "an")
        met = F.element_at("near", F.col("w") + 1)
        out.append(hard.select(
            "anchor_id", met["vec_id"].alias("positive_id"), F.col("place").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), met["score"].alias("positive_score"), F.col("score").alias("negative_score"),
        ))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result
