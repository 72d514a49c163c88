"""Embedding near-duplicates by sorted projection passes.

Each pass hashes a vector to the concatenated signs on random hyperplanes, sorts
all vectors by that hash and cuts the order into blocks of ``block`` vectors. A
window is a block and the next one: all its pairs are compared by cosine in
double precision. Verified links of all passes are united.

A bounded window alone would lose links where many hashes share their leading
bits. The leading bits that make cells of about one block on average are
therefore a run, and a run that reaches over more than two blocks is compared
whole: its blocks are gathered to parts of about ``part`` vectors that meet
pairwise as tasks of their own. So a pair with equal leading bits is compared
however dense its group is, and the number of passes follows from the number of
those bits: a pair at the threshold has them in common in some pass with the
wanted probability.

Equal vectors are one class with a count. A pair has met in an earlier pass if
its blocks were neighbours or its run was the same there, so each link is counted
once without listing pairs; a task hands on sums per vector and a spanning forest
of its links, so a dense group gives no more rows than members of its parts.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do vectors of different lengths; each
input row gives one output row; a null id takes part, but is no component id
(a component of null ids alone has none, and its rows are kept); an input column
named like an output is replaced; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from birthwave.operators.ranks import global_rank
from birthwave.operators.staging import join_summary

from .common import carry, outputs, stage
from .components import components

THRESHOLD = 0.9
BLOCK = 1024
PART = 8192  # vectors of a long run that one side of a task holds
BITS = 48  # hyperplanes of a hash
MISSED = 0.001  # wanted probability of missing a pair at the threshold; all pairs of a dense group share the luck of the hyperplanes
CHUNK = 256
TASKS = "array<struct<run:int,low:int,high:int,part:int>>"


def run_bits(n: int, block: int) -> int:
    """Leading bits that make runs of ``block`` vectors on average."""
    return min(BITS, max(0, math.ceil(math.log2(max(1, n) / block))))


def passes_for(n: int, threshold: float, block: int, missed: float) -> int:
    """Passes after which a pair at the threshold was in one run with probability 1 - missed."""
    once = (1 - math.acos(threshold) / math.pi) ** run_bits(n, block)
    return 1 if once == 1 else math.ceil(math.log(missed) / math.log(1 - once))


def usable(v: str) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, padded with zeros to the longest, and their lengths."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), size


def keyed(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """Per class its vector's ``size`` and, per pass, the signs on ``BITS`` hyperplanes through the origin as a number."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vectors, size = unit(batch.column("vector"))
            keys = np.zeros((len(size), passes), np.int64)
            for d in np.unique(size).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((passes, d, BITS))
                mine = size == d
                for q in range(passes):
                    keys[mine, q] = (vectors[mine, :d] @ planes[d][q] > 0) @ weights
            made = [pa.array(size.astype(np.int32)), pa.array(list(keys), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *made], names=["node", "size", "keys"])

    return classes.select("node", "vector").mapInArrow(run, "node long, size int, keys array<long>")


def places(keys: DataFrame, bits: int, block: int) -> DataFrame:
    """Per class and pass the block in the sorted order, with the first and last block of its run if that is a long one."""
    at = ["pass", "size"]
    rows = keys.select("node", "size", F.posexplode("keys").alias("pass", "key"))
    ranked = global_rank(rows, at, ["key", "node"], "_at").select(
        "node", *at, F.floor((F.col("_at") - 1) / block).cast("int").alias("block"), F.shiftright("key", BITS - bits).alias("_run")
    )
    long = ranked.groupBy(*at, "_run").agg(F.min("block").alias("first"), F.max("block").alias("last")).filter("last - first > 1")
    ranked = join_summary(ranked, long, [*at, "_run"])
    return ranked.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("pass", "block", "first", "last"))).alias("places"))


def tasks(placed: DataFrame, span: int) -> DataFrame:
    """Each vector once per window and pair of parts of its long run that it belongs to, with its places of earlier passes."""
    block, first, last = (F.col(f"place.{c}") for c in ("block", "first", "last"))
    task = lambda run, low, high, part: F.struct(run.alias("run"), low.alias("low"), high.alias("high"), part.alias("part"))
    part = F.floor((block - first) / span).cast("int")
    none = F.lit(-1)
    windows = F.array(task(none, block, block + 1, block), task(none, block - 1, block, block))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((last - first) / span).cast("int")),
        lambda other: task(first, F.least(part, other), F.greatest(part, other), part),
    )
    rows = placed.select("*", F.posexplode("places").alias("pass", "place"))
    rows = rows.withColumn("task", F.explode(F.concat(F.slice(windows, 1, F.least(block + 1, F.lit(2))), F.coalesce(parts, F.array().cast(TASKS)))))
    earlier = F.slice("places", F.lit(1), F.col("pass"))
    return rows.select(
        "node", "m", "vector", "pass", "size", "task.*", block.alias("block"),
        F.transform(earlier, lambda p: p["block"]).alias("blocks"),
        F.transform(earlier, lambda p: F.coalesce(p["first"], none)).alias("runs"),
    )


def compare(threshold: float):
    """Compare a window, or two parts of a long run: link sums per node, and links that span what is linked."""

    def run(key, table):
        number, window, low, high = key[0].as_py(), key[2].as_py() < 0, key[3].as_py(), key[4].as_py()
        table = table.combine_chunks()
        vectors, _ = unit(table.column("vector").chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64())))
        node, count, part, block = (table.column(c).to_numpy() for c in ("node", "m", "part", "block"))
        # Places in the earlier passes.
        blocks, runs = (table.column(c).combine_chunks().flatten().to_numpy().reshape(len(node), number) for c in ("blocks", "runs"))
        order = np.lexsort(runs.T) if number else np.arange(len(node))
        left, right = order[part[order] == low], order[part[order] == high]
        within = window or low == high
        sums, label, links = np.zeros(len(node), np.int64), np.arange(len(node)), []
        for at in range(0, len(left), CHUNK):
            here = left[at : at + CHUNK]
            after = np.concatenate([left[at:], right if window else right[:0]]) if within else right
            place = np.arange(len(after))
            # What shared a long run with all of these vectors is met already.
            alike = (runs[here] == runs[here[0]]).all(axis=0) & (runs[here[0]] >= 0)
            new = ~(runs[after][:, alike] == runs[here[0], alike]).any(axis=1)
            if within:
                new[: len(here)] = True
            after, place = after[new], place[new]
            near = vectors[here] @ vectors[after].T >= threshold
            if within:  # each pair once
                near &= place > np.arange(len(here))[:, None]
            i, j = np.nonzero(near)
            a, b = here[i], after[j]
            fresh = np.abs(block[a] - block[b]) > 1 if not window else np.ones(len(a), bool)
            for q in range(number):
                fresh &= (np.abs(blocks[a, q] - blocks[b, q]) > 1) & ((runs[a, q] < 0) | (runs[a, q] != runs[b, q]))
            if not fresh.any():
                continue
            near[i[~fresh], j[~fresh]] = False
            np.add.at(sums, here, near @ count[after])
            np.add.at(sums, after, count[here] @ near)
            # Links between sets that are apart, one per row at a time.
            while (apart := near & (label[here][:, None] != label[after])).any():
                some = np.flatnonzero(apart.any(axis=1))
                for i, j in zip(here[some].tolist(), after[apart[some].argmax(axis=1)].tolist()):
                    if label[i] != label[j]:
                        one, two = sorted((label[i], label[j]))
                        label[label == two] = one
                        links.append((i, j))
        some, pairs = np.flatnonzero(sums), np.array(links, np.int64).reshape(-1, 2)
        return pa.table({
            "node": pa.array(np.concatenate([node[some], node[pairs[:, 0]]])),
            "links": pa.array(np.concatenate([sums[some], np.zeros(len(pairs), np.int64)])),
            "peer": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[pairs[:, 1]], pa.int64())]),
        })

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, missed: float = MISSED, seed: int = 7,
    vec_id: str = "vec_id", vector: str = "embedding", part: int = PART,
) -> DataFrame:
    """Input columns with ``n_links``, ``component_id`` and ``kept``."""
    rows = carry(vectors, vec_id, vector).select("_row", F.col(f"_{vec_id}").alias("_id"), F.col(f"_{vector}").alias("vector"))
    rows = rows.withColumn("_usable", usable(F.col("vector")))
    good = rows.filter("_usable").withColumn("_digest", F.sha2(F.concat_ws(" ", F.col("vector").cast("array<string>")), 256))
    classes = good.groupBy("_digest").agg(F.any_value("vector").alias("vector"), F.min("_id").alias("least"), F.count(F.lit(1)).alias("m"))
    classes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "embed-classes")
    n = classes.count()
    keys = stage(keyed(classes, passes_for(n, threshold, block, missed), seed), "embed-keys")
    placed = places(keys, run_bits(n, block), block).join(classes.select("node", "m", "vector"), "node")
    spread = tasks(stage(placed, "embed-places"), max(1, part // block))
    found = spread.groupBy("pass", "size", "run", "low", "high")
    found = stage(found.applyInArrow(compare(threshold), "node long, links long, peer long"), "embed-links")
    linked = components(found.filter("peer is not null").select(F.col("node").alias("a"), F.col("peer").alias("b")))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.drop("vector").join(sums, "node", "left").join(linked.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    known = stage(known.select("_digest", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("_c")), "embed-known")
    ids = known.groupBy("_c").agg(F.min("least").alias("component_id"))
    known = known.join(ids, "_c").select("_digest", "n_links", "component_id")
    some = good.join(known, "_digest").select("_row", "_id", "n_links", "component_id")
    none = rows.filter("not _usable").select("_row", "_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    made = {
        "n_links": F.col("n_links").cast("long"),
        "component_id": F.col("component_id"),
        "kept": F.coalesce(F.col("_id") == F.col("component_id"), F.col("component_id").isNull()),
    }
    return some.unionByName(none).select(*outputs(vectors.columns, made))
