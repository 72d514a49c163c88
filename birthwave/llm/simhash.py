"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

A fingerprint has a bit set if over half the XXH64 digests of the text's word
shingles have it. Equal fingerprints are one class. The distinct fingerprints
are cut into subtrees of a bounded size by their leading bits; two subtrees meet
only if their prefixes differ in no more bits than the error budget. A task
walks the node pairs of two subtrees together from the top, adds the bits in
which they part and drops a pair beyond the budget, down to single
fingerprints. All links within the budget are found; a task hands on a spanning
forest of them, so a dense group gives no more links than members.

Defined results: null or empty texts have fingerprint zero and are linked like
any other; each input row gives one output row; a null id takes part, but the
component's id is its least id that is not null; an input column named like an
output is replaced; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs, stage, sub_batches
from .components import components

SHINGLE, SEED, ERRORS = 4, 42, 4
SUBTREE = 65_536  # fingerprints of a subtree, on average
PAIRS = 1 << 16  # node pairs walked together
SMALL = 32  # pairs of fingerprints below two nodes that are compared without going on
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def digests(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Digests of the shingles, eight bytes each; none without words."""
    words = (text or "").encode().translate(UPPER).split()
    if not words:
        return b""
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], stops[: n - 1] + 1])
    ends = stops[min(shingle, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist())])


def majority(raw: bytes) -> int:
    """Majority bits of digests."""
    counts = np.zeros(64, np.int64)
    table = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    for at in range(0, len(table), 4096):
        counts += np.unpackbits(table[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(table)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' digests; zero without words."""
    return majority(digests(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Input columns but the text, with ``fp`` (the fingerprint as a signed 64-bit integer)."""
    kept = [c for c in docs.columns if c != text]
    df = docs.select(F.struct(*(docs[c] for c in kept)).alias("_row"), F.coalesce(docs[text], F.lit("")).alias("_text"))

    def run(batches):
        for batch in sub_batches(batches, "_text"):
            found = np.array([fingerprint(t, shingle) for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(found.view(np.int64))], names=["_row", "fp"])

    row = df.schema["_row"].dataType.simpleString()
    return df.mapInArrow(run, f"_row {row}, fp long").select(*outputs(kept, {"fp": F.col("fp")}))


class Forest:
    """Union-find over positions; keeps the links that join two sets."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            a, b = self.root(i), self.root(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)
                self.links.append((i, j))


def walk(left: np.ndarray, right: np.ndarray, errors: int, found, same: bool = False) -> None:
    """Call ``found(i, j)`` with the positions of all pairs of sorted distinct fingerprints within ``errors`` bits.

    A node is a range of the sorted array that shares its leading bits. With
    ``same`` the arrays are one, and only pairs i < j are wanted.
    """
    if not len(left) or not len(right):
        return
    zeros_left, zeros_right = Zeros(left), Zeros(right)
    stack = [(0, np.array([[0], [len(left)], [0], [len(right)], [0]], np.int32))]
    while stack:
        depth, nodes = stack.pop()
        # Node pairs of one depth are walked together as long as they are few.
        while stack and stack[-1][0] == depth and nodes.shape[1] + stack[-1][1].shape[1] <= PAIRS:
            nodes = np.concatenate([nodes, stack.pop()[1]], axis=1)
        # Small node pairs are compared directly.
        small = (nodes[1] - nodes[0]).astype(np.int64) * (nodes[3] - nodes[2]) <= SMALL
        if depth == 64:
            small[:] = True
        leaf, nodes = nodes[:, small], nodes[:, ~small]
        if leaf.shape[1]:
            wide = leaf[3] - leaf[2]
            size = (leaf[1] - leaf[0]) * wide
            k = np.arange(size.sum(), dtype=np.int32) - np.repeat(np.cumsum(size, dtype=np.int32) - size, size)
            w = np.repeat(wide, size)
            row = k // w
            i, j = np.repeat(leaf[0], size) + row, np.repeat(leaf[2], size) + k - row * w
            near = np.bitwise_count(left[i] ^ right[j]) <= errors
            if same:
                near &= i < j
            if near.any():
                found(i[near], j[near])
        if nodes.shape[1]:
            a, b, c, d, e = nodes
            m, n = zeros_left.middle(depth, a, b), zeros_right.middle(depth, c, d)
            parts = [(a, m, c, n, e), (m, b, n, d, e), (a, m, n, d, e + 1)]
            # Of two equal nodes the mirrored pair holds the same pairs.
            mirrored = (m, b, c, n, e + 1)
            parts.append(tuple(x[~((a == c) & (b == d))] for x in mirrored) if same else mirrored)
            for a, b, c, d, e in parts:
                alive = (a < b) & (c < d) & (e <= errors)
                stack.append((depth + 1, np.stack([x[alive] for x in (a, b, c, d, e)])))


class Zeros:
    """Per depth, how many of the first k sorted values have a zero bit there: it splits any node in one step."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, {}

    def middle(self, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in self.levels:
            off = (self.values >> np.uint64(63 - depth)) & np.uint64(1) == 0
            self.levels[depth] = np.concatenate([[0], np.cumsum(off)]).astype(np.int32)
        count = self.levels[depth]
        return lo + count[hi] - count[lo]


def prefix_links(fps: DataFrame, errors: int, subtree: int) -> DataFrame:
    """Spanning links ``a, b`` of the distinct fingerprints ``fp`` within ``errors`` bits."""
    depth = max(0, math.ceil(math.log2(max(1, fps.count()) / subtree)))
    # Differences of prefixes within the budget; each unordered pair of subtrees is one group.
    masks = [m for m in range(1 << depth) if m.bit_count() <= errors] if depth else [0]
    prefix = F.shiftrightunsigned("fp", 64 - depth) if depth else F.lit(0).cast("long")
    near = fps.select("fp", prefix.alias("own")).withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))))
    other = F.col("own").bitwiseXOR(F.col("mask"))
    near = near.select("fp", "own", F.least("own", other).alias("low"), F.greatest("own", other).alias("high"))

    def run(key, table):
        low, high = key[0].as_py(), key[1].as_py()
        fp, own = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy()
        left = np.sort(fp[own == low])
        if low == high:
            forest, values = Forest(len(left)), left
            walk(left, left, errors, forest.join, same=True)
        else:
            right = np.sort(fp[own == high])
            forest, values = Forest(len(left) + len(right)), np.concatenate([left, right])
            walk(left, right, errors, lambda i, j: forest.join(i, j + len(left)))
        links = np.array(forest.links, np.int64).reshape(-1, 2)
        return pa.table({"a": values[links[:, 0]].view(np.int64), "b": values[links[:, 1]].view(np.int64)})

    return near.groupBy("low", "high").applyInArrow(run, "a long, b long")


def grouped(marked: DataFrame, errors: int, subtree: int) -> DataFrame:
    """``_class, component`` (a fingerprint of the group) of each fingerprint ``_fp`` of the staged rows."""
    distinct = stage(marked.select("_fp").distinct(), "simhash-classes")
    linked = components(prefix_links(distinct.select(F.col("_fp").alias("fp")), errors, subtree))
    classes = distinct.join(linked, F.col("_fp") == F.col("node"), "left")
    return stage(classes.select(F.col("_fp").alias("_class"), F.coalesce("component", "_fp").alias("component")), "simhash-components")


def near_duplicates(
    docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE, subtree: int = SUBTREE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Input columns but the text, with ``fingerprint`` (16 hex digits) and ``component_id``."""
    marked = stage(carry(fingerprints(docs, text, shingle), doc_id, "fp").withColumnRenamed(f"_{doc_id}", "_id"), "simhash")
    groups = grouped(marked, errors, subtree)
    least = marked.groupBy("_fp").agg(F.min("_id").alias("least")).join(groups, F.col("_fp") == F.col("_class"))
    ids = stage(least.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ids")
    labels = groups.join(ids, "component").select("_class", "component_id")
    rows = marked.join(labels, F.col("_fp") == F.col("_class"))
    made = {"fingerprint": F.lpad(F.lower(F.hex("_fp")), 16, "0"), "component_id": F.col("component_id")}
    return rows.select(*outputs([c for c in docs.columns if c != text], made))


def keep_first(
    docs: DataFrame, errors: int = ERRORS, shingle: int = SHINGLE, subtree: int = SUBTREE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One row of each group, that of the least id (null last; of repeated ids any one), with the input columns."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), docs[doc_id].alias("_id"), docs[text].alias("_text"))
    marked = fingerprints(packed, "_text", shingle).withColumnRenamed("fp", "_fp")
    # Written with a number per row, so that later reads agree on it.
    marked = stage(marked.withColumn("_n", F.monotonically_increasing_id()), "simhash-rows")
    first = F.struct(F.col("_id").isNull(), "_id", "_n")
    best = marked.groupBy("_fp").agg(F.min(first).alias("first")).join(grouped(marked, errors, subtree), F.col("_fp") == F.col("_class"))
    kept = best.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first._n").alias("_n"))
    return marked.join(kept, "_n", "left_semi").select("_doc.*")
