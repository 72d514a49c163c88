"""Substring dedup: repeated word windows found through difference-cover anchors.

Of two equal windows of 13 words in any two documents, some aligned 7 words lie
at positions that are both in {0, 1, 3} modulo 7, a difference cover: these are
the anchors, three in seven of all positions. Anchors go from blocks of
documents to buckets; those that two documents share come back. A shared anchor
is extended to the windows around it, whose digests go out once more, and the
bucket answers with those that a smaller document has. See ``blocks``.

Anchors only select candidates. Windows are compared by 96 bits of digest.

Defined results: null and empty texts have no words; each input row gives one
output row; rows with one id don't remove each other's words; a null id comes
after all others; ids are integers; an input column named like an output is
replaced; no rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, U64, Layout, ids_of, mix, runs_of, texts_of, to_blocks, to_buckets, unpacked

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
MULTIPLIERS = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))


class Words:
    """Word digests of a block's documents, one after another."""

    def __init__(self, table: pa.Table):
        self.split = [t.split() for t in texts_of(table)]
        self.n = np.fromiter(map(len, self.split), np.int64, len(self.split))
        digest = xxhash.xxh64_digest
        self.hash = np.frombuffer(b"".join([digest(w) for ws in self.split for w in ws]), "<u8")
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.first = np.cumsum(self.n) - self.n
        self.at = np.arange(len(self.hash)) - np.repeat(self.first, self.n)
        self.left = np.repeat(self.n, self.n) - self.at  # words from here to the end
        self.ids = ids_of(table)

    def windows(self, width: int, multiplier: np.uint64) -> np.ndarray:
        """Digest of the ``width`` words from each position; meaningless within the last words of a document."""
        total, n = np.zeros(len(self.hash), U64), len(self.hash)
        for k in range(min(width, n)):
            total[: n - k] = total[: n - k] * multiplier + self.hash[k:]
        return mix(total)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and digests; the lowest bit is left free."""
        at = np.flatnonzero(np.isin(self.at % PERIOD, COVER) & (self.left >= ANCHOR) & (np.repeat(self.n, self.n) >= WINDOW))
        return at, self.windows(ANCHOR, MULTIPLIERS[0])[at] & ~U64(1)

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.windows(WINDOW, MULTIPLIERS[0])[at], self.windows(WINDOW, MULTIPLIERS[1])[at].astype(np.uint32)


def send_anchors(buckets: int):
    def run(key, table):
        words = Words(table)
        at, digest = words.anchors()
        order, starts, run_of = runs_of(digest)
        ids = words.ids[words.doc[at]][order]
        # The free bit tells that two documents of the block have the anchor.
        several = np.maximum.reduceat(ids, starts) > np.minimum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
        found = digest[order][starts]
        return to_buckets(key[0].as_py(), found, buckets, anchor=found | several.astype(U64))

    return run


def shared_anchors(key, table):
    value, row = unpacked(table.column("anchor"), "<u8")
    blk = table.column("blk").to_numpy()[row]
    digest = value & ~U64(1)
    order, starts, run_of = runs_of(digest)
    many = np.diff(np.concatenate([starts, [len(order)]])) > 1
    if len(starts):
        many |= np.maximum.reduceat(value[order] & U64(1), starts) == 1
    keep = order[many[run_of]]
    return to_blocks(blk[keep], anchor=digest[keep])


def candidates(words: Words, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    at, digest = words.anchors()
    hit = np.zeros(len(words.hash), bool)
    hit[at[np.isin(digest, shared)]] = True
    near = hit.copy()
    for k in range(1, PERIOD):  # an anchor k words behind the start
        near[:-k] |= hit[k:] & (words.doc[k:] == words.doc[:-k])
    return np.flatnonzero(near & (words.left >= WINDOW))


def send_windows(buckets: int):
    def run(key, table, answers):
        words = Words(table)
        shared, _ = unpacked(answers.column("anchor"), "<u8")
        at = candidates(words, shared)
        high, low = words.digests(at)
        order, starts, run_of = runs_of(high, low)
        ids = words.ids[words.doc[at]]
        least = np.minimum.reduceat(ids[order], starts) if len(starts) else ids[:0]
        first = order[starts]
        by_place = np.argsort(first)  # neighbours share their least document, which compresses well
        first, least = first[by_place], least[by_place]
        return to_buckets(key[0].as_py(), high[first], buckets, high=high[first], low=low[first], least=least)

    return run


def repeated_windows(key, table):
    """Windows of a block that a smaller document of another block has."""
    high, row = unpacked(table.column("high"), "<u8")
    low, _ = unpacked(table.column("low"), "<u4")
    least, _ = unpacked(table.column("least"), "<i8")
    blk = table.column("blk").to_numpy()[row]
    order, starts, run_of = runs_of(high, low)
    if len(starts):
        overall = np.minimum.reduceat(least[order], starts)[run_of]
        order = order[overall < least[order]]
    return to_blocks(blk[order], high=high[order], low=low[order])


def removed_words(words: Words, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Mask of the words covered by a window that a smaller document has."""
    at = np.flatnonzero(words.left >= WINDOW)
    own_high, own_low = words.digests(at)
    order, starts, run_of = runs_of(np.concatenate([own_high, high]), np.concatenate([own_low, low]))
    # An answer stands for a smaller document elsewhere; within the block the ids decide.
    ids = np.concatenate([words.ids[words.doc[at]], np.full(len(high), np.iinfo(np.int64).min)])
    repeated = np.zeros(len(ids), bool)
    if len(starts):
        repeated[order] = ids[order] > np.minimum.reduceat(ids[order], starts)[run_of]
    start = at[repeated[: len(at)]]
    step = np.zeros(len(words.hash) + WINDOW + 1, np.int64)
    step[start] += 1
    step[start + WINDOW] -= 1
    return np.cumsum(step)[: len(words.hash)] > 0


def cut(as_given: bool):
    """Remove the repeated words; with ``as_given`` a text that loses none keeps its white space."""

    def run(key, table, answers):
        words = Words(table)
        high, _ = unpacked(answers.column("high"), "<u8")
        low, _ = unpacked(answers.column("low"), "<u4")
        gone = removed_words(words, high, low)
        removed, kept = [], []
        texts = texts_of(table)
        for text, ws, first in zip(texts, words.split, words.first.tolist()):
            mask = gone[first : first + len(ws)]
            removed.append(int(mask.sum()))
            if as_given and not removed[-1]:
                kept.append(text.decode())
            else:
                kept.append(b" ".join([w for w, g in zip(ws, mask.tolist()) if not g] if removed[-1] else ws).decode())
        return pa.table({"_rest": table.column("_rest"), "n_words": words.n, "n_removed": pa.array(removed, pa.int64()), "kept_text": kept})

    return run


def dedup(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block_bytes: int = BLOCK_BYTES, as_given: bool = False
) -> DataFrame:
    """Input columns but the text, with ``n_words``, ``n_removed`` and ``kept_text`` (the kept words joined by one space)."""
    layout = Layout(docs, text, doc_id, block_bytes)
    shared = layout.answer(layout.send(send_anchors(layout.buckets), "anchor binary"), shared_anchors, "anchor binary")
    windows = layout.meet(shared, send_windows(layout.buckets), "bucket long, blk long, high binary, low binary, least binary")
    fields = "high binary, low binary"
    answers = layout.answer(windows.repartition(layout.parts, "bucket"), repeated_windows, fields)
    made = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}
    rows = layout.meet(answers, cut(as_given), layout.schema(list(made.items())))
    return rows.select(*(F.col("_rest").getField(c).alias(c) for c in layout.kept if c.lower() not in made), *made)


def keep_rest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = None, **options) -> DataFrame:
    """The input columns with the repeated words gone from the text (and the length in ``n_chars`` set);
    rows that lose all their words are dropped, rows that lose none stay as they are."""
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns if c != text)).alias("_doc"), docs[doc_id].alias("_id"), docs[text].alias("_text"))
    left = dedup(packed, "_text", "_id", as_given=True, **options).filter("n_removed = 0 OR n_removed < n_words")
    made = {c: F.col("_doc").getField(c) for c in docs.columns if c != text} | {text: F.col("kept_text")}
    if n_chars is not None:
        made[n_chars] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema[n_chars].dataType)).otherwise(made[n_chars])
    return left.select(*(made[c].alias(c) for c in docs.columns))
