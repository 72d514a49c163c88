"""Quality classifier by Bradley-Terry pairwise ranking.

A text's strength is linear in measures of its bytes, words and lines. Of two
texts the one with label 1 is preferred with the logistic probability of the
difference of their strengths, so the weights are learned from preference pairs
by logistic loss on feature differences; there is no intercept. The threshold is
the quantile of the training strengths that leaves the share of label 0 below
it. Scores are the logistic function of the distance to it, shifted so that the
threshold is the score ``CUT``.

The model is fitted on at most ``SAMPLE`` labelled documents, chosen by a hash of
the id among those that the table has; each meets ``PAIRS`` documents of the
other label. Only their measures (a bounded matrix) reach the driver. All
documents are scored, as a whole, in the tasks that read them.

Defined results: a null text is empty and both are scored like any text; labels
that are null are not used; of several labels of an id the highest counts, of
several texts the least; without documents of both labels every score is 0.5;
each input row gives one output row; an input column named like an output is
replaced; no rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs, stage, sub_batches

SAMPLE, PAIRS = 20_000, 8
CUT, RIDGE, STEPS = 0.3, 1.0, 50
CLIP = 5.0

# ASCII punctuation whose shares are measured, and marks that end a sentence.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOPS = (".", "!", "?")
# A share above this is also a measure of its own.
MUCH = 0.05


def measures(texts: list[str | None]) -> np.ndarray:
    """One row per text: sizes, shares of kinds of bytes, repeated words and lines, ends of lines."""
    out = []
    for text in texts:
        text = text or ""
        raw = np.frombuffer(text.encode(), np.uint8)
        share = np.bincount(raw, minlength=256) / max(1, len(raw))
        words, lines = text.split(), [x for x in map(str.strip, text.split("\n")) if x]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n_words, n_lines = max(1, len(words)), max(1, len(lines))
        kinds = [
            share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum(), share[[9, 10, 13, 32]].sum(),
            1 - len(set(lines)) / n_lines, 1 - len(set(words)) / n_words, sum(x.endswith(STOPS) for x in lines) / n_lines,
        ]
        grown = [len(raw), len(words), len(lines), len(words) / n_lines, sizes.mean() if len(sizes) else 0, sizes.max(initial=0)]
        out.append([*np.log1p(grown), *kinds, *(k > MUCH for k in kinds), *share[list(MARKS.encode())]])
    return np.array(out, np.float64).reshape(len(texts), -1)


@dataclass
class Ranking:
    """Weights of the standardised measures and the threshold strength."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        # Row by row: a matrix product rounds a row by its place in the batch.
        return (np.clip((x - self.middle) / self.scale, -CLIP, CLIP) * self.weights).sum(axis=1)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Scores between 0 and 1, ``CUT`` at the threshold."""
        if not self.weights.any():
            return np.full(len(texts), 0.5)
        shifted = self.strengths(measures(texts)) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(shifted, -700, 700)))


def learn(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights of least logistic loss over preference pairs with a ridge, by Newton steps that must not lose."""
    d = better - worse
    w = np.zeros(d.shape[1])
    loss = lambda w: np.logaddexp(0, -(d @ w)).sum() + ridge * (w @ w) / 2
    value = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -700, 700)))
        gradient = ridge * w - d.T @ p
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w)), gradient)
        size = 1.0
        while loss(w - size * step) > value and size > 1e-6:
            size /= 2
        w, before, value = w - size * step, value, loss(w - size * step)
        if before - value <= 1e-9 * before:
            break
    return w


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 11) -> Ranking:
    """Ranking from measures and 0/1 labels; each text meets ``pairs`` texts of the other label."""
    middle, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.clip((x - middle) / scale, -CLIP, CLIP)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    better = np.concatenate([np.repeat(good, pairs), rng.choice(good, pairs * len(bad))])
    worse = np.concatenate([rng.choice(bad, pairs * len(good)), np.repeat(bad, pairs)])
    ranking = Ranking(middle, scale, learn(z[better], z[worse]), 0.0)
    strengths = np.sort(ranking.strengths(x))
    at = len(bad)
    ranking.threshold = float((strengths[at - 1] + strengths[at]) / 2)
    return ranking


def fit(
    docs: DataFrame, labels: DataFrame, train: Column | None = None, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id", label: str = "quality"
) -> Ranking:
    """Learn from at most ``sample`` labelled documents, of label rows for which ``train`` holds."""
    marked = labels if train is None else labels.filter(train)
    marked = marked.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    rows = carry(docs, text, doc_id).select(F.col(f"_{doc_id}").alias("_doc"), F.coalesce(f"_{text}", F.lit("")).alias("_text"))
    there = marked.join(rows.select("_doc"), F.col("_id") == F.col("_doc"), "left_semi")
    chosen = stage(there.orderBy(F.xxhash64("_id"), "_id").limit(sample), "ranking-sample")
    # At most ``sample`` rows; of an id with several texts the least is kept.
    rows = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))

    def run(batches):
        for batch in sub_batches(batches, "_text"):
            x = measures(batch.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y").cast(pa.float64()), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    data = rows.mapInArrow(run, f"id {kind}, y double, x array<double>").orderBy("id").toArrow()
    y = data.column("y").to_numpy()
    if not (y == 0).any() or not (y == 1).any():
        width = measures([""]).shape[1]
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    return fit_ranking(np.asarray(data.column("x").combine_chunks().flatten()).reshape(len(y), -1), y)


def score(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """Input columns with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranking)  # a few hundred numbers
    df = carry(docs, text)

    def run(batches):
        for batch in sub_batches(batches, f"_{text}"):
            scores = shared.value.predict(batch.column(f"_{text}").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(scores)], names=["_row", "score"])

    scored = df.mapInArrow(run, f"_row {df.schema['_row'].dataType.simpleString()}, score double")
    made = {"score": F.col("score"), "predicted": (F.col("score") >= F.lit(CUT)).cast("int")}
    return scored.select(*outputs(docs.columns, made))
