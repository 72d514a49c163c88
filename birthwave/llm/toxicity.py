"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: the model of each sees the
words of a text and the probabilities of the categories before it. In training
these are out-of-fold probabilities, so a later model sees what it will get.

The models are fitted on at most ``SAMPLE`` labelled documents, chosen by a hash
of the id among those that the table has, and use the ``FEATURES`` words that tell the categories apart best;
only these bounded tables reach the driver. Word counts of the sample are a
Spark aggregation, and all documents are scored in the tasks that read them.

Where a table has one toxicity label, ``seeded`` makes categories of it: a toxic
document is of a kind if it has a word of the kind's list.

Defined results: a null or empty text has no words and gets the models'
intercepts; labels that are null count as 0 and labels of unknown ids are not
used; of several labels of an id the highest counts, of several texts the
least; without labelled documents all probabilities are 0; each input row gives
one output row; an input column named like an output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, outputs, stage, sub_batches

SAMPLE, FEATURES, FOLDS = 8_000, 1_000, 5
RIDGE, STEPS = 1.0, 300
WORD = re.compile(r"[^\W\d_]+")

# Words that name a person, and words that judge.
INSULTS = ("idiot", "clown", "loser", "moron", "scum")
CONTEMPT = ("trash", "pathetic", "disgusting", "worthless", "stupid")


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Chain:
    """Fitted models in chain order; each has weights of the words, of the earlier categories, and an intercept."""

    categories: list[str]
    vocabulary: dict[str, int]
    weights: list[np.ndarray]
    cuts: list[float]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities, a row per text and a column per category."""
        found = [sorted(self.vocabulary[w] for w in words_of(t).intersection(self.vocabulary)) for t in texts]
        x = Sparse.of(found, len(self.vocabulary))
        out = np.zeros((len(texts), 0))
        for w in self.weights:
            out = np.column_stack([out, probability(x.with_dense(out), w)])
        return out


@dataclass
class Sparse:
    """Ones of a 0/1 matrix, with dense columns behind them."""

    rows: np.ndarray
    columns: np.ndarray
    shape: tuple[int, int]
    dense: np.ndarray

    @staticmethod
    def of(lists: list[list[int]], width: int) -> Sparse:
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.int64, int(lengths.sum()))
        return Sparse(np.repeat(np.arange(len(lists)), lengths), flat, (len(lists), width), np.ones((len(lists), 1)))

    def with_dense(self, more: np.ndarray) -> Sparse:
        return Sparse(self.rows, self.columns, self.shape, np.column_stack([np.ones(self.shape[0]), more]))

    def take(self, mask: np.ndarray) -> Sparse:
        place, keep = np.cumsum(mask) - 1, mask[self.rows]
        return Sparse(place[self.rows[keep]], self.columns[keep], (int(mask.sum()), self.shape[1]), self.dense[mask])

    def dot(self, w: np.ndarray) -> np.ndarray:
        n, m = self.shape
        return np.bincount(self.rows, w[: m][self.columns], n) + self.dense @ w[m:]

    def dot_transposed(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.columns, r[self.rows], self.shape[1]), self.dense.T @ r])


def probability(x: Sparse, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.dot(w), -30, 30)))


def fit_linear(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge on all but the intercept, by accelerated gradient steps."""
    width = x.shape[1] + x.dense.shape[1]
    v = np.full(width, 1 / np.sqrt(width))
    for _ in range(20):  # largest curvature
        v = x.dot_transposed(x.dot(v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    ridge = np.full(width, RIDGE)
    ridge[x.shape[1]] = 1e-6
    step = 1 / (0.25 * top + RIDGE)
    w = z = np.zeros(width)
    t = 1.0
    for _ in range(STEPS):
        new = z - step * (x.dot_transposed(probability(x, z) - y) + ridge * z)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """Cut with the best F1 on out-of-fold probabilities, midway to the next lower probability."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 1.0
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float((p[order[k]] + below) / 2)


def fit_chain(categories: list[str], vocabulary: list[str], found: list[list[int]], y: np.ndarray, fold: np.ndarray) -> Chain:
    x, earlier, weights, cuts = Sparse.of(found, len(vocabulary)), np.zeros((len(found), 0)), [], []
    for j in range(len(categories)):
        full, out = x.with_dense(earlier), np.zeros(len(found))
        for k in np.unique(fold):
            out[fold == k] = probability(full.take(fold == k), fit_linear(full.take(fold != k), y[fold != k, j]))
        weights.append(fit_linear(full, y[:, j]))
        cuts.append(best_cut(out, y[:, j]))
        earlier = np.column_stack([earlier, out])
    return Chain(categories, {w: i for i, w in enumerate(vocabulary)}, weights, cuts)


def seeded(text: Column, toxic: Column) -> dict[str, Column]:
    """Categories of labelled documents in chain order, the given label last."""
    has = lambda words: F.lower(text).rlike(rf"\b({'|'.join(words)})\b")
    return {"insult": (toxic == 1) & has(INSULTS), "contempt": (toxic == 1) & has(CONTEMPT), "toxic": toxic == 1}


def fit(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES,
    text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    marked = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.coalesce(F.col(label), F.lit(0))).alias("_y"))
    rows = carry(docs, text, doc_id).select(F.col(f"_{doc_id}").alias("_doc"), F.coalesce(f"_{text}", F.lit("")).alias("_text"))
    there = marked.join(rows.select("_doc"), F.col("_id") == F.col("_doc"), "left_semi")
    chosen = stage(there.orderBy(F.xxhash64("_id"), "_id").limit(sample), "toxicity-sample")
    # At most ``sample`` rows; of an id with several texts the least is kept.
    rows = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
    kinds = seeded(F.col("_text"), F.col("_y"))
    rows = rows.select("_id", "_text", *(v.cast("int").alias(k) for k, v in kinds.items()))
    names = list(kinds)

    def run(batches):
        for batch in sub_batches(batches, "_text"):
            words = pa.array([sorted(words_of(t)) for t in batch.column("_text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("_id", *names)] + [words], names=["_id", *names, "words"])

    kind = rows.schema["_id"].dataType.simpleString()
    rows = stage(rows.mapInArrow(run, f"_id {kind}, {', '.join(f'{n} int' for n in names)}, words array<string>"), "toxicity-words")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).first()
    if not totals["n"]:
        return Chain(names, {}, [np.array([-30.0] + [0.0] * j) for j in range(len(names))], [1.0] * len(names))
    counts = rows.select(F.explode("words").alias("word"), *names).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *(F.sum(n).alias(n) for n in names))
    counts = counts.filter("df >= 3")
    # Chi-square of word against category, the best over the categories.
    chi = [
        (F.col(n) * totals["n"] - F.col("df") * totals[n]) ** 2 / (F.col("df") * (totals["n"] - F.col("df") + 1.0))
        for n in names if 0 < totals[n] < totals["n"]
    ]
    best = F.greatest(*chi, F.lit(0.0)) if chi else F.lit(0.0)
    vocabulary = [r["word"] for r in counts.orderBy(best.desc(), "word").select("word").limit(features).collect()]
    place = {w: i for i, w in enumerate(vocabulary)}
    listed = F.array_intersect("words", F.array(*(F.lit(w) for w in vocabulary)).cast("array<string>"))
    data = rows.select(*names, F.pmod(F.xxhash64("_id"), F.lit(FOLDS)).alias("fold"), listed.alias("words"), "_id").orderBy("_id", "words").collect()
    found = [sorted(place[w] for w in r["words"]) for r in data]
    y = np.array([[r[n] for n in names] for r in data], np.float64)
    return fit_chain(names, vocabulary, found, y, np.array([r["fold"] for r in data]))


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """Input columns with ``p_<category>`` of each category and ``is_toxic`` by the last one's cut."""
    names = [f"p_{c}" for c in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # of a bounded size
    df = carry(docs, text)

    def run(batches):
        for batch in sub_batches(batches, f"_{text}"):
            p = shared.value.predict(batch.column(f"_{text}").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(p[:, j]) for j in range(p.shape[1]))], names=["_row", *names])

    row = df.schema["_row"].dataType.simpleString()
    scored = df.mapInArrow(run, f"_row {row}, {', '.join(f'{n} double' for n in names)}")
    made = {n: F.col(n) for n in names} | {"is_toxic": F.col(names[-1]) >= F.lit(chain.cuts[-1])}
    return scored.select(*outputs(docs.columns, made))
