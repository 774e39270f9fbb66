"""Operator 5: a quality classifier by naive-Bayes-scaled support vectors. Indicators of
hashed n-grams (words and pairs of words; runs of one to three word shapes, with repeats marked) are scaled
by the log ratio of their smoothed shares in the two classes; a linear hinge-loss model
over them, rows at unit length, is fitted by dual coordinate descent. Margins become
probabilities by a logistic curve fitted on rows that the model has not seen.

The fit uses at most SAMPLE labelled rows, those whose hashed doc_id is smallest. Scores
are of whole texts and need no exchange.

Defined results. Null or empty text: the score of a margin of 0. Null doc_id: scored,
held_out is false, no label. A doc_id whose labels disagree teaches nothing. Repeated rows:
all scored alike. Labels of one class only: that class for all; no labels: 0.5. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, table
from .syncmers import mix
from .textvec import EXACT, FOLDED, SHAPE, TOKEN, join, span_hashes, spans

DIMENSIONS = 1 << 18
SAMPLE = 8000
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = 0.7
_SEED = np.uint64(0x2545F4914F6CDD1D)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Hashed n-grams of each text, with repeats."""
    data, at = join(texts)
    starts, ends = spans(data, TOKEN)
    text_of = np.searchsorted(at, starts, "right")
    word = span_hashes(FOLDED[data], starts, ends)
    exact = span_hashes(EXACT[data], starts, ends)
    kind = SHAPE[data]
    new = np.ones(len(data), bool)  # a run of one shape counts once
    new[1:] = kind[1:] != kind[:-1]
    new[starts] = True
    kept = np.cumsum(new)
    shape = span_hashes(EXACT[kind[new]], kept[starts] - 1, kept[ends - 1])
    same_text = text_of[1:] == text_of[:-1]
    pair = mix((word[:-1] + _SEED) * _SEED + word[1:])[same_text]
    repeat = np.zeros(len(word), np.uint64)
    repeat[1:] = (exact[1:] == exact[:-1]) & same_text
    one = mix(shape * np.uint64(2) + repeat)
    two = mix(one[:-1] * _SEED + one[1:])[same_text]
    same_three = same_text[1:] & same_text[:-1]
    three = mix((one[:-2] * _SEED + one[1:-1]) * _SEED + one[2:])[same_three]
    n = len(at)
    grams = np.concatenate([word, pair, one, two, three])
    owner = np.concatenate([text_of, text_of[1:][same_text], text_of, text_of[1:][same_text], text_of[2:][same_three]])
    order = np.argsort(owner, kind="stable")
    index = (grams[order] >> np.uint64(46)).astype(np.int32)  # 18 bits
    return np.split(index, np.cumsum(np.bincount(owner, minlength=n))[:-1])


def log_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log((share in class 1) / (share in class 0)) of each n-gram's indicator."""
    counts = np.zeros((2, DIMENSIONS)) + SMOOTHING
    for index, label in zip(rows, labels, strict=True):
        counts[label, index] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights over the unscaled indicators, r included. One dual variable per row; each step
    solves for one of them exactly and keeps it between 0 and its class's cost."""
    sign = np.where(labels == 1, 1.0, -1.0)
    cost = COST * len(labels) / (2 * np.bincount(labels, minlength=2).clip(1))[labels]
    values = [ratios[i] / max(np.linalg.norm(ratios[i]), 1e-12) for i in rows]
    weights, dual = np.zeros(DIMENSIONS), np.zeros(len(rows))
    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            index, x = rows[i], values[i]
            if not len(index):
                continue
            step = (1 - sign[i] * (weights[index] @ x)) / max(x @ x, 1e-12)
            now = min(max(dual[i] + step, 0.0), cost[i])
            if now != dual[i]:
                weights[index] += (now - dual[i]) * sign[i] * x
                dual[i] = now
    return weights * ratios


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, targets drawn in a little as Platt does."""
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    beta = np.array([4.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * beta)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """weights and squared log ratios by n-gram, slope and offset; scores texts."""

    def __init__(self, weights: np.ndarray, squares: np.ndarray, slope: float, offset: float):
        self.weights, self.squares, self.slope, self.offset = weights.astype(np.float32), squares.astype(np.float32), slope, offset

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        seen = np.zeros(DIMENSIONS, bool)
        out = np.zeros(len(rows))
        for i, index in enumerate(rows):
            seen[index] = True
            own = np.flatnonzero(seen) if len(index) > 20_000 else np.unique(index)
            seen[index] = False
            out[i] = self.weights[own].sum(dtype=np.float64) / max(np.sqrt(self.squares[own].sum(dtype=np.float64)), 1e-12)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(features(texts)) + self.offset, -30, 30)))


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of unique indices and labels; every fifth row only fits the curve."""
    none = np.zeros(DIMENSIONS)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6)) if len(labels) else 0.5
        return Model(none, none, 0.0, float(np.log(share / (1 - share))))
    apart = np.arange(len(rows)) % 5 == 4
    if len(set(labels[apart].tolist())) < 2 or len(set(labels[~apart].tolist())) < 2:
        apart[:] = False
    fit = np.flatnonzero(~apart)
    ratios = log_ratios([rows[i] for i in fit], labels[fit])
    model = Model(dual_coordinate_descent([rows[i] for i in fit], ratios, labels[fit]), ratios**2, 1.0, 0.0)
    judge = np.flatnonzero(apart) if apart.any() else fit
    model.slope, model.offset = logistic(model.margins([rows[i] for i in judge]), labels[judge])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most sample rows of labels (doc_id, quality) that are not held out. Only
    these, a bounded table, are broadcast to find their texts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    chosen = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, "text"):
            rows = features([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array([np.unique(r).tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "grams"])

    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
    found = met.mapInArrow(run, "doc_id long, quality int, grams binary").orderBy(F.xxhash64("doc_id"), "doc_id", "grams").limit(sample).toArrow()
    # the rows stay in Arrow's buffers, without a copy of each in the driver's Python
    return train([np.frombuffer(g.as_buffer(), np.int32) for g in found["grams"]], found["quality"].to_numpy().astype(np.int64))


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The model's score of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            groups = batched(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text")
            scores = [shared.value.scores([(t or "").encode() for t in g.column(0).to_pylist()]) for g in groups]
            yield pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())

    return run(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score at least threshold."""
    model = fit(docs, labels)
    return docs.filter(score(docs.sparkSession, model, F.col("text")) >= threshold)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
