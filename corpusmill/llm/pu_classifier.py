"""Quality classifier by positive-unlabelled learning.

A logistic model is fitted by the non-negative unbiased risk
    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])
on trusted positives P (labels with quality 1), unlabelled web text U (any documents, labels unread)
and a class prior, the share of positives in the unlabelled text. Negative labels are never read. The prior is
estimated from P and U alone: a first model tells P from U on half of the sample; in the scores of the other
half, the share of U above a threshold divided by the share of P above it is at least the prior, and comes
down to it where hardly any negative scores so high. The threshold is that with the least upper confidence
bound of this ratio (best bin estimation).
Labels are read only from rows whose crc32(doc_id) mod 4 is not 2.

The fit uses a bounded sample, at most P_ROWS and U_ROWS rows, the first in a hash order of doc_id; a row that
repeats with its text counts once. The bounds are parameters and don't depend on the size of the corpus: one
task holds as many feature vectors of 4 kB and fits, and the driver gets the model. Scoring covers every whole text.
Inputs of a score come from the text alone: frequencies of character-class trigrams and a few
statistics of its words and lines, so a text costs one pass and the model is about a thousand numbers,
which is all that travels to the executors. Scoring has no shuffle.

Null and empty texts have the feature vector of an empty text. Rows without doc_id are not held out and
never in the sample. Without positive labels or documents, every score is 0.5. Repeated rows repeat their score; very
long texts are read whole, one in memory at a time. Empty tables give empty results. Other columns stay as they
are in accepted, whatever their names; scored replaces a column named score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import words_of

P_ROWS, U_ROWS, ROUNDS = 6_000, 12_000, 400
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
CLASSES = 10
N_STATS = 12
N_FEATURES = CLASSES**3 + N_STATS


def _class_table() -> np.ndarray:
    table = np.full(0x3000, 9, np.uint8)
    for i in range(len(table)):
        c = chr(i)
        if c in "\n\r\x0b\x0c":
            k = 4
        elif c.isspace():
            k = 3
        elif c.isdigit():
            k = 2
        elif c.isupper():
            k = 1
        elif c.isalpha():
            k = 0
        elif c in ".,;:?'\"()-":
            k = 5
        elif c == "!":
            k = 6
        elif c == "|":
            k = 7
        elif c in "#*$%&<>@^~=+_/\\{}[]":
            k = 8
        else:
            k = 9
        table[i] = k
    return table


_TABLE = _class_table()


def features(text: str | None) -> np.ndarray:
    """Float32 vector of a whole text."""
    out = np.zeros(N_FEATURES, np.float32)
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _TABLE[np.minimum(codes, len(_TABLE) - 1)].astype(np.int32)
    padded = np.concatenate(([4], kinds, [4]))
    grams = np.bincount((padded[:-2] * CLASSES + padded[1:-1]) * CLASSES + padded[2:], minlength=CLASSES**3)
    out[: CLASSES**3] = np.sqrt(grams / max(len(codes), 1))
    words = words_of(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    stats = out[CLASSES**3 :]
    stats[0] = np.log1p(n) / 5
    stats[1] = n == 0
    stats[2] = len(set(words)) / max(n, 1)
    stats[3] = sum(a == b for a, b in zip(words, words[1:])) / max(n - 1, 1)
    stats[4] = len(set(lines)) / max(len(lines), 1)
    stats[5] = min(len(codes) / max(n, 1), 50) / 10
    stats[6] = np.log1p(len(lines)) / 3
    stats[7] = n < 20
    share = np.bincount(kinds, minlength=CLASSES)[:CLASSES] / max(len(codes), 1)
    stats[8], stats[9], stats[10], stats[11] = share[1], share[8] + share[7], share[6], share[2]
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class Model:
    """score = sigmoid((x - mean) / scale . weights + bias)."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS, decay: float = 1e-3, rate: float = 0.02, plain: bool = False) -> Model:
    """Minimise the non-negative risk by Adam over the whole sample.

    Where the negative part falls below zero, its gradient is followed upwards instead, as the
    estimator prescribes, so that the fit can't gain by memorising unlabelled rows. plain: tell P from U instead,
    with equal weight, as the estimate of the prior needs.
    """
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / n
    square = sum(np.einsum("ij,ij->j", a, a, dtype=np.float64) for a in (positive, unlabelled)) / n
    mean, scale = mean.astype(np.float32), (np.sqrt(np.maximum(square - mean**2, 0)) + 1e-3).astype(np.float32)
    p, u = positive - mean, unlabelled - mean
    for a in (p, u):  # in place: the sample is large
        a /= scale
        np.clip(a, -8, 8, out=a)
    w, bias = np.zeros(len(mean), np.float32), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        zp, zu = p @ w + bias, u @ w + bias
        # loss(+) = log(1 + e^-z), loss(-) = log(1 + e^z); d loss(+) = sigmoid(z) - 1, d loss(-) = sigmoid(z)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_plus, gp_minus, gu_minus = prior * (sp - 1) / len(p), prior * sp / len(p), su / len(u)
        if plain:
            gp, gu = (sp - 1) / len(p), su / len(u)
        elif negative >= 0:
            gp, gu = gp_plus - gp_minus, gu_minus
        else:
            gp, gu = gp_minus, -gu_minus
        grad = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w, gp.sum() + gu.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1].astype(np.float32)
        bias -= float(move[-1])
    return Model(mean, scale, w.astype(np.float64), bias)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives among unlabelled rows, from the scores of both: best bin estimation."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    p, u = np.sort(positive), np.sort(unlabelled)
    at = np.unique(p)
    above_p = 1 - np.searchsorted(p, at, "left") / len(p)
    above_u = 1 - np.searchsorted(u, at, "left") / len(u)
    slack = np.sqrt(np.log(4 / delta) / (2 * len(u))) + np.sqrt(np.log(4 / delta) / (2 * len(p)))
    best = np.argmin(above_u / above_p + (1 + gamma) / above_p * slack)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, p_place: np.ndarray, u_place: np.ndarray, rounds: int = ROUNDS // 4) -> float:
    """The prior by a model of half of the rows on the other half. A row's place tells its half, so what is in both P and U is in one half."""
    p_half, u_half = ((place >> 7) & 1 == 1 for place in (p_place, u_place))
    if min(x.sum() for half in (p_half, u_half) for x in (half, ~half)) < 4:
        return 0.5
    model = fit(positive[p_half], unlabelled[u_half], 0.5, rounds, decay=0.03, plain=True)
    return class_prior(model.scores(positive[~p_half]), model.scores(unlabelled[~u_half]))


def fitted(x: np.ndarray, is_p: np.ndarray, place: np.ndarray, prior: float | None) -> Model | None:
    """The model of a sample of feature vectors; none without positives or without unlabelled rows."""
    if not is_p.any() or is_p.all():
        return None
    # a defined order, so that sums and with them the fit don't depend on how tasks ended
    order = np.argsort(place, kind="stable")
    p_at, u_at = order[is_p[order]], order[~is_p[order]]
    positive, unlabelled = x[p_at], x[u_at]
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled, place[p_at], place[u_at]) if prior is None else prior)


def _models(batches: Iterator[pa.RecordBatch], prior: float | None) -> Iterator[pa.RecordBatch]:
    """The one model of all rows of the sample."""
    held = []
    for batch in batches:
        x = np.zeros((batch.num_rows, N_FEATURES), np.float32)
        for i, text in enumerate(batch.column("text").to_pylist()):
            x[i] = features(text)
        held.append((x, batch.column("positive").to_numpy(zero_copy_only=False), batch.column("place").to_numpy()))
    if held and (model := fitted(*(np.concatenate(c) for c in zip(*held)), prior)):
        parts = [pa.array([a.tobytes()], pa.binary()) for a in (model.mean, model.scale, model.weights)]
        yield pa.RecordBatch.from_arrays([*parts, pa.array([model.bias], pa.float64())], ["mean", "scale", "weights", "bias"])


def sample(docs: DataFrame, labels: DataFrame, p_rows: int, u_rows: int) -> DataFrame:
    """positive, place (a hash order), text: at most p_rows trusted positives and u_rows unlabelled rows of the training folds."""
    order = F.xxhash64("doc_id")
    fold = labels.where(~held_out() & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    mine = docs.select("doc_id", "text").where(~held_out() & F.col("doc_id").isNotNull())
    parts = []
    for positive, ids, most in ((True, fold, p_rows), (False, mine, u_rows)):
        first = ids.select("doc_id").distinct().orderBy(order, "doc_id").limit(most)  # bounded, so it may be broadcast
        rows = mine.join(F.broadcast(first), "doc_id").groupBy("doc_id", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))
        parts.append(rows.orderBy(order, "doc_id", "key").limit(most).select(F.lit(positive).alias("positive"), F.xxhash64("doc_id", "key").alias("place"), "text"))
    return parts[0].unionByName(parts[1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, p_rows: int = P_ROWS, u_rows: int = U_ROWS, prior: float | None = None) -> Model:
    """Fit on a bounded sample of whole texts, in one task; only the model reaches the driver. prior: where it is known."""
    rows = sample(docs, labels, p_rows, u_rows).coalesce(1)
    found = rows.mapInArrow(lambda batches: _models(batches, prior), "mean binary, scale binary, weights binary, bias double").collect()
    if not found:
        flat = np.zeros(N_FEATURES)
        return Model(flat, flat + 1, flat, 0.0)
    mean, scale, weights, bias = found[0]
    return Model(np.frombuffer(mean, np.float32), np.frombuffer(scale, np.float32), np.frombuffer(weights, np.float64), bias)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and score, without a shuffle."""
    docs = docs.drop("score")
    names = list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            parts = [model.scores(np.stack([features(t) for t in texts[i : i + 512]])) for i in range(0, len(texts), 512)]
            found = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    found = scored(docs.select("doc_id", "text"), train(spark, docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier does not reject, with their own columns."""
    model, kind = train(spark, docs, labels), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [model.scores(features(t)[None])[0] >= THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, kind)
