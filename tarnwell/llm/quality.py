"""Quality classifier from trusted positives and unlabelled text.

A linear scorer over text features is fitted by minimising the non-negative
unbiased risk: pi * R_P(+) + max(0, R_U(-) - pi * R_P(-)), where P are trusted
good documents, U is unlabelled web text and pi is the share of good text in U. That share is
estimated from P and U alone: a classifier of P against U is fitted on one half of both, and on the other
half the share of U over that of P above a threshold, at the threshold with the least upper confidence bound, is
an estimate of pi (no threshold of a set of good documents can hold less than pi times their share of U). With the
logistic loss the scores are probabilities of good text themselves. Labels of bad text are not used.

The fit uses bounded samples by a hash of the id (`most_positive` trusted
documents, `most_unlabelled` others); scoring reads whole texts of all documents, very long ones piece by piece.

Edge cases: null and empty texts get the prior as score, and texts of few words lean to it; ids
labelled both ways are left out of the fit, repeated equal labels count once;
without a positive label every score is 0.5; repeated rows each give a
row; an empty table gives an empty result; extra columns are kept by drop_low_quality() and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_fraction, id_remainder, raw_bytes, table
from ._features import hashed_ngrams, root_share, shape_ngrams

THRESHOLD = 0.3
#: Words at which the text and the prior count alike.
LEAN = 4.0
_SHAPES, _TRIGRAMS = 512, 256


def features(text: bytes) -> np.ndarray:
    """Shape and byte n-gram shares of a whole text, and a few statistics of its words and characters."""
    b = np.frombuffer(text, dtype=np.uint8)
    n = max(1, len(b))
    words = text.split()
    w = max(1, len(words))
    kinds = len(set(words))
    again = sum(x == y for x, y in zip(words, words[1:]))
    byte = np.bincount(b, minlength=256)
    letters = max(1, byte[65:91].sum() + byte[97:123].sum() + byte[128:].sum())
    stats = [
        again / w,
        kinds / w,
        np.log1p(w / max(1, kinds)),
        byte[65:91].sum() / letters,
        byte[48:58].sum() / n,
        (byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()) / n,
        (byte[32] + byte[9:14].sum()) / n,
        np.log1p(n) / 10,
        np.log1p(n / w) / 3,
        1.0 if len(words) else 0.0,
    ]
    return np.concatenate([root_share(shape_ngrams(text, 3, _SHAPES)), root_share(hashed_ngrams(text, 3, _TRIGRAMS)), np.array(stats, np.float32)])


def _vectors(batches):
    for batch in batches:
        vectors = [features(t or b"").tobytes() for t in raw_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["label", "x"])


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels and features of a sample of at most so many rows, in an order that does not depend on the tasks."""
    got = rows.mapInArrow(_vectors, "label int, x binary").limit(most).toArrow()
    y = np.array(got.column("label").to_pylist(), dtype=np.int64)
    if not len(y):
        return y, np.zeros((0, 0), np.float32)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), -1)
    order = np.lexsort((x[:, 2], x[:, 1], x[:, -3], y))
    return y[order], x[order]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _positive_against_all(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier of trusted against unlabelled rows, both sides weighing alike."""
    w, b = np.zeros(positive.shape[1], np.float32), 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gp, gu = (_sigmoid(positive @ w + b) - 1) / len(positive), _sigmoid(unlabelled @ w + b) / len(unlabelled)
        g = (gp @ positive + gu @ unlabelled + decay * w).astype(np.float32)
        b -= rate * float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, slack: float = 0.01) -> float:
    """The share of good text in the unlabelled rows, from trusted and unlabelled rows alone."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return 0.5
    found = []
    for k in (0, 1):
        w = _positive_against_all(positive[k::2], unlabelled[k::2])
        zp, zu = np.sort(positive[1 - k :: 2] @ w), np.sort(unlabelled[1 - k :: 2] @ w)
        above_p = 1 - np.searchsorted(zp, zp) / len(zp)
        above_u = 1 - np.searchsorted(zu, zp) / len(zu)
        doubt = (1 + slack) * (np.sqrt(np.log(4 / delta) / (2 * len(zu))) + np.sqrt(np.log(4 / delta) / (2 * len(zp))))
        best = int(((above_u + doubt) / above_p).argmin())
        found.append(above_u[best] / above_p[best])
    return float(min(0.98, max(0.02, np.mean(found))))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1000, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the intercept) that minimise the non-negative risk with logistic loss, by Adam on the whole sample."""
    add = lambda x: np.hstack([x, np.ones((len(x), 1), np.float32)])
    p, u = add(positive), add(unlabelled)
    w = np.zeros(p.shape[1], np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_negative = u.T @ (su / len(u)) - prior * (p.T @ (sp / len(p)))
        g = prior * (p.T @ ((sp - 1) / len(p))) + g_negative if negative >= 0 else -g_negative
        g = (g + decay * w).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_positive: int = 4000, most_unlabelled: int = 8000) -> dict:
    """A scorer from the documents labelled 1; all documents, whatever their labels, are the unlabelled text."""
    rated = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("_id")
        .agg(F.min("label").alias("label"))
        .filter("label = 1")
    )
    good = rated.count()
    if not good:
        return {"w": None, "prior": 0.5}
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("_id").isNotNull())
    # ids are few after the limit, so they may be broadcast; rows of a repeated id are bounded after the features
    trusted = rated.filter(hash_fraction(F.lit("quality"), "_id") < most_positive / good).limit(2 * most_positive)
    _, p = _sample(texts.join(F.broadcast(trusted), "_id").select("label", "text"), 2 * most_positive)
    _, u = _sample(texts.filter(hash_fraction(F.lit("unlabelled"), "_id") < most_unlabelled / max(1, docs.count())).select(F.lit(0).alias("label"), "text"), 2 * most_unlabelled)
    if not len(p) or not len(u):
        return {"w": None, "prior": 0.5}
    prior = estimate_prior(p, u)
    return {"w": nn_pu(p, u, prior), "prior": prior}


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _scores(texts: list[bytes | None], model: dict) -> np.ndarray:
    """Probabilities of good text; a text of few words leans to the prior, as it shows little."""
    if model["w"] is None:
        return np.full(len(texts), model["prior"])
    out = np.empty(len(texts))
    for first in range(0, len(texts), 512):
        x = np.stack([features(t or b"") for t in texts[first : first + 512]])
        z = x @ model["w"][:-1] + model["w"][-1]
        words = x[:, -1] * np.expm1(10.0 * x[:, -3]) / np.expm1(3.0 * x[:, -2])  # from the statistics: bytes / bytes a word
        trust = words / (words + LEAN)
        out[first : first + 512] = 1 / (1 + np.exp(-np.clip(trust * z + (1 - trust) * _logit(model["prior"]), -30, 30)))
    return out


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id and score (0 to 1) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(raw_bytes(batch.column(1)), model))], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(score, f"`{id_col}` {id_type}, score double")


def drop_low_quality(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    place = docs.columns.index(text_col)

    def keep(batches):
        for batch in batches:
            good = _scores(raw_bytes(batch.column(place)), model) >= threshold
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(id_remainder("doc_id", 5) != 0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs.filter(id_remainder("doc_id", 5) != 0), training_labels(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return score_quality(docs, model).select("doc_id", held_out, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
