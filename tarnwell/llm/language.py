"""Language identification by error-correcting output codes.

Every language has a codeword of -1 and +1. One binary classifier over hashed
byte n-grams is fitted for each place of the codewords; a text gets the language
whose codeword has the least logistic loss against the classifiers' outputs, and
is flagged as ambiguous if the runner-up comes close.

Every language of the labels gets a codeword. The classifiers are fitted on a bounded sample by a hash of the id:
`most_per_language` labelled documents of each language, fewer if they would be over `most_rows` in all, but
`least_per_language` at least. Only the tables of languages and codewords grow, with the number of languages.
Predictions read whole texts of all documents, very long ones piece by piece.

Edge cases: null texts and texts without a letter are `und` with score 0; with
no labelled document at all everything is `und`; one language is predicted for
all; a null id counts as held out of training but is not reported as held_out;
repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_fraction, id_remainder, raw_bytes, table
from ._features import hashed_ngrams, root_share

DIMS = 2048
UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def features(text: bytes) -> np.ndarray:
    """Shares of byte 2- and 3-grams of a whole text, with words set off by spaces."""
    padded = b" " + text + b" "
    third = DIMS // 4
    return np.concatenate([root_share(hashed_ngrams(padded, 2, third)), root_share(hashed_ngrams(padded, 3, DIMS - third))])


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and +1: all dichotomies for up to 5 languages, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 5:
        columns = [(1, *c) for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, dtype=np.float64).T
    rng = np.random.default_rng(seed)
    width, best, found = int(np.ceil(12 * np.log2(n))), -1, None
    for _ in range(max(4, min(200, 40_000 // n))):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        gap = (width - (code @ code.T - 2 * width * np.eye(n)).max()) / 2
        if gap > best and (np.abs(code.sum(0)) < n).all():
            best, found = gap, code
    return found


def _fit(x: np.ndarray, bits: np.ndarray, weight: np.ndarray, steps: int = 150, rate: float = 0.3, decay: float = 1e-5) -> np.ndarray:
    """Logistic classifiers for all places of the code at once, by Adam on the whole sample; the last row holds the intercepts."""
    w = np.zeros((x.shape[1] + 1, bits.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x @ w[:-1] + w[-1]
        off = ((-bits / (1 + np.exp(np.clip(bits * z, -30, 30)))) * weight[:, None]).astype(np.float32)
        g = np.concatenate([x.T @ off, off.sum(0, keepdims=True)]) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _vectors(batches):
    for batch in batches:
        vectors = [features(t or b"").tobytes() for t in raw_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.binary())], names=["label", "x"])


def fit_languages(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_per_language: int = 800, least_per_language: int = 8, most_rows: int = 12_000
) -> dict:
    """Codewords and weights, from a sample of labelled documents of bounded size."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    counts = labelled.groupBy("label").count().collect()  # one row a language
    langs = sorted(r["label"] for r in counts)
    if not langs:
        return {"langs": [], "code": codewords(0), "w": np.zeros((DIMS + 1, 0), np.float32)}
    take = max(least_per_language, min(most_per_language, most_rows // len(langs)))
    shares = labelled.sparkSession.createDataFrame([(r["label"], min(1.0, take / r["count"])) for r in counts], "label string, share double")
    sample = labelled.join(shares, "label").filter(hash_fraction(F.lit("lang"), "_id") < F.col("share")).select("label", "text")
    # many rows of one id are all in or out: the limit bounds them
    rows = sample.mapInArrow(_vectors, "label string, x binary").limit(2 * take * len(langs)).toArrow()
    number = {v: k for k, v in enumerate(langs)}
    y = np.array([number[v] for v in rows.column("label").to_pylist()], dtype=np.int64)
    code = codewords(len(langs))
    if not len(y):
        return {"langs": [], "code": codewords(0), "w": np.zeros((DIMS + 1, 0), np.float32)}
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(y), -1)
    order = np.lexsort((x[:, 1], x[:, 0], y))  # the same model whatever order the rows arrive in
    x, y = x[order], y[order]
    weight = (1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1))[y]
    return {"langs": langs, "code": code, "w": _fit(x, code[y], weight / weight.sum())}


def predict_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", margin: float = 0.2) -> DataFrame:
    """doc id, lang_pred, score (0 to 1) and ambiguous for every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    langs, code, w = model["langs"], model["code"], model["w"]

    def predict(batches):
        for batch in batches:
            texts = raw_bytes(batch.column(1))
            names, scores, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if langs and t and has_letter(t)]
            for first in range(0, len(known), 512):
                some = known[first : first + 512]
                z = np.stack([features(texts[k]) for k in some]) @ w[:-1] + w[-1]
                loss = np.logaddexp(0, -z[:, None, :] * code[None]).sum(2)  # loss-weighted decoding
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
                top = np.sort(p, axis=1)
                for j, k in enumerate(some):
                    names[k] = langs[int(p[j].argmax())]
                    scores[k] = top[j, -1]
                    unsure[k] = len(langs) > 1 and top[j, -1] - top[j, -2] < margin
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(scores), pa.array(unsure)], names=[id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col).mapInArrow(predict, f"`{id_col}` {id_type}, lang_pred string, score double, ambiguous boolean")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_languages(docs.filter(id_remainder("doc_id", 4) != 2))
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return predict_languages(docs, model).select("doc_id", held_out, "lang_pred", "score", "ambiguous")
