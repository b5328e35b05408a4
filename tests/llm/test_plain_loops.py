"""Learned operators and searches against plain loops, at the parameters of their queries."""

import collections
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnwell.llm import embeddings, language, quality
from tarnwell.llm.queries import QUERIES
from tests.conftest import DATA
from tests.llm.test_llm import brute_components, low, words


def adam(gradient, size, steps, rate):
    """Weights after some steps of Adam, one by one."""
    w, m, v = [0.0] * size, [0.0] * size, [0.0] * size
    for t in range(1, steps + 1):
        for i, g in enumerate(gradient(w)):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return w


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def test_codeword_decoding_against_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language.fit_languages(docs.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in language.predict_languages(docs, model).collect()}
    assert len(model["langs"]) > 1 and len(got) == docs.count()
    for row in docs.collect():
        text = (row.text or "").encode()
        if not any(c.isalpha() for c in row.text or ""):
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0)
            continue
        x = language.features(text)
        z = [math.fsum(float(x[i]) * float(model["w"][i, b]) for i in np.flatnonzero(x)) + float(model["w"][-1, b]) for b in range(model["code"].shape[1])]
        loss = [math.fsum(math.log1p(math.exp(-c * y)) for c, y in zip(word, z)) for word in model["code"].tolist()]
        p = [math.exp(min(loss) - k) for k in loss]
        assert got[row.doc_id].lang_pred == model["langs"][loss.index(min(loss))]
        assert got[row.doc_id].score == pytest.approx(max(p) / sum(p), abs=1e-4)


def test_bit_classifiers_against_loops():
    rng = np.random.default_rng(8)
    x, code = rng.random((14, 3)).astype(np.float32), np.array([[1.0, 1], [1, -1], [-1, 1]])
    y = np.arange(14) % 3
    weight = np.full(14, 1 / 14)
    got = language._fit(x, code[y], weight, steps=20)
    for b in range(2):

        def gradient(w, b=b):
            off = [-code[k][b] / (1 + math.exp(code[k][b] * (sum(w[i] * float(r[i]) for i in range(3)) + w[3]))) / 14 for k, r in zip(y, x)]
            return [sum(o * (float(r[i]) if i < 3 else 1) for o, r in zip(off, x)) + 1e-5 * w[i] for i in range(4)]

        assert np.allclose(got[:, b], adam(gradient, 4, 20, 0.3), atol=5e-3)


@pytest.mark.parametrize("prior", [0.3, 0.9])
def test_non_negative_risk_against_loops(prior):
    rng = np.random.default_rng(2)
    positive, unlabelled = rng.normal(1, 1, (20, 3)).astype(np.float32), rng.normal(-0.5, 1.5, (30, 3)).astype(np.float32)
    p, u = [[*map(float, r), 1.0] for r in positive], [[*map(float, r), 1.0] for r in unlabelled]
    clipped = []

    def gradient(w):
        dot = lambda r: sum(a * b for a, b in zip(w, r))
        negative = sum(math.log1p(math.exp(dot(r))) for r in u) / 30 - prior * sum(math.log1p(math.exp(dot(r))) for r in p) / 20
        from_u = lambda i: sum(sigmoid(dot(r)) * r[i] for r in u) / 30
        from_p = lambda i, less: sum((sigmoid(dot(r)) - less) * r[i] for r in p) / 20
        clipped.append(negative < 0)
        rest = [from_u(i) - prior * from_p(i, 0) for i in range(4)]
        return [(-rest[i] if negative < 0 else prior * from_p(i, 1) + rest[i]) + 1e-4 * w[i] for i in range(4)]

    want = adam(gradient, 4, 120, 0.05)
    assert any(clipped) and not all(clipped)  # both branches are taken
    assert np.allclose(quality.nn_pu(positive, unlabelled, prior, steps=120), want, atol=2e-2)


def test_prior_against_loops():
    rng = np.random.default_rng(4)
    positive = rng.normal(1, 1, (60, 2)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1, 1, (70, 2)), rng.normal(-2, 1, (40, 2))]).astype(np.float32)
    found = []
    for k in (0, 1):
        w = quality._positive_against_all(positive[k::2], unlabelled[k::2])
        zp, zu = [float(r @ w) for r in positive[1 - k :: 2]], [float(r @ w) for r in unlabelled[1 - k :: 2]]
        doubt = 1.01 * (math.sqrt(math.log(40) / (2 * len(zu))) + math.sqrt(math.log(40) / (2 * len(zp))))
        best = None
        for cut in sorted(zp):
            a_p, a_u = sum(z >= cut for z in zp) / len(zp), sum(z >= cut for z in zu) / len(zu)
            if best is None or (a_u + doubt) / a_p < best[0]:
                best = ((a_u + doubt) / a_p, a_u / a_p)
        found.append(best[1])
    assert quality.estimate_prior(positive, unlabelled) == pytest.approx(min(0.98, max(0.02, sum(found) / 2)), abs=0.02)


def test_embedding_recall_at_the_query_s_parameters(spark):
    """Pairs from 0.9 to 0.93, just at the threshold, and pairs just below it, with the default recall."""
    rng = np.random.default_rng(12)
    rows = []
    for cosine in np.linspace(0.9003, 0.93, 400).tolist() + np.linspace(0.87, 0.8997, 100).tolist():
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [a * rng.uniform(0.5, 2), cosine * a + math.sqrt(1 - cosine**2) * b]
    unit = np.array([r / np.linalg.norm(r) for r in rows])
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    df = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert all(got[k].n_links <= close[k].sum() for k in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * close.sum() >= 700


def test_a_very_common_vector_and_a_large_component(spark):
    """Copies and a component over the bound from which keys are looked up, and columns whose names clash with internal ones."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(k, [float(x) for x in centre]) for k in range(700)]
    rows += [(1000 + k, [float(x) for x in centre + rng.normal(size=8) * 0.01]) for k in range(600)] + [(5000 + k, [float(x) for x in rng.normal(size=8)]) for k in range(20)]
    df = spark.createDataFrame([(*r, 1, 2, "x", 4, 5, 6, 7) for r in rows], "vec_id long, embedding array<double>, n long, cid long, v string, root long, n_links long, _n long, component_id long")
    got = {r.vec_id: r for r in embeddings.near_vectors(df, recall=0.99999).collect()}
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    close = unit @ unit.T >= 0.9
    assert len(got) == len(rows)
    assert [got[d].n_links for d, _ in rows] == (close.sum(axis=1) - 1).tolist()
    components = brute_components(list(range(0, len(rows), 1)), lambda i, j: close[i, j])
    least = {}
    for (d, _), c in zip(rows, components):
        least[c] = min(least.get(c, d), d)
    assert [got[d].component_id for d, _ in rows] == [least[c] for c in components]


def test_simhash_of_long_texts(spark, tmp_path):
    """Texts of 60 000 words, whole: changes at the very end move bits as anywhere else."""
    rng = np.random.default_rng(9)
    long = [f"w{k}" for k in rng.integers(0, 5000, 60_000)]
    texts = [" ".join(long), " ".join([*long[:-3], "X", "y", "Z"]), " ".join(long[:40_000]), " ".join([*long[:30_000], *["tail end of it"] * 30_000]), "a b", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = []
    for text in texts:
        w = words(low(text))
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles], dtype=np.uint64)
        prints.append(sum(1 << b for b in range(64) if len(h) and 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash_near_dedup"](spark, str(tmp_path)).collect()}
    assert [got[k][0] for k in range(len(texts))] == [f"{x:016x}" for x in prints]
    parts = brute_components(list(range(len(texts))), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 4)
    least = collections.defaultdict(lambda: len(texts))
    for k, c in enumerate(parts):
        least[c] = min(least[c], k)
    assert [got[k][1] for k in range(len(texts))] == [least[c] for c in parts]
