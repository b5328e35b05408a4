"""Mixtures, clustering-feature trees and components against plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import clusters as K


def planted(seed=1, n=240):
    rng = np.random.default_rng(seed)
    centres, spread = np.array([[0.0, 0.0], [6.0, 1.0], [-2.0, 7.0]]), np.array([[0.5, 1.0], [1.0, 0.3], [0.7, 0.7]])
    kind = rng.integers(0, 3, n)
    return kind, centres[kind] + rng.normal(size=(n, 2)) * spread[kind]


def frame(spark, kind, x, extra=()):
    rows = [(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(kind, x))]
    return spark.createDataFrame([*rows, *extra], "id long, kind int, features array<double>").repartition(5, "id")


ODD = [(900, None, None), (901, None, [1.0]), (902, None, [1.0, None]), (903, None, [float("nan"), 1.0]), (904, None, [float("inf"), 1.0])]


def plain_em(x, means, steps, gain=1e-6, floor=1e-6):
    k, (n, dims) = len(means), x.shape
    w, m, v = [1 / k] * k, [np.array(c) for c in means], [np.maximum(x.var(axis=0), floor)] * k
    trace = []
    for _ in range(steps):
        density = [[w[j] * np.prod([np.exp(-((row[a] - m[j][a]) ** 2) / (2 * v[j][a])) / np.sqrt(2 * np.pi * v[j][a]) for a in range(dims)]) for j in range(k)] for row in x]
        trace.append(np.mean([np.log(sum(r)) for r in density]))
        if len(trace) > 1 and trace[-1] - trace[-2] < gain:
            break
        share = np.array([[a / sum(r) for a in r] for r in density])
        w = [share[:, j].sum() / n for j in range(k)]
        m = [sum(share[i, j] * x[i] for i in range(n)) / share[:, j].sum() for j in range(k)]
        v = [np.maximum(sum(share[i, j] * (x[i] - m[j]) ** 2 for i in range(n)) / share[:, j].sum(), floor) for j in range(k)]
    return np.array(w), np.array(m), np.array(v), trace


START = [[1.0, 1.0], [4.0, 0.0], [0.0, 5.0]]


def test_mixture_against_loops(spark):
    kind, x = planted()
    df = frame(spark, kind, x, ODD)
    got = K.fit_mixture(df, "features", START, steps=12, gain=1e-6)
    w, m, v, trace = plain_em(x, START, 12)
    assert np.allclose(got.weights, w, atol=1e-9) and np.allclose(got.means, m, atol=1e-9) and np.allclose(got.variances, v, atol=1e-9)
    assert np.allclose(got.trace, trace, atol=1e-9)
    assert all(b >= a - 1e-12 for a, b in zip(got.trace, got.trace[1:]))


def test_mixture_assigns_and_names_by_size(spark):
    kind, x = planted()
    df = frame(spark, kind, x, ODD)
    model = K.fit_mixture(df, "features", START)
    out = K.named_by_size(K.with_component(df, "features", model, "_label", "p"), "_label").collect()
    assert len(out) == len(x) + len(ODD)
    assert {r.profile for r in out if r.id >= 900} == {None} and {r.p for r in out if r.id >= 900} == {None}
    by_id = {r.id: r.profile for r in out}
    assert purity(kind, [by_id[i] for i in range(len(x))]) > 0.98
    sizes = [sum(r.profile == k for r in out) for k in range(3)]
    assert sizes == sorted(sizes, reverse=True)


def test_mixture_of_repeated_rows_and_of_none(spark):
    rows = spark.createDataFrame([(i, 0, [2.0, 3.0]) for i in range(40)], "id long, kind int, features array<double>")
    model = K.fit_mixture(rows, "features", START)
    assert np.isfinite(model.means).all() and (model.variances >= 1e-6).all()
    assert np.allclose(model.weights @ model.means, [2, 3], atol=1e-6)
    empty = K.fit_mixture(rows.filter("false"), "features", START)
    assert empty.means.tolist() == START and K.with_component(rows.filter("false"), "features", empty, "k").count() == 0


def purity(kind, label):
    pairs = list(zip(label, kind))
    return sum(max(sum(p == (a, b) for p in pairs) for b in set(kind.tolist())) for a in set(label)) / len(pairs)


@pytest.mark.parametrize("most", [8, 40, 512])
def test_trees_keep_sums_and_bounds(most):
    rng = np.random.default_rng(most)
    x = np.concatenate([rng.normal(size=(900, 3)), np.tile(rng.normal(size=(1, 3)), (300, 1))])
    rng.shuffle(x)
    tree = K.FeatureTree(3, most, branching=6)
    for part in np.array_split(x, 7):
        tree.add(np.ones(len(part)), part, (part * part).sum(1))
    n, s, q = tree.entries()
    assert len(n) <= most and n.sum() == len(x)
    assert np.allclose(s.sum(0), x.sum(0)) and q.sum() == pytest.approx((x * x).sum())
    open_ = [tree.root]
    while open_:  # every inner entry is the sum of its child, no node is too full
        node = open_.pop()
        assert len(node.n) <= 6 + 1
        for k, child in enumerate(node.children or []):
            assert node.n[k] == child.n.sum() and np.allclose(node.s[k], child.s.sum(0)) and node.q[k] == pytest.approx(child.q.sum())
            open_.append(child)


def test_equal_rows_share_an_entry():
    tree = K.FeatureTree(2, 50)
    x = np.array(list(itertools.product(range(4), range(5))) * 30, dtype=float)
    tree.add(np.ones(len(x)), x, (x * x).sum(1))
    assert sorted(tree.entries()[0].tolist()) == [30.0] * 20


def plain_ward(n, c, k):
    groups = [[i] for i in range(len(n))]
    centre = lambda g: sum(n[i] * c[i] for i in g) / sum(n[i] for i in g)
    weight = lambda g: sum(n[i] for i in g)
    while len(groups) > k:
        cost, a, b = min((weight(g) * weight(h) / (weight(g) + weight(h)) * ((centre(g) - centre(h)) ** 2).sum(), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_ward_against_loops():
    rng = np.random.default_rng(6)
    n, c = rng.integers(1, 9, 24), rng.normal(size=(24, 2))
    for k in (1, 3, 7, 24):
        label = K.ward(n, c, k)
        assert {frozenset(np.flatnonzero(label == a).tolist()) for a in set(label.tolist())} == plain_ward(n, c, k)


def test_tree_profiles_find_planted_clusters(spark):
    kind, x = planted(n=600)
    df = frame(spark, kind, x, ODD)
    out = K.tree_profiles(df, "features", 2, 3, most=30).collect()
    assert len(out) == len(x) + len(ODD) and {r.profile for r in out if r.id >= 900} == {None}
    by_id = {r.id: r.profile for r in out}
    assert purity(kind, [by_id[i] for i in range(len(x))]) > 0.95
    assert K.tree_profiles(df.filter("false"), "features", 2, 3).count() == 0
    assert {r.profile for r in K.tree_profiles(df.filter("id < 2"), "features", 2, 3).collect()} == {0, 1}


def test_components_against_exact_svd(spark):
    rng = np.random.default_rng(3)
    letters = rng.choice(list("abcdefgh"), 400, p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])
    rows = [(i, str(letters[i]), None if i % 50 == 0 else int(rng.integers(0, 5)), None if i % 33 == 0 else float(rng.normal()), float(rng.normal())) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b int, x double, y double").repartition(4, "id")
    coded, names = K.coded(df, ["a", "b"], ["x", "y"])
    got = coded.orderBy("id").collect()
    dense = np.zeros((400, len(names)))
    for i, r in enumerate(got):
        dense[i, :2] = r["_numbers"]
        dense[i, list(r["_codes"])] = 1
        assert names[r["_codes"][0]] == f"a={r.a}" and names[r["_codes"][1]] == f"b={'<missing>' if r.b is None else r.b}"
    assert np.allclose(dense[:, :2].mean(0), 0) and np.allclose(dense[:, :2].std(0), 1)
    found = K.fit_components(coded, names, 2, 5)
    _, singular, right = np.linalg.svd(dense, full_matrices=False)
    assert np.allclose(found.singular, singular[:5], rtol=1e-3)
    for k in range(5):
        v = found.vectors[:, k]
        assert v[np.abs(v).argmax()] > 0
        assert min(np.abs(v - right[k]).max(), np.abs(v + right[k]).max()) < 0.05
    places = {r.id: r.features for r in K.embedded(coded, found, 2).select("id", "features").collect()}
    assert np.allclose([places[i] for i in range(400)], dense @ found.vectors, atol=1e-9)


def test_rare_values_share_a_column(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate("aaabbcd")], "id long, a string")
    coded, names = K.coded(df, ["a"], [], most_values=2)
    assert names == ["a=a", "a=b", "a=?"]
    assert [r["_codes"] for r in coded.orderBy("id").collect()] == [[0], [0], [0], [1], [1], [2], [2]]
    assert K.fit_components(coded, names, 0, 2).singular.tolist() == pytest.approx([3**0.5, 2**0.5])
    assert coded.filter(F.size("_numbers") > 0).count() == 0
