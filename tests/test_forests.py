"""Extra trees against trees grown by plain loops, and what they learn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import forests as T


def _rows(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)  # rounded: ties and repeated rows
    x[:, 2] = 7.0  # a constant feature
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(int)


def _frame(spark, x, y, parts=3):
    return spark.createDataFrame([(k, a.tolist(), int(b)) for k, (a, b) in enumerate(zip(x, y))], "id int, x array<double>, y int").repartition(parts)


def _gini(y):
    return 2 * y.sum() * (len(y) - y.sum()) / len(y) if len(y) else 0.0


def _plain(x, y, seed, tree, depth, tried, least):
    """{node: (feature, threshold)} and {leaf: share} of one tree, grown row set by row set."""
    splits, leaves, open_ = {}, {}, [(0, 0, np.arange(len(x)))]
    while open_:
        node, level, at = open_.pop()
        best = None
        if level < depth and len(at) >= 2 * least and 0 < y[at].sum() < len(at):
            for f, cut in T.draw(seed, tree, node, x[at].min(axis=0), x[at].max(axis=0), tried):
                low = x[at, f] <= cut
                if min(low.sum(), (~low).sum()) >= least:
                    after = _gini(y[at[low]]) + _gini(y[at[~low]])
                    if best is None or after < best[0] - 1e-12:
                        best = (after, f, cut, at[low], at[~low])
        if best is None:
            leaves[node] = y[at].mean()
        else:
            splits[node] = best[1:3]
            open_ += [(2 * node + 1, level + 1, best[3]), (2 * node + 2, level + 1, best[4])]
    return splits, leaves


def test_trees_match_plain_loops_on_any_partitioning(spark):
    x, y = _rows()
    for parts in (1, 5):
        forest = T.fit_extra_trees(_frame(spark, x, y, parts), "x", "y", 3, trees=3, depth=4, tried=2, least=4, seed=9)
        for tree in range(3):
            splits, leaves = _plain(x, y, 9, tree, 4, 2, 4)
            nodes = np.flatnonzero(forest.feature[tree] >= 0)
            assert {int(i): (int(forest.feature[tree, i]), float(forest.threshold[tree, i])) for i in nodes} == splits
            assert all(forest.value[tree, i] == pytest.approx(v) for i, v in leaves.items())
            assert set(forest.nodes(x, tree, 4).tolist()) == set(leaves)


def test_an_interaction_is_learned(spark):
    x, y = _rows(1500)
    forest = T.fit_extra_trees(_frame(spark, x[:1000], y[:1000]), "x", "y", 3, trees=20, depth=7, tried=2)
    out = T.with_score(_frame(spark, x[1000:], y[1000:]), "x", forest).toPandas()
    high = out.p[out.y == 1].to_numpy()[:, None]
    low = out.p[out.y == 0].to_numpy()
    assert ((high > low) + 0.5 * (high == low)).mean() > 0.95
    shares = T.importances(forest)
    assert sum(shares) == pytest.approx(1) and shares[2] == 0 and min(shares[:2]) > 0.3


def test_odd_rows_and_small_tables(spark):
    odd = [(0, None, 1), (1, [1.0], 1), (2, [1.0, None, 2.0], 0), (3, [float("nan"), 1.0, 1.0], 1), (4, [float("inf"), 1.0, 1.0], 0)]
    x, y = _rows(60)
    good = _frame(spark, x, y)
    both = good.unionByName(spark.createDataFrame([*odd, (5, [1.0, 1.0, 1.0], None)], good.schema))
    a, b = (T.fit_extra_trees(d, "x", "y", 3, trees=2, depth=3) for d in (good, both))
    assert np.array_equal(a.feature, b.feature) and np.array_equal(a.threshold, b.threshold)
    scores = {r.id: r.p for r in T.with_score(spark.createDataFrame(odd, good.schema), "x", a).collect()}
    assert set(scores.values()) == {None} and len(scores) == 5
    empty = T.fit_extra_trees(good.limit(0), "x", "y", 3, trees=2, depth=3)
    assert (empty.feature == -1).all() and T.importances(empty) == [0, 0, 0]
    assert T.with_score(good, "x", empty).filter("p is not null").isEmpty()
    one = T.fit_extra_trees(good.withColumn("y", F.lit(1)), "x", "y", 3, trees=2, depth=3)
    assert (one.feature == -1).all() and T.with_score(good, "x", one).filter("p <> 1").isEmpty()


def test_rows_of_leaves_stay_below_them():
    rng = np.random.default_rng(1)
    x, feature, threshold = rng.normal(size=(500, 3)), np.full(31, -1, dtype=np.int32), np.zeros(31)
    feature[[0, 1, 2, 4]], threshold[[0, 1, 2, 4]] = [0, 1, 2, 0], [0.1, -0.2, 0.3, -0.4]
    forest = T.Forest(feature[None], threshold[None], np.zeros((1, 31)), np.zeros((1, 3)))
    for level in range(5):
        walked = T._places(np.ascontiguousarray(x.T).ravel(), 500, feature, threshold, level) + 2**level - 1
        here = forest.nodes(x, 0, level)
        inside = here >= 2**level - 1  # rows of a node of this level; those of leaves above lie below their leaf
        assert np.array_equal(walked[inside], here[inside])
        for w, h in zip(walked[~inside], here[~inside]):
            while w > h:
                w = (w - 1) // 2
            assert w == h
