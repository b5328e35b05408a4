"""Narrowed quantiles, resampling, pools, importance and tree splits against plain loops."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import calibrate as C
from tarnwell.operators import interpret as P
from tarnwell.operators import learned as L
from tarnwell.operators import quantiles as Q
from tarnwell.operators import resampling as B


def quantile(values, q, rule):
    v, at = sorted(values), round(q * (len(values) - 1), 9)
    if rule == "nearest":
        return v[math.floor(at + 0.5)]
    i = int(at)
    return v[i] + (v[min(i + 1, len(v) - 1)] - v[i]) * (at - i)


@pytest.mark.parametrize("rule", ["linear", "nearest"])
@pytest.mark.parametrize("accuracy, most, looked_up", [(500, 20_000, 10_000), (5, 10, 2)])
def test_grouped_quantiles_of_hot_groups_ties_and_nulls(spark, monkeypatch, rule, accuracy, most, looked_up):
    rng = random.Random(1)
    rows = [("hot", None, float(rng.choice([1, 2, 2, 2, 2, rng.random() * 100]))) for _ in range(3000)] + [(None, k % 3, rng.gauss(0, 1)) for k in range(200)] + [("x", 1, 5.0)] * 50 + [("y", 2, None)] + [("z", 3, float(k)) for k in range(150)]
    by = collections.defaultdict(list)
    for a, b, v in rows:
        if v is not None:
            by[a, b].append(v)
    monkeypatch.setattr(Q, "_LOOKED_UP", looked_up)
    shares = {"lo": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.9, "hi": 1.0}
    got = {(r.a, r.b): r for r in Q.grouped_quantiles(spark.createDataFrame(rows, "a string, b int, v double"), ["a", "b"], "v", shares, rule, accuracy, most).collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        assert got[k].n == len(v) and all(got[k][n] == pytest.approx(quantile(v, q, rule)) for n, q in shares.items())


def test_poisson_steps_are_the_distribution():
    for mean in (1.0, 4.0, 256.0):
        first, steps = B.poisson_steps(mean)
        p = np.diff([0.0, *steps])
        k = first + np.arange(len(steps))
        assert steps[-1] == pytest.approx(1) and (p * k).sum() == pytest.approx(mean) and (p * (k - mean) ** 2).sum() == pytest.approx(mean)


def test_cells_are_drawn_like_their_rows(spark):
    """Counts of a cell of n rows over many draws have mean and variance n, whatever its powers of two; nothing is drawn from nothing."""
    cells = spark.createDataFrame([(1, 1, 0), (2, 5, 3), (3, 300, 1000), (4, 0, 0)], "cell long, pos long, neg long")
    got = B.drawn_cells(cells, 1500, 7).groupBy("cell").agg(*[x for c in ("pos", "neg") for x in ((F.sum(c) / 1500).alias(f"m_{c}"), (F.sum(F.col(c) * F.col(c)) / 1500).alias(f"s_{c}"))]).collect()
    want = {1: (1, 0), 2: (5, 3), 3: (300, 1000)}
    assert {r.cell for r in got} == set(want)
    for r in got:
        for n, c in zip(want[r.cell], ("pos", "neg")):
            assert r[f"m_{c}"] == pytest.approx(n, abs=5 * math.sqrt(n / 1500) + 1e-9)
            assert r[f"s_{c}"] - r[f"m_{c}"] ** 2 == pytest.approx(n, rel=0.25, abs=1e-9)


def test_intervals_hold_the_estimate_and_equal_scores_do_not_differ(spark):
    rng = random.Random(4)
    rows = [(k, k % 40, int(rng.random() < 0.2 + 0.4 * (k % 10) / 10), (k % 10) / 10, (k % 10) / 10) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, lead long, y int, a double, b double")
    for r in B.metric_intervals(df, "y", ["a"], "id", draws=200).collect():
        assert r.ci_low <= r.estimate <= r.ci_high and r.draws == 200
    for cluster in (None, "lead"):
        assert all(max(abs(r.delta), abs(r.delta_low), abs(r.delta_high)) < 1e-12 for r in B.paired_delta(df, "y", "a", "b", "id", draws=50, cluster=cluster).collect())
    one = df.withColumn("y", F.lit(1))
    assert B.metric_intervals(one, "y", ["a"], "id", draws=5).count() == 0


def brute_pools(cells):
    """Pools by averaging any falling neighbours until none is left."""
    pools = [[s, s, p, n] for s, p, n in sorted(cells)]
    while True:
        for i in range(len(pools) - 1):
            a, b = pools[i], pools[i + 1]
            if a[2] / a[3] >= b[2] / b[3]:
                pools[i : i + 2] = [[a[0], b[1], a[2] + b[2], a[3] + b[3]]]
                break
        else:
            return [tuple(p) for p in pools]


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_pools_against_brute_force(spark, buckets):
    rng = random.Random(6)
    groups = {"rising": [(k / 50, k, 50) for k in range(50)], "falling": [(k / 50, 50 - k, 50) for k in range(50)], "noise": [(k / 300, rng.randint(0, 3), 3) for k in range(300)], "one": [(0.5, 1, 3)], "zeros": [(k / 9, 0, 2) for k in range(9)], "ones": [(k / 9, 2, 2) for k in range(9)]}
    table = spark.createDataFrame([(g, float(s), float(p), float(n)) for g, x in groups.items() for s, p, n in x], "_g string, _s double, pos double, n double")
    got = collections.defaultdict(list)
    pools = C.isotonic_pools(table, buckets)
    for r in pools.collect():
        got[r["_g"]].append((r.lo, r.hi, r.pos, r.n))
    assert {g: sorted(x) for g, x in got.items()} == {g: brute_pools(x) for g, x in groups.items()}
    at = [-1.0, 0.0, 0.11, 0.499, 0.5, 0.77, 1.0, 2.0]
    rows = spark.createDataFrame([(g, x) for g in [*groups, "unknown"] for x in at] + [("noise", None)], "g string, x double")
    for most in (100_000, 1):
        for r in C.apply_isotonic(rows, pools, F.col("g"), "x", "y", most).collect():
            if r.g == "unknown" or r.x is None:
                assert r.y is None
                continue
            xs, ys = zip(*[(x, p / n) for lo, hi, p, n in brute_pools(groups[r.g]) for x in ([lo] if lo == hi else [lo, hi])])
            assert r.y == pytest.approx(np.interp(r.x, xs, ys))


def test_platt_and_the_choice_by_stage(spark):
    rng = random.Random(9)
    rows = []
    for k in range(3000):
        p = rng.random()
        stage = "sharp" if k % 2 else "right"
        true = p if stage == "right" else 1 / (1 + math.exp(-(3 * math.log(max(p, 1e-6) / max(1 - p, 1e-6)) + 0.5)))
        rows.append((k, stage, p, int(rng.random() < true)))
    rows += [(10_000 + k, "few", 0.3, k % 2) for k in range(10)] + [(20_000 + k, None, 0.1 * (k % 9), 1) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, stage string, p double, y int")
    cells = C.stage_cells(df, "y", "p", "stage", F.lit(0))
    fits = {r["_g"]: r for r in C.platt_fits(cells).collect()}
    assert fits["few"].status == fits["<missing>"].status == "identity"
    assert fits["sharp"].slope == pytest.approx(3, abs=0.5) and fits["right"].slope == pytest.approx(1, abs=0.2)
    chosen = {r["_g"]: r.method for r in C.calibration_choice(C.cross_fitted(C.stage_cells(df, "y", "p", "stage", C.fold_of("id")))).filter("chosen").collect()}
    assert chosen["sharp"] == "platt" and chosen["right"] == "raw" and set(chosen) == set(fits)
    out = C.calibrate_by_stage(df, df, "y", "p", "stage", "id").collect()
    assert len(out) == len(rows) and all(r.calibrated == r.p for r in out if r.stage == "right") and any(r.calibrated != r.p for r in out if r.stage == "sharp")


def test_importance_deals_groups_together(spark):
    """A score of x - x2, with x2 = x + noise: dealt together the columns keep their difference, dealt alone they do not."""
    rng = random.Random(2)
    rows = []
    for k in range(1000):
        x, gap = rng.gauss(0, 5), rng.gauss(0, 1)
        rows.append((k, x, x - gap, rng.random(), int(gap > 0)))
    df = spark.createDataFrame(rows, "id long, x double, x2 double, idle double, y int")
    groups = {"x": ["x"], "pair": ["x", "x2"], "idle": ["idle"]}
    got = {r.feature: r for r in P.permutation_importance(df, "y", P.scored_by(F.col("x") - F.col("x2"), "s"), "s", groups, "id", repeats=3).collect()}
    assert got["idle"].auc_drop_mean == got["idle"].ap_drop_sd == 0
    assert got["x"].auc_drop_mean > 0.2 and got["pair"].auc_drop_mean == pytest.approx(0.5, abs=0.1) and got["pair"].columns == "x|x2"
    assert P.permutation_importance(df.filter("false"), "y", P.scored_by(F.col("x"), "s"), "s", groups, "id").count() == 0


def test_directions_and_counterfactuals(spark):
    rows = [(k, float(k), "a" if k < 100 else "b" if k < 160 else "c" if k < 170 else None, float(k >= 100)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, y double")
    got = {r.feature: r for r in P.directionality(df, "y", ["x"], ["kind"]).collect()}
    assert (got["x"].low_n, got["x"].low_rate, got["x"].high_n, got["x"].high_rate, got["x"].delta_pp) == (50, 0.0, 50, 1.0, 100.0)
    assert (got["kind"].low_group, got["kind"].low_n, got["kind"].high_group, got["kind"].high_n) == ("a", 100, "b", 60)
    cf = {(r.segment, r.value): r for r in P.counterfactual_scores(df, P.scored_by(F.col("x") * 2, "s"), "s", "x", [1, 5], ["kind"]).collect()}
    assert {k: (r.n, r.mean_0, r.mean_1, r.delta_pp) for k, r in cf.items()} == {("kind", v): (n, 2.0, 10.0, -800.0) for v, n in (("a", 100), ("b", 60), ("c", 10), ("<missing>", 30))}


def test_tree_splits_agree_with_the_printed_forest(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.random(), rng.random(), rng.choice("uvw")) for _ in range(500)]
    df = spark.createDataFrame([(a, b, c, int(a + b > 1 and c != "u")) for a, b, c in rows], "a double, b double, c string, y int")
    model = L.fit_classifier(df, "forest", "y", ["c"], ["a", "b"], numTrees=3, maxDepth=4)
    names = L.feature_names(model, df, ["c"], ["a", "b"])
    assert names[:2] == ["a", "b"] and set(names[2:]) == {"c=u", "c=v", "c=w", "c=?"}
    got = P.tree_splits(P.tree_nodes(model, f"file://{tmp_path}/forest"), dict(enumerate(names))).collect()
    printed = model.stages[-1].toDebugString
    assert len(got) == printed.count("If (")
    for r in got:
        assert r.threshold is None or f"feature {names.index(r.feature)} <= {r.threshold}" in printed
        assert (r.parent_1 == "") == (r.depth == 0) and (r.parent_2 == "") == (r.depth < 2) and (r.parent_3 == "") == (r.depth < 3)
    assert {r.tree for r in got if r.depth == 0} == {0, 1, 2}


def test_logistic_as_an_expression(spark):
    rng = random.Random(3)
    rows = [(float(k % 7) if k % 11 else None, rng.choice(["u", "v", None]), rng.random()) for k in range(800)]
    df = spark.createDataFrame([(a, c, int(z < 1 / (1 + math.exp(-((a or 3) - 3) - (c == "u"))))) for a, c, z in rows], "a double, c string, y int")
    q = L.fit_logistic(df, "y", ["c"], ["a"])
    mine = df.select("a", "c", "y", q.alias("q")).collect()
    assert all(0 < r.q < 1 for r in mine) and sum(r.q for r in mine) == pytest.approx(sum(r.y for r in mine), rel=0.01)
    old = L.predict(L.fit_classifier(df, "logistic", "y", ["c"], ["a"]), df, ["c"], "q").collect()
    assert max(abs(a - b) for a, b in zip(sorted(r.q for r in mine), sorted(r.q for r in old))) < 0.02


def test_normal_tail_over_its_range(spark):
    at = [-9.0, -3.0, -1.0, 0.0, 0.5, 2.999, 3.0, 3.001, 6.0, 12.0]
    got = {r.z: r.p for r in spark.createDataFrame([(z,) for z in at], "z double").select("z", L.normal_upper_p(F.col("z")).alias("p")).collect()}
    for z in at:
        assert got[z] == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-9)
