"""Steps that must not grow with more than their input: what they shuffle, broadcast or compare, and the same results by plain loops."""

import bisect
import collections
import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import interpret as P
from tarnwell.operators import inventory as I
from tarnwell.operators import joins as J
from tarnwell.operators import learned as L
from tarnwell.operators import resampling as B
from tarnwell.sources.tables import parity


def test_parity_brings_the_sides_together_once(spark):
    r = random.Random(5)
    rows = lambda n: [(r.choice([1, 2, None]), r.choice(["a", None]), r.choice([0.0, float("nan"), None])) for _ in range(n)]
    a, b = rows(90), rows(60)
    left, right = (spark.createDataFrame(x, "k int, v string, x double").repartition(3) for x in (a, b))
    got = parity(left, right)
    ca, cb = (collections.Counter(map(str, x)) for x in (a, b))
    assert tuple(got.select("left_rows", "right_rows", "only_left", "only_right").first()) == (90, 60, (ca - cb).total(), (cb - ca).total())
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert tuple(parity(left.limit(0), right.limit(0)).first()) == (0, 0, 0, 0)


def test_dealt_columns_are_not_broadcast(spark, monkeypatch):
    plans = []
    old = P.settled
    monkeypatch.setattr(P, "settled", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or old(df, name))
    df = spark.range(200).select("id", F.rand(1).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    assert P.permutation_importance(df, "y", P.scored_by(F.col("x"), "s"), "s", {"x": ["x"]}, "id", repeats=2).count() == 1
    dealt = [p for p in plans if "_from" in p]
    assert dealt and all("BroadcastHashJoin [_from" not in p and "SortMergeJoin [_from" in p for p in dealt)


def test_draws_follow_the_steps(spark):
    df = spark.createDataFrame([(e, k / 700) for e in range(9) for k in range(700)] + [(e, x) for e in range(9) for x in (1e-12, 0.5, 1 - 1e-12, 1 - 2**-52)], "e int, u double")
    for r in df.select("e", "u", B._drawn(F.col("e"), F.col("u")).alias("w")).collect():
        first, steps = B.poisson_steps(float(1 << r.e))
        assert r.w == first + bisect.bisect_right(steps, r.u)


def test_draws_of_whole_clusters(spark):
    cells = [(c, k, c + k, 1) for c in range(20) for k in range(c % 7 + 1)]
    got = B.drawn_clusters(spark.createDataFrame(cells, "cell long, s int, pos long, neg long"), 30, 42, most=3)
    _, steps = B.poisson_steps(1.0)
    weight = lambda c, t: bisect.bisect_right(steps, int(hashlib.md5(f"42|{c}|{t}".encode()).hexdigest()[:13], 16) / 2**52)
    want = sorted((c, t, s, p * w, n * w) for c, s, p, n in cells for t in range(1, 31) if (w := weight(c, t)))
    assert sorted((r.cell, r.draw, r.s, r.pos, r.neg) for r in got.collect()) == want


def test_boosted_trees_are_fitted_on_rows_of_different_values(spark, tmp_path):
    r = random.Random(3)
    kinds = [(r.choice([None, *range(90)]), r.randrange(40) * 0.5, 7.0, r.choice(["a", "b", None]), r.randrange(2)) for _ in range(150)]
    rows = [(None if x is None else x * 1.0, *rest) for x, *rest in kinds for _ in range(r.choice([1, 9]))]
    df = spark.createDataFrame(rows, "x double, z double, same double, c string, y int").coalesce(1)
    args = ("y", ["c"], ["x", "z", "same"])
    model = L.fit_boosted(df, df.filter("false"), *args, iterations=4, depth=4, rate=0.3)
    plain = L.fit_classifier(df, "gbt", args[0], *args[1:], maxIter=4, maxDepth=4, stepSize=0.3)
    scores = lambda m: [x.q for x in L.predict(m, df, ["c"], "q").collect()]
    assert max(abs(a - b) for a, b in zip(scores(model), scores(plain), strict=True)) < 1e-9
    seen = P.tree_nodes(model, f"file://{tmp_path}/nodes").filter("node = 0").agg(F.max("samples")).first()[0]
    assert seen <= len(set(rows)) < len(rows)
    # the number of trees is that of the least loss over the rows, not over their kinds
    early, late = df.limit(300), df.offset(300)
    model = L.fit_boosted(early, late, *args, iterations=8, depth=4, rate=0.3)
    plain = L.fit_classifier(early, "gbt", args[0], *args[1:], maxIter=8, maxDepth=4, stepSize=0.3)
    ready = L.as_text(late, ["c"]).withColumn("y", F.col("y").cast("double"))
    losses = plain.stages[-1].evaluateEachIteration(L.PipelineModel(plain.stages[:-1]).transform(ready))
    assert model.stages[-1].getNumTrees == 1 + losses.index(min(losses))


def test_thresholds_are_those_of_trees(spark):
    few = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 4, 4, 4, 10)], "x double")
    assert L.tree_cuts(few, "x") == [0.5, 2.5, 7.0]
    assert L.tree_cuts(few.withColumn("x", F.lit(2.0)), "x") == []
    assert len(L.tree_cuts(spark.range(640).select(F.exp(F.col("id") / 40).alias("x")), "x")) == 31


def test_clustered_rows_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(L, "_ROWS", 100, raising=False)
    sizes, old = [], L.KMeans.fit
    monkeypatch.setattr(L.KMeans, "fit", lambda self, df, *rest: sizes.append(df.rdd.glom().map(len).collect()) or old(self, df, *rest))
    df = spark.range(900).select("id", (F.col("id") % 3 * 100 + F.rand(1)).alias("x"), F.lit("a").alias("c")).coalesce(1)
    out = L.cluster(df, "kmeans", 3, ["c"], ["x"])
    assert out.count() == 900 and [r["count"] for r in out.groupBy("profile").count().collect()] == [300] * 3
    assert out.groupBy((F.col("id") % 3).alias("g")).agg(F.countDistinct("profile").alias("n")).filter("n > 1").isEmpty()
    L.cluster(df.limit(100), "kmeans", 3, ["c"], ["x"])
    assert sum(sizes[0]) == 900 and max(sizes[0]) <= 110 and [n for n in sizes[1] if n] == [100]


@pytest.fixture(scope="module")
def one_place(spark):
    """Demand and supply of one place and two kinds, in no order: a key with very many pairs."""
    r = random.Random(17)
    demand = [(k, k % 2, 1, 7, r.choice([-1.0, 950.0, 5000.0, 5000.0, 5000.0])) for k in r.sample(range(10**6), 800)]
    supply = [(k, k % 2, 1, 7, 900 + r.randrange(1000) / 10, r.choice([None, 3, 8]), r.random() < 0.5) for k in r.sample(range(10**6), 3000)]
    d = spark.createDataFrame(demand, "lead long, kind int, nation int, region int, budget double").repartition(3)
    s = spark.createDataFrame(supply, "spot long, kind int, nation int, region int, price double, age int, free boolean").repartition(3)
    return demand, supply, d, s


@pytest.mark.parametrize("name", ["tiered", "scored", "relaxed", "observed", "pool"])
def test_pairs_of_one_place_are_many_tasks_and_small_files(spark, one_place, tmp_path, name):
    demand, supply, d, s = one_place
    within = F.col("s_price") <= F.col("budget")
    fits = lambda a, b: b[4] <= a[4]
    same, other = lambda a, b: a[1] == b[1] and fits(a, b), lambda a, b: a[1] != b[1] and fits(a, b)
    tiered = functools.partial(J.tiered_candidates, d, s, "lead", "spot", ["kind"], ["nation", "region"], within)
    exact = d.withColumn("exact", F.when(F.col("lead") % 3 == 0, supply[0][0]))
    seen = [(demand[0][0], supply[0][0]), (demand[0][0], -1), (demand[0][0], -1)]
    out, meets = {
        "tiered": lambda: (tiered(order=["price"]), same),
        "scored": lambda: (tiered(["age"], ["price"]), same),
        "relaxed": lambda: (J.relaxed_candidates(d, s, "lead", "spot", "nation", "kind", 3, within, ["price"]), other),
        "observed": lambda: (J.with_observed(tiered(order=["price"]), spark.createDataFrame(seen, "lead long, spot long"), d, s, "lead", "spot", ["kind", "region"], within), same),
        "pool": lambda: (I.candidate_pool(exact, s, "lead", "spot", ["kind", "nation"], "exact", ["free", "age"]), lambda a, b: a[1] == b[1]),
    }[name]()
    want = {(a[0], b[0]) for a in demand for b in supply if meets(a, b)}
    want |= {(a[0], supply[0][0]) for a in demand if a[0] % 3 == 0} if name == "pool" else {*seen} if name == "observed" else set()
    out.write.parquet(f"file://{tmp_path}/out")
    got = spark.read.parquet(f"file://{tmp_path}/out")
    found = got.select("lead", "spot").toPandas()
    assert len(found) == len(want) and {*zip(found.lead, found.spot, strict=True)} == want and len(want) > 600_000
    if name in ("scored", "pool"):
        assert got.join(s.select("spot", F.col("age").alias("own")), "spot").filter("not (age <=> own)").isEmpty()
    files = [p.stat().st_size for p in tmp_path.glob("out/*.parquet")]
    assert sum(files) < 0.5 * len(want)
    assert max(r[0] for r in got.groupBy(F.input_file_name()).agg(F.count("*")).select("count(1)").collect()) < 0.15 * len(want)


def test_tables_of_cluster_draws(spark):
    """The score tables of drawn clusters, from rows with a block of draws, are those of a row a cell and draw; and a few clusters are many tasks."""
    r = random.Random(23)
    cells = [(c, k / 8, r.randrange(3) / 2, f"f{k % 2}", r.randrange(3), 1 + r.randrange(2)) for c in range(40) for k in range(c % 7 + 1)]
    df = spark.createDataFrame(cells, "cell long, a double, b double, fold string, pos long, neg long").coalesce(1)
    tables = B.cluster_tables(df, ["a", "b"], ["fold"], 23, 42, most=3, at_once=4)
    got = sorted(map(tuple, tables.select("draw", "fold", "score_name", "_s", "pos", "n").collect()))
    long = B.drawn_clusters(df, 23, 42, most=3).select("draw", "fold", "pos", "neg", F.explode(F.create_map(F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))).alias("score_name", "_s"))
    want = long.groupBy("draw", "fold", "score_name", "_s").agg(F.sum("pos").cast("double"), F.sum(F.col("pos") + F.col("neg")).cast("double"))
    assert got == sorted(map(tuple, want.collect())) and len(got) > 250 and {x[0] for x in got} == {*range(1, 24)}
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_draws_by_digits_are_those_of_the_number(spark):
    steps = [int(x * 2**52) + k for x in B.poisson_steps(1.0)[1] for k in (-1, 0, 1)]
    digits = [f"{min(max(d, 0), 2**52 - 1):013x}{rest}" for d in [0, *steps, *range(0, 2**52, 2**43)] for rest in ("0" * 19, "f" * 19)]
    df = spark.createDataFrame([(x,) for x in digits], "h string")
    u = F.conv(F.substring("h", 1, 13), 16, 10).cast("double") / float(1 << 52)
    assert df.select(B._drawn_by_digits(F.col("h")).alias("a"), B._drawn(None, u).alias("b")).filter("a <> b").isEmpty()
