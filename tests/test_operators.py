"""Small frames with exact answers: ties, nulls, windows' bounds, and rows from the future."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import aggregates as A
from tarnwell.operators import audit as U
from tarnwell.operators import history as H
from tarnwell.operators import inventory as I
from tarnwell.operators import joins as J
from tarnwell.operators import learned as L
from tarnwell.operators import metrics as M
from tarnwell.operators import ordering as O
from tarnwell.operators import targets as T
from tarnwell.operators import textrules as R
from tarnwell.sources import tables as S


def day(n, hour=0):
    return dt.datetime(2025, 1, n, hour)


def test_asof_takes_the_last_state_and_never_a_later_one(spark):
    rows = spark.createDataFrame([(1, 10, day(5)), (2, 10, day(11)), (3, 10, day(1)), (4, 11, day(5))], "row_id long, spot long, t timestamp")
    snaps = spark.createDataFrame([(1, 10, day(1), True), (2, 10, day(10), None), (3, 10, day(20), True)], "snap long, spot long, at timestamp, free boolean")
    got = {r.row_id: (r.snap, r.free) for r in J.asof_backward(rows, snaps, "spot", "t", "at", ["snap", "free"]).collect()}
    assert got == {1: (1, True), 2: (2, None), 3: (1, True), 4: (None, None)}
    strict = {r.row_id: r.snap for r in J.asof_backward(rows, snaps, "spot", "t", "at", ["snap"], allow_exact=False).collect()}
    assert strict[3] is None and strict[1] == 1


def test_asof_ignores_rows_from_the_future(spark):
    rows = spark.createDataFrame([(1, 10, day(5))], "row_id long, spot long, t timestamp")
    snaps = spark.createDataFrame([(1, 10, day(1))], "snap long, spot long, at timestamp")
    more = snaps.union(spark.createDataFrame([(9, 10, day(6))], snaps.schema))
    take = lambda s: J.asof_backward(rows, s, "spot", "t", "at", ["snap"]).collect()
    assert take(snaps) == take(more)


def test_nearest_prefers_the_later_state_on_ties(spark):
    rows = spark.createDataFrame([(1, 10, day(5))], "row_id long, spot long, t timestamp")
    snaps = spark.createDataFrame([(1, 10, day(3)), (2, 10, day(7))], "snap long, spot long, at timestamp")
    assert J.asof_nearest(rows, snaps, "spot", "t", "at", ["snap"]).first().snap == 2


def test_validated_join_refuses_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(J.CardinalityError):
        J.validated_join(left, right, ["k"])


def test_interval_bounds(spark):
    anchors = spark.createDataFrame([(1, day(1))], "k int, t timestamp")
    events = spark.createDataFrame([(1, day(1)), (1, day(1) + dt.timedelta(days=30)), (1, day(1) + dt.timedelta(days=30, minutes=6))], "k int, e timestamp")
    assert J.interval_join(anchors, events, "k", "t", "e", 30).filter("e is not null").count() == 1
    assert J.interval_join(anchors, events, "k", "t", "e", 30, "both").filter("e is not null").count() == 2


def test_row_and_strict_history_differ_on_ties(spark):
    rows = spark.createDataFrame([(1, 101, day(1), 10.0), (1, 102, day(2), 20.0), (1, 103, day(2), 30.0)], "lead int, id int, t timestamp, m double")
    by_row = {r.id: (r.prior_count, r.prior_m_mean) for r in H.row_history(rows, "lead", "t", "id", ["m"]).collect()}
    by_time = {r.id: (r.prior_count, r.prior_m_mean, r.prior_m_std) for r in H.strict_history(rows, "lead", "t", "id", ["m"]).collect()}
    assert by_row == {101: (0, None), 102: (1, 10.0), 103: (2, 15.0)}
    assert by_time == {101: (0, None, None), 102: (1, 10.0, 0.0), 103: (1, 10.0, 0.0)}


def test_first_event_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, 20, day(1)), (1, 10, day(1)), (1, 30, day(1, 1))], "lead int, id int, t timestamp")
    assert H.first_per_key(rows, "lead", "t", "id").first().id == 10


def test_response_history_knows_only_what_was_answered(spark):
    rows = spark.createDataFrame([(1, 1, day(1), day(5), "x"), (1, 2, day(3), None, "n"), (1, 3, day(5), day(9), "x")], "k int, id int, t timestamp, r timestamp, o string")
    got = {r.id: (r.known_responses, r.known_hits) for r in H.response_history(rows, "k", "t", "r", F.col("o") == "x", "id").collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (1, 1)}


def test_maturity_and_status(spark):
    rows = spark.createDataFrame([(1, day(1), "yes"), (2, day(20), "yes"), (3, day(1), None)], "id int, t timestamp, r string")
    horizon = F.lit(day(22))
    got = {r.id: r.target for r in T.mature_label(rows, "t", F.col("r") == "yes", horizon).collect()}
    assert got == {1: 1, 2: None, 3: 0}
    status = {r.id: r.s for r in rows.select("id", T.status_label(F.col("r"), F.col("t"), horizon, ("yes",), ("no",)).alias("s")).collect()}
    assert status == {1: "POSITIVE", 2: "CENSORED", 3: "AMBIGUOUS"}


def test_ties_share_the_capacity(spark):
    rows = spark.createDataFrame([(y, s) for y, s in zip([1, 0, 1, 0, 0, 0, 0, 0, 0, 0], [0.8] * 4 + [0.2] * 6)], "y int, s double")
    m = M.ranking_metrics(rows, "y", "s").first()
    assert (m.precision_20, m.recall_20, m.lift_20) == (0.5, 0.5, 2.5)
    shuffled = M.ranking_metrics(rows.orderBy(F.rand(1)), "y", "s").first()
    assert m == shuffled


def test_average_precision_is_the_step_sum(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6)], "y int, s double")
    assert M.ranking_metrics(rows, "y", "s").first().average_precision == pytest.approx((1 + 2 / 3) / 2)


def test_one_class_has_no_auc(spark):
    assert M.ranking_metrics(spark.createDataFrame([(1, 0.9), (1, 0.1)], "y int, s double"), "y", "s").first().roc_auc is None


def test_capacity_bands_are_exact(spark):
    rows = spark.createDataFrame([(k, 1.0) for k in range(20)], "id int, s double")
    bands = [r.band for r in O.capacity_bands(rows, "s", ("id",)).orderBy("rank").collect()]
    assert bands == ["PRIORITY", "HIGH"] + ["MEDIUM"] * 2 + ["LOW"] * 16


def test_position_and_running_agree_with_a_window(spark):
    rows = spark.range(500).select("id", ((F.col("id") * 37) % 101).cast("double").alias("v"))
    got = [r.id for r in O.with_position(rows, "v", ("id",), buckets=7).orderBy("position").collect()]
    assert got == [r.id for r in rows.orderBy("v", "id").collect()]
    sums = O.running(rows.groupBy("v").agg(F.count("*").alias("n")), "v", ["n"], buckets=5).orderBy("v").collect()
    assert [r.before_n for r in sums] == [sum(x.n for x in sums[:k]) for k in range(len(sums))]


def test_opportunity_and_bounds(spark):
    rows = spark.createDataFrame([(0.2, 0.5), (0.4, 0.5), (0.6, 1.0), (0.8, 0.0)], "p double, s double")
    got = [r.opportunity_lower for r in I.opportunity(rows, "p", "s", "s").collect()]
    assert got == [0.1, 0.2, 0.6, 0.0]
    lo, hi = I.availability_bounds(F.col("free"), F.col("wait"), F.col("age"), F.lit(None))
    states = spark.createDataFrame([(None, None, None), (True, 0, 40), (True, 0, 5), (False, 15, 5), (False, 60, 5)], "free boolean, wait int, age int")
    assert [tuple(r) for r in states.select(lo, hi).collect()] == [(0, 1), (0, 1), (1, 1), (0.5, 0.5), (0, 0)]


def test_budget_fit_and_state(spark):
    rows = spark.createDataFrame([(15000.0, 10000.0, 20000.0), (3e6, 2e6, 2.5e6), (None, 1.0, 2.0)], "p double, lo double, hi double")
    assert [r[0] for r in rows.select(X.budget_fit(F.col("p"), F.col("lo"), F.col("hi"))).collect()] == [1.0, pytest.approx(2.5 / 3), None]


def test_tiers_take_the_finest_level_and_unknown_places_do_not_match(spark):
    d = spark.createDataFrame([(1, "a", "s1", "m1"), (2, "a", "s1", None)], "lead int, kind string, state string, city string")
    s = spark.createDataFrame([(10, "a", "s1", "m1"), (11, "a", "s1", "m2"), (12, "b", "s1", "m1")], "spot int, kind string, state string, city string")
    got = {(r.lead, r.spot): r.tier for r in J.tiered_candidates(d, s, "lead", "spot", ["kind"], ["city", "state"]).collect()}
    assert got == {(1, 10): 0, (1, 11): 1, (2, 10): 1, (2, 11): 1}


def test_no_candidates_still_have_a_decision(spark):
    spine = spark.createDataFrame([(1,), (2,)], "lead int")
    c = spark.createDataFrame([(1, "UNKNOWN", 0.9, 0)], "lead int, state string, area_fit double, tier int")
    got = {r.lead: (r.decision, r.reason) for r in I.fallback_decision(spine, c, "lead").collect()}
    assert got == {1: ("VERIFY_AVAILABILITY", "OK"), 2: ("NO_RESULT", "NO_INVENTORY")}


def test_text_rules(spark):
    rows = spark.createDataFrame(
        [(1, "Oficina", "Amplia. Con luz natural.", False, "guard", 2, "good", "[]", "Office"), (2, "Local", "Control de acceso.", True, None, 2, "good", "[]", "Retail"), (3, "Local", "Estacionamiento.", True, "guard", 0, "good", '["Parking"]', "Retail"), (4, "Lote", "Recién remodelado", True, "guard", 1, "needs_renovation", "bad json", "Land")],
        "spot_id int, title string, description string, natural_light boolean, security_type string, parking_spaces int, building_status string, amenities string, sector_name string",
    )
    got = {(r.spot_id, r.rule_id): r.evidence for r in R.contradictions(rows, "spot_id").collect()}
    assert got == {(1, "R001"): "Con luz natural.", (2, "R002"): "Control de acceso.", (4, "R004"): "Recién remodelado"}
    seen = {(r.spot_id, r.pattern_id) for r in R.observations(rows, "spot_id").collect()}
    assert seen == {(2, "S003"), (4, "S001")}


def test_shrinkage_wilson_and_fdr(spark):
    lo, hi = A.wilson(F.lit(5), F.lit(10))
    row = spark.range(1).select(A.shrunk_rate(F.lit(5), F.lit(10), 0.2).alias("r"), lo.alias("lo"), hi.alias("hi")).first()
    assert row.r == pytest.approx(9 / 30) and row.lo == pytest.approx(0.2366, abs=1e-3) and row.hi == pytest.approx(0.7634, abs=1e-3)
    q = [r.q for r in A.benjamini_hochberg(spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double"), "p").orderBy("p").collect()]
    assert q == [pytest.approx(x) for x in (0.04, 0.04, 0.04, 0.5)]


def test_normal_tail(spark):
    assert spark.range(1).select(L.normal_upper_p(F.lit(1.96))).first()[0] == pytest.approx(0.0249979, abs=1e-6)


def test_forbidden_columns_are_refused(spark):
    with pytest.raises(ValueError):
        U.assert_clean(spark.range(1).withColumn("future_price", F.lit(1)))


def test_fingerprints(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = a.orderBy(F.desc("k"))
    assert S.unordered_fingerprint(a).first() == S.unordered_fingerprint(b).first()
    changed = a.withColumn("v", F.coalesce("v", F.lit("y")))
    assert S.ordered_fingerprint(a, "k").first() != S.ordered_fingerprint(changed, "k").first()


def test_csv_fallback_and_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    S.write_table(df.coalesce(1), f"{tmp_path}/nation.csv", "csv")
    back = S.read_raw(spark, f"{tmp_path}", "nation", df.schema)
    assert S.parity(df, back).first().only_left == 0
    S.write_table(df, f"{tmp_path}/t", once=True)
    with pytest.raises(Exception, match="(?i)exists"):
        S.write_table(df, f"{tmp_path}/t", once=True)
    assert {r.status for r in S.manifest_drift(S.file_digests(spark, f"{tmp_path}/t"), spark.createDataFrame([("gone", "0")], "name string, sha256 string")).collect()} == {"missing", "unexpected"}


def test_settings_and_unknown_tables(spark):
    assert S.Settings.from_json('{"recommend": 3, "bands": [0.1]}').bands == (0.1,)
    with pytest.raises(ValueError):
        S.Settings.from_json('{"nope": 1}')
    with pytest.raises(KeyError):
        S.load_table(spark, "/nowhere", "users")


def test_sample_size_and_sticky_arms(spark):
    assert 20000 < X.sample_size(0.2, 0.05) < 30000
    ids = spark.range(10000)
    assert abs(U.srm_z(ids.select(X.sticky_arm("s", F.col("id")).alias("arm")), "arm").first().z) < 3
    none = ids.filter("false").select(X.sticky_arm("s", F.col("id")).alias("arm"))
    assert (none.schema["arm"].dataType.simpleString(), none.count()) == ("string", 0)


def test_boosted_trees_keep_the_best_number(spark):
    import inspect

    rows = [(k % 100 / 100, k % 7 * 1.0, "ab"[k % 2], int((k % 100 > 50) ^ (k * 7919 % 10 < 2))) for k in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, c string, y int")
    model = L.fit_boosted(df.limit(300), df.offset(300), "y", ["c"], ["x", "z"], iterations=12)
    assert 1 <= model.stages[-1].getNumTrees <= 12 and model.stages[-1].getMaxDepth() == 6
    assert L.fit_boosted(df, df.filter("false"), "y", ["c"], ["x", "z"], iterations=6).stages[-1].getNumTrees == 6
    assert inspect.signature(L.fit_boosted).parameters["iterations"].default == 500


def test_exact_quantiles_match_sorted_values(spark):
    import numpy as np

    from tarnwell.operators.ordering import exact_quantiles

    rng = np.random.default_rng(5)
    a, b = rng.normal(size=3000).round(3), np.concatenate([np.full(2000, 7.0), rng.integers(0, 4, 1000)])
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, None, None)], "a double, b double, c double")
    shares = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
    for accuracy in (50, 10_000):  # narrowed, and all values ordered
        got = exact_quantiles(df, ["a", "b", "c"], shares, accuracy)
        assert got["c"] is None
        np.testing.assert_allclose(got["a"], np.quantile(a, shares), rtol=1e-12)
        np.testing.assert_allclose(got["b"], np.quantile(b, shares), rtol=1e-12)


def test_gap_statistics_match_sorted_gaps(spark):
    import datetime
    import random
    import statistics

    from tarnwell.operators.history import gap_statistics

    draw, start = random.Random(3), datetime.datetime(2020, 1, 1)
    rows = [(draw.choice([1, 2, 2, 2, None]), start + datetime.timedelta(hours=draw.randrange(400)), i) for i in range(300)]
    got = {r["i"]: (r["gap_mean"], r["gap_median"]) for r in gap_statistics(spark.createDataFrame(rows, "k int, t timestamp, i int"), "k", "t", "i").collect()}
    assert len(got) == len(rows)
    for key in (1, 2, None):
        own = sorted((t, i) for k, t, i in rows if k == key)
        gaps = []
        for at, (t, i) in enumerate(own):
            if at:
                gaps.append((t - own[at - 1][0]).total_seconds() / 86400)
            assert got[i] == pytest.approx((statistics.mean(gaps), statistics.median(gaps))) if gaps else got[i] == (None, None)


def test_positions_of_strings_with_a_common_prefix(spark):
    from tarnwell.operators.ordering import with_position

    names = [f"customer-{k:06d}" for k in range(500)]
    parts = with_position(spark.createDataFrame([(n,) for n in reversed(names)], "name string"), "name")
    assert [r["name"] for r in parts.orderBy("position").collect()] == names
