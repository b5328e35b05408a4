"""Whole analytical base tables and the rules, labels and selections built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import aggregates as A
from tarnwell.operators import availability as V
from tarnwell.operators import features as X
from tarnwell.operators import history as H
from tarnwell.operators import joins as J
from tarnwell.operators import metrics as M
from tarnwell.operators import targets as T
from tarnwell.plans.registry import ASKS, SCORED, SNAPSHOTS, asks, orders, query, r6, scored, snapshots
from tarnwell.sources.tables import load_table, settled

_FIRST = f"""a AS ({ASKS}), f AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY asked_at, ask_id) AS n FROM a), sn AS ({SNAPSHOTS}),
j AS (SELECT f.*, sn.available, date_diff('day', sn.seen, f.asked_at) AS age FROM f ASOF LEFT JOIN sn ON sn.part_id = f.part_id AND f.asked_at >= sn.seen WHERE f.n = 1),
b AS (SELECT j.*, c_mktsegment, c_acctbal, p_brand, p_retailprice FROM j JOIN customer ON c_custkey = lead JOIN part ON p_partkey = part_id)"""


@query(f"""WITH {_FIRST}, h AS (SELECT max(o_orderdate) AS h FROM orders) SELECT lead, ask_id, c_mktsegment AS segment, p_brand AS brand, available, CAST(age AS INT) AS age_days, round(p_retailprice / nullif(c_acctbal, 0), 6) AS price_ratio, CAST(isodow(asked_at) - 1 AS INT) AS weekday,
 CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age > 90 THEN 'STALE' ELSE 'FRESH' END AS coverage, CASE WHEN asked_at < h - INTERVAL 7 DAY THEN CAST(st = 'F' AS INT) END AS target,
 CASE WHEN asked_at >= h - INTERVAL 7 DAY THEN 'purge_or_censored' WHEN asked_at < TIMESTAMP '1995-09-24' THEN 'train' WHEN asked_at >= TIMESTAMP '1995-10-01' AND asked_at < TIMESTAMP '1996-12-24' THEN 'validation' WHEN asked_at >= TIMESTAMP '1997-01-01' THEN 'test' ELSE 'purge_or_censored' END AS split FROM b, h""")
def first_event_table(spark: SparkSession, d: str) -> DataFrame:
    """One row a lead at its first enquiry: dimensions, state as of then, features, label and split."""
    a = asks(spark, d)
    horizon = F.lit(orders(spark, d).agg(F.max("o_orderdate")).first()[0])
    first = H.first_per_key(a, "lead", "asked_at", "ask_id")
    c = load_table(spark, d, "customer").select(F.col("c_custkey").alias("lead"), "c_mktsegment", "c_acctbal")
    p = X.prefixed(load_table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")), "spot_", ("part_id",))
    dims = J.validated_join(J.validated_join(first, c, ["lead"], "inner"), p, ["part_id"], "inner")
    known = J.state_coverage(J.asof_backward(dims, snapshots(spark, d), "part_id", "asked_at", "at", ["available"]), "asked_at", "at")
    out = X.calendar_features(T.mature_label(known, "asked_at", F.col("st") == "F", horizon), "asked_at")
    windows = {"train": ("1900-01-01", "1995-09-24"), "validation": ("1995-10-01", "1996-12-24"), "test": ("1997-01-01", "2100-01-01")}
    out = T.calendar_split(out, "asked_at", "target", windows)
    return out.select("lead", "ask_id", F.col("c_mktsegment").alias("segment"), F.col("spot_brand").alias("brand"), "available", "age_days", F.round(F.try_divide("spot_price", "c_acctbal"), 6).alias("price_ratio"), "weekday", "coverage", "target", "split")


@query(f"""WITH a AS ({ASKS}), f AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY asked_at, ask_id) AS n, count(*) OVER (PARTITION BY lead ORDER BY asked_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prior_count,
 count(*) OVER (PARTITION BY lead, part_id ORDER BY asked_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS same FROM a) SELECT ask_id, CAST(n AS BIGINT) AS position, prior_count, same > 0 AS revisit FROM f WHERE n > 1""")
def later_event_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per later enquiry with its strict-past history; peers of one day do not see each other."""
    a = H.strict_history(H.position_in_key(asks(spark, d), "lead", "asked_at", "ask_id"), "lead", "asked_at", "ask_id")
    return H.same_value_history(a, "lead", "asked_at", "part_id").filter("position > 1").select("ask_id", "position", "prior_count", F.col("revisit_part_id").alias("revisit"))


@query("""SELECT l_orderkey, l_linenumber, 15.0::DOUBLE AS mid, round(ln(1 + l_quantity), 6) AS log, CASE WHEN l_quantity < 10 THEN 'below' WHEN l_quantity > 20 THEN 'above' ELSE 'inside' END AS direction, CASE WHEN l_returnflag = 'R' THEN '__NOT_APPLICABLE__' ELSE l_linestatus END AS gated, CAST(l_quantity > 25 AND l_discount > 0.05 AS INT) AS flag FROM lineitem""")
def deterministic_features(spark: SparkSession, d: str) -> DataFrame:
    li = load_table(spark, d, "lineitem").withColumns({"lo": F.lit(10.0), "hi": F.lit(20.0)})
    f = X.amount_features(li, "lo", "hi", "l_quantity", "q")
    return f.select("l_orderkey", "l_linenumber", F.col("q_mid").alias("mid"), F.round("q_log", 6).alias("log"), F.col("q_direction").alias("direction"), X.gated(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("gated"), X.interaction_flag(F.col("l_quantity") > 25, F.col("l_discount") > 0.05).alias("flag"))


_ASKED = """x AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'rent' WHEN 1 THEN 'sale' WHEN 2 THEN 'both' END AS mode, l_tax * 500 AS wanted, l_quantity AS size, l_partkey AS message, l_discount AS before,
 CASE WHEN l_partkey % 5 > 0 THEN 10.0 END AS rlo, 20.0 AS rhi, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity END AS rask, 1000.0 AS slo, 50000.0 AS shi, CASE WHEN l_suppkey % 2 = 0 THEN l_extendedprice END AS sask FROM lineitem),
y AS (SELECT *, size / nullif(wanted, 0) AS ratio, coalesce(mode IN ('rent', 'both'), false) AS ra, coalesce(mode IN ('sale', 'both'), false) AS sa, CASE WHEN rask IS NOT NULL AND rlo IS NOT NULL THEN rask BETWEEN rlo AND rhi END AS rin, CASE WHEN sask IS NOT NULL THEN sask BETWEEN slo AND shi END AS si FROM x)"""


@query(f"""WITH {_ASKED} SELECT l_orderkey, l_linenumber, CASE WHEN NOT ra THEN 'NOT_APPLICABLE' WHEN rask IS NULL THEN 'UNKNOWN' ELSE 'OBSERVED' END AS rent_asked_state, rin AS rent_asked_inside, round(rask / ((rlo + rhi) / 2), 6) AS rent_asked_ratio,
 round((greatest(slo - sask, 0) + greatest(sask - shi, 0)) / ((slo + shi) / 2), 6) AS sale_asked_distance, CASE WHEN ratio < 0.95 THEN 'LOWER' WHEN ratio > 1.05 THEN 'HIGHER' ELSE 'SAME' END AS size_direction, round(ln(1 + abs(size - wanted)), 6) AS log_size_gap, round(ln(1 + message), 6) AS log_message,
 CASE mode WHEN 'rent' THEN sask IS NULL WHEN 'sale' THEN rask IS NULL WHEN 'both' THEN coalesce(rask, sask) IS NOT NULL ELSE false END AS mode_consistent,
 CAST(coalesce(abs(ratio - 1) > 0.1, false) AS INT) + CAST(ra AND coalesce(NOT rin, false) AS INT) + CAST(sa AND coalesce(NOT si, false) AS INT) AS need_changes,
 round((2.0 + CAST(ra AND rask IS NOT NULL AS INT) + CAST(sa AND sask IS NOT NULL AS INT)) / (2 + CAST(ra AS INT) + CAST(sa AS INT)) - before, 6) AS completeness_gain FROM y""")
def change_features(spark: SparkSession, d: str) -> DataFrame:
    """What each line item, as an enquiry, changes of what was known before."""
    li, k = load_table(spark, d, "lineitem"), F.col("l_linenumber") % 4
    rows = li.select("l_orderkey", "l_linenumber", F.when(k == 0, "rent").when(k == 1, "sale").when(k == 2, "both").alias("mode"), (F.col("l_tax") * 500).alias("wanted"), F.col("l_quantity").alias("size"), F.col("l_partkey").alias("message"), F.col("l_discount").alias("before"), F.when(F.col("l_partkey") % 5 > 0, 10.0).alias("rlo"), F.lit(20.0).alias("rhi"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_quantity")).alias("rask"), F.lit(1000.0).alias("slo"), F.lit(50000.0).alias("shi"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_extendedprice")).alias("sask"))
    f = X.change_features(rows, "mode", "wanted", "size", "message", {"rent": ("rlo", "rhi", "rask"), "sale": ("slo", "shi", "sask")}, ["size", "message"], "before")
    return f.select("l_orderkey", "l_linenumber", "rent_asked_state", "rent_asked_inside", "size_direction", "mode_consistent", "need_changes", *r6("rent_asked_ratio", "sale_asked_distance", "log_size_gap", "log_message", "completeness_gain"))


@query("""WITH s AS (SELECT o_orderkey, (CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2.0 ELSE 0 END + CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0 END + CASE WHEN o_orderstatus <> 'P' THEN 2.0 ELSE 0 END) AS pts FROM orders) SELECT o_orderkey, round(pts / 5, 6) AS rule, round(1 / (1 + exp(-(ln(0.25 / 0.75) + 0.3 * (pts - 2)))), 6) AS moved FROM s""")
def business_rule(spark: SparkSession, d: str) -> DataFrame:
    s = X.rule_score((2, F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")), (1, F.col("o_totalprice") > 100000), (2, F.col("o_orderstatus") != "P"))
    return orders(spark, d).select("o_orderkey", F.round(s, 6).alias("rule"), F.round(X.shifted_odds(F.lit(0.25), s * 5), 6).alias("moved"))


@query(f"""WITH a AS ({ASKS}), sn AS ({SNAPSHOTS}), y AS (SELECT ask_id, a.part_id, EXISTS (SELECT 1 FROM sn WHERE sn.part_id = a.part_id AND sn.available AND sn.seen > a.asked_at AND sn.seen <= a.asked_at + INTERVAL 30 DAY) AS free FROM a)
SELECT p_brand AS brand, count(*) AS n, count(*) FILTER (WHERE free) AS hits, round((count(*) FILTER (WHERE free) + 20 * (SELECT avg(CASE WHEN free THEN 1.0 ELSE 0 END) FROM y)) / (count(*) + 20), 6) AS rate FROM y JOIN part ON p_partkey = part_id GROUP BY 1""")
def available_within_30_days(spark: SparkSession, d: str) -> DataFrame:
    """Whether the part asked for is free within 30 days, and its brand's shrunk rate."""
    sn = snapshots(spark, d).filter("available").select("part_id", F.col("at").alias("t"), F.lit(None).cast("long").alias("ask_id"))
    both = asks(spark, d).select("part_id", F.col("asked_at").alias("t"), "ask_id").unionByName(sn)
    labelled = J.next_event(both, "part_id", "t", F.col("ask_id").isNull(), 30).filter("ask_id is not null").withColumn("free", F.col("next_at").isNotNull())
    p = labelled.agg(F.avg(F.col("free").cast("double")).alias("p"))
    g = labelled.join(load_table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand")), "part_id").groupBy("brand").agg(F.count("*").alias("n"), F.count_if("free").alias("hits"))
    return g.join(F.broadcast(p)).select("brand", "n", "hits", F.round(A.shrunk_rate(F.col("hits"), F.col("n"), F.col("p")), 6).alias("rate"))  # a single row


_LABELS = f"""a AS ({ASKS}), sn AS ({SNAPSHOTS}), cur AS (SELECT a.*, sn.available AS now FROM a ASOF JOIN sn ON sn.part_id = a.part_id AND a.asked_at >= sn.seen),
fut AS (SELECT ask_id, bool_or(sn.available) AS later FROM a JOIN sn ON sn.part_id = a.part_id AND sn.seen > a.asked_at AND sn.seen <= a.asked_at + INTERVAL 30 DAY GROUP BY 1),
y AS (SELECT cur.ask_id, asked_at, p_brand AS brand, CAST(now AS INT) AS cur, CASE WHEN now THEN 1 ELSE CAST(later AS INT) END AS y, CASE WHEN now THEN asked_at ELSE asked_at + INTERVAL 30 DAY END AS ripe FROM cur LEFT JOIN fut USING (ask_id) JOIN part ON p_partkey = part_id WHERE now OR later IS NOT NULL),
d AS (SELECT asked_at AS t, row_number() OVER (ORDER BY asked_at) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT asked_at FROM y)),
c AS (SELECT f, (SELECT t FROM d WHERE k = CAST(floor((n - 1) * (f * 0.2)) AS BIGINT) + 1) AS lo, (SELECT t FROM d WHERE k = CAST(floor((n - 1) * CAST((f + 1) * 0.2 AS DOUBLE)) AS BIGINT) + 1) AS hi FROM range(1, 5) AS r(f)),
tr AS (SELECT f, brand, y FROM c JOIN y ON ripe < lo AND cur = 0), g AS (SELECT f, avg(y) AS prior FROM tr GROUP BY 1),
r AS (SELECT f, brand, count(*) AS n, CAST(sum(y) AS BIGINT) AS hits, (sum(y) + 20 * any_value(prior)) / (count(*) + 20) AS rate, any_value(prior) AS prior FROM tr JOIN g USING (f) GROUP BY 1, 2)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    brand = load_table(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"))
    return V.availability_labels(asks(spark, d), snapshots(spark, d), "part_id", "asked_at", "at", "available", "snap_id").join(brand, "part_id")


@query(f"""WITH {_LABELS} SELECT CAST(f AS INT) AS fold, brand, n, hits, round(prior, 6) AS prior, round(rate, 6) AS rate FROM r""")
def availability_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates by brand at which parts not free become free within 30 days, in each of four expanding folds from the labels matured before it."""
    y = settled(_labelled(spark, d), "labels")
    rates = V.matured_rates(y, "brand", V.expanding_cuts(y, "asked_at"))
    return rates.filter("n > 0").select("fold", "brand", "n", "hits", *r6("prior", "rate"))


@query(f"""WITH {_LABELS}, s AS (SELECT c.f, y.y, CASE WHEN cur = 1 THEN 1.0 ELSE coalesce(r.rate, g.prior) END AS p FROM c JOIN y ON asked_at >= lo AND asked_at <= hi LEFT JOIN r ON r.f = c.f AND r.brand = y.brand LEFT JOIN g ON g.f = c.f),
k AS (SELECT f, y, p, rank() OVER (PARTITION BY f ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY f, round(p, 9)) - 1) / 2.0 AS rk FROM s)
SELECT CAST(f AS INT) AS fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg((p - y) * (p - y)), 6) AS brier, round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS roc_auc FROM k GROUP BY 1""")
def availability_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well these rates foretell availability in their own folds."""
    y = settled(_labelled(spark, d), "labels")
    s = settled(V.matured_scores(y, "brand", "asked_at", V.expanding_cuts(y, "asked_at")).select("fold", "target", F.round("p", 9).alias("p")), "scores")
    ranked, errors = M.ranking_metrics(s, "target", "p", ("fold",)), M.error_metrics(s, "target", "p", ("fold",))
    return ranked.join(errors.select("fold", "brier"), "fold").select("fold", F.col("n_rows").alias("n"), F.col("positives").cast("long").alias("positives"), *r6("brier", "roc_auc"))


@query(f"""WITH a AS ({ASKS}), f AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY asked_at, ask_id) AS n FROM a), o AS (SELECT f.lead, f.asked_at, CAST(f.st = 'F' AS INT) AS first_hit, CAST(coalesce(bool_or(x.st = 'F'), false) AS INT) AS any_hit FROM f JOIN a x ON x.lead = f.lead AND x.asked_at >= f.asked_at AND x.asked_at <= f.asked_at + INTERVAL 30 DAY WHERE f.n = 1 GROUP BY ALL)
SELECT count(*) AS n, CAST(sum(first_hit) AS BIGINT) AS first_event, CAST(sum(any_hit) AS BIGINT) AS any_in_window FROM o""")
def target_options(spark: SparkSession, d: str) -> DataFrame:
    """First event's outcome against any outcome within 30 days of it."""
    a = asks(spark, d)
    first = H.first_per_key(a, "lead", "asked_at", "ask_id").select("lead", "asked_at", F.col("st").alias("first_st"))
    j = J.interval_join(first, a.select("lead", F.col("asked_at").alias("t"), "st"), "lead", "asked_at", "t", 30, "both", "inner")
    o = j.groupBy("lead", "asked_at", "first_st").agg(A.any_of(F.col("st") == "F").alias("any_hit"))
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("first_st") == "F").alias("first_event"), F.count_if("any_hit").alias("any_in_window"))


@query(f"""WITH s AS ({SCORED}), m AS (SELECT segment, 'p' AS model, avg((p - y) * (p - y)) AS b FROM s GROUP BY 1 UNION ALL SELECT segment, 'p2', avg((p2 - y) * (p2 - y)) FROM s GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY b, model) AS k FROM m) SELECT segment, model, round(b, 6) AS brier FROM r WHERE k = 1""")
def best_model_by_stage(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    both = [M.error_metrics(s, "y", m, ("segment",)).select("segment", F.lit(m).alias("model"), (-F.col("brier")).alias("quality")) for m in ("p", "p2")]
    best = X.best_by_stage(both[0].unionByName(both[1]), "segment", "model", "quality")
    return best.select("segment", "model", F.round(-F.col("quality"), 6).alias("brier"))


@query(f"""WITH s AS ({SCORED}) SELECT lead, round(max(p), 6) AS best, round(1 - exp(sum(ln(greatest(1e-12, 1 - p)))), 6) AS any_success FROM s GROUP BY 1""")
def joint_success(spark: SparkSession, d: str) -> DataFrame:
    """A lead's best score, and the chance that any of its enquiries succeeds."""
    miss = F.sum(F.log(F.greatest(F.lit(1e-12), 1 - F.col("p"))))
    return scored(spark, d).groupBy("lead").agg(F.max("p").alias("best"), (1 - F.exp(miss)).alias("any_success")).select("lead", *r6("best", "any_success"))


@query(f"""WITH a AS ({ASKS}), f AS (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY asked_at, ask_id) AS n FROM a) SELECT 'L' || lead || ':T1:I' || ask_id AS score_id, 'T1' AS stage FROM f WHERE n = 1 UNION ALL SELECT 'L' || lead || ':T2:I' || ask_id, 'T2' FROM f WHERE n > 1 UNION ALL SELECT 'L' || c_custkey || ':T0', 'T0' FROM customer""")
def score_spine(spark: SparkSession, d: str) -> DataFrame:
    """One row per scoring moment of every lead."""
    p = H.position_in_key(asks(spark, d), "lead", "asked_at", "ask_id")
    stage = F.when(F.col("position") == 1, "T1").otherwise("T2")
    later = p.select(F.format_string("L%d:%s:I%d", "lead", stage, "ask_id").alias("score_id"), stage.alias("stage"))
    return later.unionByName(load_table(spark, d, "customer").select(F.format_string("L%d:T0", "c_custkey").alias("score_id"), F.lit("T0").alias("stage")))
