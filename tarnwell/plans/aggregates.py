"""Grouped statistics, audits and exploratory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import aggregates as A
from tarnwell.operators import audit as U
from tarnwell.operators.ordering import exact_quantiles
from tarnwell.operators.quantiles import grouped_quantiles
from tarnwell.plans.registry import ASKS, SCORED, asks, events, orders, query, r6, scored
from tarnwell.sources.tables import load_table

_DEC = [0.25, 0.5, 0.75]


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def grouped_summary(spark: SparkSession, d: str) -> DataFrame:
    p, o = F.col("o_totalprice"), orders(spark, d)
    middle = grouped_quantiles(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}).select("o_orderpriority", F.round("median", 4).alias("median"))
    return middle.join(o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.min(p), 4).alias("lo"), F.round(F.max(p), 4).alias("hi"), F.count_distinct("o_custkey").alias("customers"), F.round(F.sum(p), 2).alias("total")), "o_orderpriority")


@query("""SELECT user_id, bool_or(coalesce(event_type = 'purchase', false)) AS bought, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, count(value) AS n_values, count(*) AS n FROM events GROUP BY 1""")
def conditional_rates(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return events(spark, d).groupBy("user_id").agg(A.any_of(e == "purchase").alias("bought"), F.round(A.rate(e == "error"), 6).alias("error_rate"), F.count("value").alias("n_values"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, v) AS k FROM c)
SELECT o_custkey, v AS mode, n AS mode_count FROM r WHERE k = 1""")
def modal_priority(spark: SparkSession, d: str) -> DataFrame:
    return A.mode(orders(spark, d), ["o_custkey"], "o_orderpriority")


@query("""WITH c AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n, min((o_orderdate, o_orderkey)) AS used FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, used) AS k FROM c)
SELECT o_custkey, v AS mode, n AS mode_count FROM r WHERE k = 1""")
def earliest_modal_priority(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's most frequent priority, on ties the one used first."""
    return A.first_mode(orders(spark, d), ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey")


@query("""SELECT round(quantile_cont(l_extendedprice, 0.25), 4) AS q25, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.75), 4) AS q75, l_returnflag FROM lineitem GROUP BY l_returnflag""")
def linear_quantiles(spark: SparkSession, d: str) -> DataFrame:
    names = {f"q{int(x * 100)}": x for x in _DEC}
    return grouped_quantiles(load_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", names).select("l_returnflag", *[F.round(n, 4).alias(n) for n in names])


@query("""WITH r AS (SELECT l_returnflag, l_quantity AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, v AS p90 FROM r WHERE i = floor(0.9 * (n - 1) + 0.5)""")
def nearest_quantile(spark: SparkSession, d: str) -> DataFrame:
    return A.quantile_nearest(load_table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.9, "p90")


_NUM = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query(f"""WITH x AS ({_NUM}), s AS (SELECT "column", count(*) AS n, count(*) FILTER (WHERE v IS NULL) AS n_missing, avg(v) AS mean, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM x GROUP BY 1)
SELECT s."column", any_value(s.n) AS n, any_value(n_missing) AS n_missing, round(any_value(mean), 4) AS mean, round(any_value(a), 4) AS q25, round(any_value(b), 4) AS q50, round(any_value(c), 4) AS q75, count(*) FILTER (WHERE v < a - 1.5 * (c - a) OR v > c + 1.5 * (c - a)) AS n_outliers FROM s JOIN x ON x."column" = s."column" GROUP BY 1""")
def numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    out = A.numeric_profile(load_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.select("column", "n", "n_missing", *[F.round(c, 4).alias(c) for c in ("mean", "q25", "q50", "q75")], "n_outliers")


@query("""SELECT 'c_custkey' AS "column", count(*) FILTER (WHERE c_custkey IS NULL) AS n_missing, count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL SELECT 'c_name', count(*) FILTER (WHERE c_name IS NULL), count(DISTINCT c_name) FROM customer UNION ALL SELECT 'c_nationkey', count(*) FILTER (WHERE c_nationkey IS NULL), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', count(*) FILTER (WHERE c_acctbal IS NULL), count(DISTINCT c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (WHERE c_mktsegment IS NULL), count(DISTINCT c_mktsegment) FROM customer""")
def missingness(spark: SparkSession, d: str) -> DataFrame:
    return A.missingness(load_table(spark, d, "customer"))


@query("""SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) AS DOUBLE), 6) AS "share_F", round(count(*) FILTER (WHERE o_orderstatus = 'O') / CAST(count(*) AS DOUBLE), 6) AS "share_O", round(count(*) FILTER (WHERE o_orderstatus = 'P') / CAST(count(*) AS DOUBLE), 6) AS "share_P" FROM orders GROUP BY 1""")
def share_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab(orders(spark, d), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]).select("o_orderpriority", "n", *r6("share_F", "share_O", "share_P"))


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def margin_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return A.crosstab_margins(orders(spark, d), "o_orderpriority", "o_orderstatus")


@query("""SELECT o_orderpriority, coalesce(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS "F", coalesce(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS "O", coalesce(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS "P" FROM orders GROUP BY 1""")
def pivoted_counts(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


@query(f"""WITH s AS ({SCORED}), g AS (SELECT avg(y) AS gp FROM s) SELECT segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS k, round((sum(y) + 20 * any_value(gp)) / (count(*) + 20), 6) AS rate,
 round((sum(y) / count(*) + 1.96 * 1.96 / (2 * count(*)) - 1.96 * sqrt(sum(y) / count(*) * (1 - sum(y) / count(*)) / count(*) + 1.96 * 1.96 / (4.0 * count(*) * count(*)))) / (1 + 1.96 * 1.96 / count(*)), 6) AS low,
 round((sum(y) / count(*) + 1.96 * 1.96 / (2 * count(*)) + 1.96 * sqrt(sum(y) / count(*) * (1 - sum(y) / count(*)) / count(*) + 1.96 * 1.96 / (4.0 * count(*) * count(*)))) / (1 + 1.96 * 1.96 / count(*)), 6) AS high FROM s, g GROUP BY 1""")
def shrunk_rates(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d)
    p = s.agg(F.avg("y").alias("p"))
    g = s.groupBy("segment").agg(F.count("*").alias("n"), F.sum("y").alias("k")).join(F.broadcast(p))  # a single row
    lo, hi = A.wilson(F.col("k"), F.col("n"))
    return g.select("segment", "n", "k", F.round(A.shrunk_rate(F.col("k"), F.col("n"), F.col("p")), 6).alias("rate"), F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


@query("""WITH x AS (SELECT 'o_orderstatus=' || o_orderstatus || ' x o_orderpriority=' || o_orderpriority AS cell, o_totalprice > 250000 AS h FROM orders UNION ALL SELECT 'o_orderstatus=' || o_orderstatus || ' x size=' || (o_custkey % 3), o_totalprice > 250000 FROM orders UNION ALL SELECT 'o_orderpriority=' || o_orderpriority || ' x size=' || (o_custkey % 3), o_totalprice > 250000 FROM orders UNION ALL SELECT 'o_orderstatus=' || o_orderstatus || ' x o_orderpriority=' || o_orderpriority || ' x size=' || (o_custkey % 3), o_totalprice > 250000 FROM orders), g AS (SELECT avg(CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0 END) AS p FROM orders)
SELECT cell, count(*) AS n, count(*) FILTER (WHERE h) AS hits, round((count(*) FILTER (WHERE h) + 20 * any_value(p)) / (count(*) + 20), 6) AS rate, round(count(*) FILTER (WHERE h) / CAST(count(*) AS DOUBLE) / any_value(p), 6) AS lift FROM x, g GROUP BY 1 HAVING count(*) >= 50""")
def compatibility_cells(spark: SparkSession, d: str) -> DataFrame:
    """All 2- and 3-way cells in one pass of grouping sets."""
    o = orders(spark, d).withColumn("size", F.col("o_custkey") % 3)
    return A.cells(o, ["o_orderstatus", "o_orderpriority", "size"], F.col("o_totalprice") > 250000).select("cell", "n", "hits", *r6("rate", "lift"))


@query()
def cell_significance(spark: SparkSession, d: str) -> DataFrame:
    """Cells with one-sided p-values and Benjamini-Hochberg q-values."""
    from tarnwell.operators.learned import normal_upper_p

    o = orders(spark, d).withColumn("size", F.col("o_custkey") % 3)
    c = A.cells(o, ["o_orderstatus", "o_orderpriority", "size"], F.col("o_totalprice") > 250000)
    p = F.col("hits") / F.col("n") / F.col("lift")
    z = (F.col("hits") / F.col("n") - p) / F.sqrt(p * (1 - p) / F.col("n"))
    return A.benjamini_hochberg(c.withColumn("p_value", normal_upper_p(z)), "p_value").select("cell", "n", *r6("p_value", "q"))


@query("""SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(stddev_pop(l_quantity), 6) AS sd_pop, round(stddev_samp(l_quantity), 6) AS sd_samp FROM lineitem""")
def correlation_slope(spark: SparkSession, d: str) -> DataFrame:
    q, p = "l_quantity", "l_extendedprice"
    return load_table(spark, d, "lineitem").agg(F.round(F.corr(q, p), 6).alias("corr"), F.round(F.regr_slope(p, q), 4).alias("slope"), F.round(F.stddev_pop(q), 6).alias("sd_pop"), F.round(F.stddev_samp(q), 6).alias("sd_samp"))


_SHARES = "SELECT o_custkey, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS f, avg(CAST(o_orderstatus = 'O' AS DOUBLE)) AS o, avg(CAST(o_orderstatus = 'P' AS DOUBLE)) AS p FROM orders GROUP BY 1"


@query(f"""WITH s AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) AS f, avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END) AS o, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END) AS p FROM orders GROUP BY 1)
SELECT o_custkey, round(-((CASE WHEN f > 0 THEN f * ln(f) ELSE 0 END) + (CASE WHEN o > 0 THEN o * ln(o) ELSE 0 END) + (CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)) / ln(3), 6) AS entropy, CASE WHEN f >= o AND f >= p THEN 'f' WHEN o >= p THEN 'o' ELSE 'p' END AS main FROM s""")
def mix_entropy(spark: SparkSession, d: str) -> DataFrame:
    g = orders(spark, d).groupBy("o_custkey").agg(*[F.avg((F.col("o_orderstatus") == v).cast("double")).alias(v.lower()) for v in "FOP"])
    entropy, top = A.share_entropy(["f", "o", "p"])
    return g.select("o_custkey", F.round(entropy + 0.0, 6).alias("entropy"), top.alias("main"))


@query("""WITH r AS (SELECT o_orderkey, o_orderstatus AS st, o_custkey, 1.0 / count(*) OVER (PARTITION BY o_orderstatus, o_custkey) AS w FROM orders), n AS (SELECT *, w / sum(w) OVER (PARTITION BY st) AS w2 FROM r) SELECT o_orderkey, round(w2 / avg(w2) OVER (), 6) AS weight FROM n""")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return A.balanced_weights(orders(spark, d), "o_orderstatus", "o_custkey").select("o_orderkey", *r6("weight"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS k FROM orders) SELECT o_custkey, list(o_orderkey ORDER BY k) AS cheapest FROM r WHERE k <= 3 GROUP BY 1""")
def ordered_lists(spark: SparkSession, d: str) -> DataFrame:
    return A.ordered_list(orders(spark, d), ["o_custkey"], "o_orderkey", "o_totalprice", "cheapest", 3)


@query(f"""WITH s AS ({SCORED}) SELECT CASE WHEN price <= 50000 THEN '0:<=50000' WHEN price <= 150000 THEN '1:<=150000' WHEN price <= 300000 THEN '2:<=300000' ELSE '3:>300000' END AS band, count(*) AS n, round(avg(y), 6) AS rate FROM s GROUP BY 1""")
def banded_rates(spark: SparkSession, d: str) -> DataFrame:
    return A.banded_rate(scored(spark, d), "price", [50000.0, 150000.0, 300000.0], F.col("y") == 1).select("band", "n", *r6("rate"))


@query("""SELECT coalesce(o_orderstatus, 'TOTAL') AS o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY ROLLUP (o_orderstatus)""")
def rollup_total(spark: SparkSession, d: str) -> DataFrame:
    return A.rollup_total(orders(spark, d), "o_orderstatus", [F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean")])


@query("""SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'ALL' ELSE o_orderstatus END AS stage, round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY GROUPING SETS ((o_orderstatus), ())""")
def score_quantiles(spark: SparkSession, d: str) -> DataFrame:
    long = orders(spark, d).select("o_totalprice", F.explode(F.array("o_orderstatus", F.lit("ALL"))).alias("stage"))
    return grouped_quantiles(long, ["stage"], "o_totalprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}).select("stage", *[F.round(n, 4).alias(n) for n in ("p05", "p50", "p95")])


@query("""SELECT o_custkey, max(o_totalprice) AS best, count(*) AS n FROM orders GROUP BY 1""")
def entity_maximum(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.count("*").alias("n"))


@query("""WITH g AS (SELECT o_orderpriority AS p, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY p) AS t, sum(n) OVER (PARTITION BY v) AS vn, sum(n) OVER () AS al FROM g),
o AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q, quantile_cont(CAST(o_custkey AS DOUBLE), [0.25, 0.5, 0.75]) AS c FROM orders), h AS (SELECT o_orderpriority AS p, quantile_cont(o_totalprice, 0.5) AS q, quantile_cont(CAST(o_custkey AS DOUBLE), 0.5) AS c FROM orders GROUP BY 1),
s AS (SELECT p, 'o_orderstatus=' || v AS signal, CAST(n AS DOUBLE) / t - CAST(vn AS DOUBLE) / al AS strength FROM m WHERE k = 1 UNION ALL SELECT p, 'o_totalprice', (h.q - o.q[2]) / (o.q[3] - o.q[1]) FROM h, o UNION ALL SELECT p, 'o_custkey', (h.c - o.c[2]) / (o.c[3] - o.c[1]) FROM h, o)
SELECT p AS o_orderpriority, signal, round(strength, 6) AS strength, CAST(row_number() OVER (PARTITION BY p ORDER BY abs(strength) DESC, signal) AS INT) AS rank FROM s""")
def profile_signals(spark: SparkSession, d: str) -> DataFrame:
    found = A.profile_signals(orders(spark, d), "o_orderpriority", ["o_orderstatus"], ["o_totalprice", "o_custkey"])
    return found.select("o_orderpriority", "signal", "rank", *r6("strength"))


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS rate FROM orders GROUP BY 1""")
def monthly_volume(spark: SparkSession, d: str) -> DataFrame:
    return U.volume_by_period(orders(spark, d), "o_orderdate", F.col("o_orderstatus") == "F").select("period", "n", *r6("rate"))


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS period, count(*) AS n, round(avg(CASE WHEN o_orderdate IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage, round(quantile_cont(date_diff('day', o_orderdate, l_shipdate), 0.5), 4) AS median_lag, round(quantile_cont(date_diff('day', o_orderdate, l_shipdate), 0.9), 4) AS p90_lag FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'P' GROUP BY 1""")
def monthly_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    li = load_table(spark, d, "lineitem").join(o, "l_orderkey", "left")
    return U.coverage_by_period(li, "l_shipdate", "o_orderdate", F.datediff("l_shipdate", "o_orderdate").cast("double")).select("period", "n", *r6("coverage"), *[F.round(c, 4).alias(c) for c in ("median_lag", "p90_lag")])


@query("""SELECT 'customer key' AS check_name, CAST(count(*) - count(DISTINCT c_custkey) AS BIGINT) AS value, CAST(0 AS BIGINT) AS expected, count(*) = count(DISTINCT c_custkey) AS passed FROM customer
UNION ALL SELECT 'line and part', CAST(count(*) - count(DISTINCT (l_partkey, l_shipdate)) AS BIGINT), 0, count(*) = count(DISTINCT (l_partkey, l_shipdate)) FROM lineitem
UNION ALL SELECT 'orders without customer', count(*), 0, count(*) = 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'shipped before ordered', count(*), 0, count(*) = 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'negative prices', count(*), 0, count(*) = 0 FROM orders WHERE o_totalprice < 0""")
def raw_audit(spark: SparkSession, d: str) -> DataFrame:
    o, li, c = orders(spark, d), load_table(spark, d, "lineitem"), load_table(spark, d, "customer")
    return U.checks(
        U.key_check(c, "customer key", "c_custkey"),
        U.key_check(li, "line and part", "l_partkey", "l_shipdate"),
        U.orphan_check(o, c, "orders without customer", "o_custkey", "c_custkey"),
        U.count_check(li.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "shipped before ordered", F.col("l_shipdate") < F.col("o_orderdate")),
        U.count_check(o, "negative prices", F.col("o_totalprice") < 0),
    )


@query("""SELECT count(*) AS n, round(quantile_cont(abs(l_extendedprice - l_quantity * p_retailprice) / l_extendedprice, 0.5), 6) AS median_error, round(quantile_cont(abs(l_extendedprice - l_quantity * p_retailprice) / l_extendedprice, 0.95), 6) AS p95_error FROM lineitem JOIN part ON p_partkey = l_partkey""")
def price_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    j = load_table(spark, d, "lineitem").join(load_table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return U.price_arithmetic(j, F.col("l_extendedprice"), F.col("p_retailprice"), F.col("l_quantity")).select("n", *r6("median_error", "p95_error"))


@query(f"""WITH a AS ({ASKS}) SELECT round(avg(CASE WHEN a.lead % 7 = a.part_id % 7 THEN 1.0 ELSE 0 END), 6) AS same_sector, round(avg(CASE WHEN a.lead % 25 = a.part_id % 25 THEN 1.0 ELSE 0 END), 6) AS same_place FROM a""")
def stated_vs_offered(spark: SparkSession, d: str) -> DataFrame:
    a = asks(spark, d)
    out = U.consistency(a, {"same_sector": (F.col("lead") % 7, F.col("part_id") % 7), "same_place": (F.col("lead") % 25, F.col("part_id") % 25)})
    return out.select(*r6("same_sector", "same_place"))


@query("""SELECT c_custkey, CASE WHEN substr(sha256('s1|' || c_custkey), 1, 1) < '8' THEN 'treatment' ELSE 'control' END AS arm FROM customer""")
def sticky_assignment(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "customer").select("c_custkey", X.sticky_arm("s1", F.col("c_custkey")).alias("arm"))


@query("""WITH a AS (SELECT CASE WHEN substr(sha256('s1|' || c_custkey), 1, 1) < '8' THEN 1 ELSE 0 END AS t FROM customer) SELECT count(*) AS n, CAST(sum(t) AS BIGINT) AS t, round((sum(t) - count(*) * 0.5) / sqrt(count(*) * 0.25), 6) AS z FROM a""")
def sample_ratio(spark: SparkSession, d: str) -> DataFrame:
    return U.srm_z(sticky_assignment(spark, d), "arm").select("n", "t", *r6("z"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN value IS NULL THEN NULL WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'mid' ELSE 'high' END AS band, round(ln(1 + greatest(value, 0)), 6) AS log_value, CAST(hour(ts) AS INT) AS hour, dayname(ts) AS day, CAST(isodow(ts) - 1 AS INT) AS weekday, event_type || ' x ' || hour(ts) AS cell FROM events""")
def scalar_features(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return events(spark, d).select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), X.right_closed(v, [10.0, 50.0], ["low", "mid", "high"]).alias("band"), F.round(F.log1p(F.greatest(v, F.lit(0.0))), 6).alias("log_value"),
        F.hour("ts").alias("hour"), F.date_format("ts", "EEEE").alias("day"), F.weekday("ts").alias("weekday"), F.concat_ws(" x ", "event_type", F.hour("ts").cast("string")).alias("cell"),
    )


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 6) AS unit, CASE WHEN l_quantity BETWEEN 10 AND 20 THEN true ELSE false END AS inside, round((greatest(10 - l_quantity, 0) + greatest(l_quantity - 20, 0)) / 15, 6) AS distance, round(CASE WHEN l_quantity > 20 THEN 20 / l_quantity WHEN l_quantity < 10 THEN l_quantity / 10 ELSE 1 END, 6) AS budget_fit, round(exp(-abs(ln(l_quantity / 15))), 6) AS area_fit, round(greatest(0, 1 - abs(l_quantity - 15) / 15), 6) AS gap_fit FROM lineitem""")
def interval_features(spark: SparkSession, d: str) -> DataFrame:
    q, lo, hi = F.col("l_quantity"), F.lit(10.0), F.lit(20.0)
    return load_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(X.safe_ratio(F.col("l_extendedprice"), q), 6).alias("unit"), X.within_interval(q, lo, hi).alias("inside"), F.round(X.interval_distance(q, lo, hi), 6).alias("distance"),
        F.round(X.budget_fit(q, lo, hi), 6).alias("budget_fit"), F.round(X.ratio_fit(q, F.lit(15.0)), 6).alias("area_fit"), F.round(X.gap_fit(q, F.lit(15.0)), 6).alias("gap_fit"),
    )


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) AS a, quantile_cont(l_extendedprice, 0.98) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a), b), 4) AS price FROM lineitem, q""")
def winsorized(spark: SparkSession, d: str) -> DataFrame:
    li = load_table(spark, d, "lineitem")
    low, high = exact_quantiles(li, ["l_extendedprice"], [0.02, 0.98])["l_extendedprice"] or (None, None)
    return li.select("l_orderkey", "l_linenumber", F.round(F.least(F.greatest("l_extendedprice", F.lit(low)), F.lit(high)), 4).alias("price"))
