"""Metrics, calibration, drift, bootstrap and learned queries over the scored population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import audit as U
from tarnwell.operators import forests as R
from tarnwell.operators import inventory as I
from tarnwell.operators import learned as L
from tarnwell.operators import metrics as M
from tarnwell.plans.registry import SCORED, orders, query, r6, scored

_RANK = f"""s AS ({SCORED}), g AS (SELECT p AS s, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp, coalesce(sum(n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn, sum(pos) OVER () AS pp, sum(n) OVER () AS nn FROM g)"""


def _share(s: float) -> str:
    n = round(s * 100)
    hits = f"sum(CAST(pos AS DOUBLE) * greatest(0, least(n, greatest(1, ceil(round(nn * {s}, 9))) - bn)) / n)"
    k = f"max(greatest(1, ceil(round(nn * {s}, 9))))"
    return f"round({hits} / {k}, 6) AS precision_{n}, round({hits} / max(pp), 6) AS recall_{n}, round({hits} / {k} / max(CAST(pp AS DOUBLE) / nn), 6) AS lift_{n}"


_METRICS = ["roc_auc", "average_precision", *[f"{m}_{k}" for k in (5, 10, 20) for m in ("precision", "recall", "lift")]]


@query(f"""WITH {_RANK} SELECT CAST(max(nn) AS BIGINT) AS n_rows, CAST(max(pp) AS BIGINT) AS positives, round(sum(CAST(pos AS DOUBLE) * (nn - pp - (bn - bp) - (n - pos) + (n - pos) / 2.0)) / (max(pp) * (max(nn) - max(pp))), 6) AS roc_auc,
 round(sum(CAST(pos AS DOUBLE) * (bp + pos) / (bn + n)) / max(pp), 6) AS average_precision, {_share(0.05)}, {_share(0.10)}, {_share(0.20)} FROM w""")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AUC, average precision, precision, recall and lift with ties shared."""
    return M.ranking_metrics(scored(spark, d), "y", "p").select("n_rows", "positives", *r6(*_METRICS))


_SEG = f"""s AS ({SCORED}), x AS (SELECT 'segment' AS segment, segment AS value, p, y FROM s UNION ALL SELECT 'st', st, p, y FROM s), g AS (SELECT segment, value, p AS s, sum(y) AS pos, count(*) AS n FROM x GROUP BY ALL),
w AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY segment, value ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp, coalesce(sum(n) OVER (PARTITION BY segment, value ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn, sum(pos) OVER (PARTITION BY segment, value) AS pp, sum(n) OVER (PARTITION BY segment, value) AS nn FROM g)"""


@query(f"""WITH {_SEG} SELECT segment, value, CAST(max(nn) AS BIGINT) AS n_rows, round(sum(CAST(pos AS DOUBLE) * (nn - pp - (bn - bp) - (n - pos) + (n - pos) / 2.0)) / (max(pp) * (max(nn) - max(pp))), 6) AS roc_auc, {_share(0.10)} FROM w GROUP BY 1, 2 HAVING max(nn) >= 100 AND max(pp) > 0 AND max(pp) < max(nn)""")
def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.segment_metrics(scored(spark, d), "y", "p", ["segment", "st"]).select("segment", "value", "n_rows", *r6("roc_auc", "precision_10", "recall_10", "lift_10"))


@query(f"""WITH s AS ({SCORED}), g AS (SELECT date_part('year', seen) AS fold, avg((p - y) * (p - y)) AS b FROM s GROUP BY 1) SELECT count(*) AS n_groups, round(avg(b), 6) AS macro_brier FROM g""")
def macro_brier(spark: SparkSession, d: str) -> DataFrame:
    per = M.error_metrics(scored(spark, d).withColumn("fold", F.year("at")), "y", "p", ("fold",))
    return M.macro_mean(per, ["brier"]).select("n_groups", *r6("macro_brier"))


@query(f"""WITH s AS ({SCORED}) SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-8), 1 - 1e-8)) + (1 - y) * ln(1 - least(greatest(p, 1e-8), 1 - 1e-8)))), 6) AS log_loss FROM s""")
def error_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.error_metrics(scored(spark, d), "y", "p").select(*r6("brier", "log_loss"))


@query(f"""WITH {_RANK}, t AS (SELECT (bp + pos) / CAST(pp AS DOUBLE) AS r, bp / CAST(pp AS DOUBLE) AS r0, CAST(bp + pos AS DOUBLE) / (bn + n) AS p, CASE WHEN bn > 0 THEN CAST(bp AS DOUBLE) / bn ELSE 1 END AS p0 FROM w) SELECT round(sum((r - r0) * (p + p0) / 2), 6) AS pr_auc FROM t""")
def pr_auc_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return M.pr_auc_trapezoid(scored(spark, d), "y", "p").select(*r6("pr_auc"))


@query(f"""WITH {_RANK}, st AS (SELECT unnest(range(1, 21)) AS step), z AS (SELECT step, greatest(1, ceil(round(nn * step / 20.0, 9))) AS k, * FROM w, st)
SELECT CAST(step AS INT) AS step, round(step / 20.0, 6) AS share, round(sum(CAST(pos AS DOUBLE) * greatest(0, least(n, k - bn)) / n) / max(pp), 6) AS recall, round(sum(CAST(pos AS DOUBLE) * greatest(0, least(n, k - bn)) / n) / max(k) / max(CAST(pp AS DOUBLE) / nn), 6) AS lift FROM z GROUP BY step""")
def gains_table(spark: SparkSession, d: str) -> DataFrame:
    return M.gains_table(scored(spark, d), "y", "p").select("step", *r6("share", "recall", "lift"))


@query(f"""WITH s AS ({SCORED}), e AS (SELECT [quantile_cont(p, 0.1), quantile_cont(p, 0.2), quantile_cont(p, 0.3), quantile_cont(p, 0.4), quantile_cont(p, 0.5), quantile_cont(p, 0.6), quantile_cont(p, 0.7), quantile_cont(p, 0.8), quantile_cont(p, 0.9)] AS q FROM s)
SELECT CAST(1 + len(list_filter(q, lambda x: x < p)) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(y), 6) AS rate FROM s, e GROUP BY 1""")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration_table(scored(spark, d), "y", "p").select("bin", "n", *r6("mean_score", "rate"))


@query()
def calibration_line(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration_line(scored(spark, d), "y", "p").select(*r6("intercept", "slope"))


_HALVES = f"s AS ({SCORED}), r AS (SELECT * FROM s WHERE seen < TIMESTAMP '1995-06-01'), c AS (SELECT * FROM s WHERE seen >= TIMESTAMP '1995-06-01')"


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = scored(spark, d)
    cut = F.lit("1995-06-01").cast("timestamp")
    return s.filter(F.col("at") < cut), s.filter(F.col("at") >= cut)


@query(f"""WITH {_HALVES}, e AS (SELECT [min(price), quantile_cont(price, 0.1), quantile_cont(price, 0.2), quantile_cont(price, 0.3), quantile_cont(price, 0.4), quantile_cont(price, 0.5), quantile_cont(price, 0.6), quantile_cont(price, 0.7), quantile_cont(price, 0.8), quantile_cont(price, 0.9), max(price)] AS q FROM r),
b AS (SELECT 'r' AS k, least(10, len(list_filter(q, lambda x: x <= price))) AS b FROM r, e UNION ALL SELECT 'c', least(10, len(list_filter(q, lambda x: x <= price))) FROM c, e WHERE price BETWEEN q[1] AND q[11]),
t AS (SELECT i, greatest(1e-6, count(*) FILTER (WHERE k = 'r') / CAST((SELECT count(*) FROM b WHERE k = 'r') AS DOUBLE)) AS r, greatest(1e-6, count(*) FILTER (WHERE k = 'c') / CAST((SELECT count(*) FROM b WHERE k = 'c') AS DOUBLE)) AS c FROM range(1, 11) x(i) LEFT JOIN b ON b.b = i GROUP BY 1)
SELECT round(sum((c - r) * ln(c / r)), 6) AS psi FROM t""")
def population_stability(spark: SparkSession, d: str) -> DataFrame:
    return M.psi(*_halves(spark, d), "price").select(*r6("psi"))


@query(f"""WITH {_HALVES}, a AS (SELECT segment AS v, count(*) / CAST((SELECT count(*) FROM r) AS DOUBLE) AS p FROM r GROUP BY 1), b AS (SELECT segment AS v, count(*) / CAST((SELECT count(*) FROM c) AS DOUBLE) AS q FROM c GROUP BY 1), f AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM a FULL JOIN b USING (v))
SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) / 2 + sum(CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 6) AS js FROM f""")
def category_divergence(spark: SparkSession, d: str) -> DataFrame:
    return M.categorical_js(*_halves(spark, d), "segment").select(*r6("js"))


@query(f"""WITH {_HALVES}, q AS (SELECT quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS iqr FROM r), v AS (SELECT price AS x, count(*) AS r, 0 AS c FROM r GROUP BY 1 UNION ALL SELECT price, 0, count(*) FROM c GROUP BY 1), m AS (SELECT x, sum(r) AS r, sum(c) AS c FROM v GROUP BY 1),
w AS (SELECT x, lag(x) OVER (ORDER BY x) AS x0, coalesce(sum(r) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(r) OVER () AS DOUBLE) AS f, coalesce(sum(c) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / CAST(sum(c) OVER () AS DOUBLE) AS g FROM m)
SELECT round(sum(abs(f - g) * (x - x0)) / any_value(iqr), 6) AS wasserstein_iqr, round(0.0, 6) AS missing_delta FROM w, q""")
def numeric_drift(spark: SparkSession, d: str) -> DataFrame:
    return M.numeric_drift(*_halves(spark, d), "price").select(*r6("wasserstein_iqr", "missing_delta"))


@query(f"""WITH s AS ({SCORED}), c AS (SELECT count(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND p < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p < 0.5) AS tn FROM s)
SELECT tp, fp, fn, tn, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(scored(spark, d).withColumn("yhat", (F.col("p") >= 0.5).cast("int")), "y", "yhat").select("tp", "fp", "fn", "tn", *r6("precision", "recall", "f1"))


@query(f"""WITH s AS ({SCORED}), q AS (SELECT quantile_cont(p, 0.9) AS c FROM s WHERE seen < TIMESTAMP '1995-06-01') SELECT CASE WHEN p >= c AND y = 1 THEN 'TP' WHEN p >= c THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS error_type, count(*) AS n FROM s, q GROUP BY 1""")
def error_types(spark: SparkSession, d: str) -> DataFrame:
    out = M.error_types(scored(spark, d), "y", "p", F.col("at") < F.lit("1995-06-01").cast("timestamp"))
    return out.groupBy("error_type").agg(F.count("*").alias("n"))


def _by_fold(p: str, name: str) -> str:
    """SQL of n, average precision and Brier score by year and segment."""
    return f"""{name}g AS (SELECT date_part('year', seen) AS fold, segment, {p} AS s, sum(y) AS pos, count(*) AS n, sum(({p} - y) * ({p} - y)) AS sq FROM s GROUP BY ALL),
{name}w AS (SELECT *, sum(pos) OVER (PARTITION BY fold, segment ORDER BY s DESC) AS cp, sum(n) OVER (PARTITION BY fold, segment ORDER BY s DESC) AS cn, sum(pos) OVER (PARTITION BY fold, segment) AS pp FROM {name}g),
{name} AS (SELECT fold, segment, sum(n) AS n, sum(CASE WHEN pp > 0 THEN CAST(pos AS DOUBLE) / pp * cp / cn END) AS ap, sum(sq) / sum(n) AS brier FROM {name}w GROUP BY 1, 2)"""


@query(f"""WITH s AS ({SCORED}), {_by_fold("p", "a")}, {_by_fold("p2", "b")}, j AS (SELECT a.segment, coalesce(a.n = b.n AND a.n >= 100, false) AS ok, coalesce(b.ap - a.ap < -0.02 OR b.brier - a.brier > 0.02, false) AS bad FROM a JOIN b USING (fold, segment))
SELECT segment, count(*) FILTER (WHERE ok AND bad) AS n_worse, count(*) FILTER (WHERE ok) AS n_folds, count(*) FILTER (WHERE NOT ok) AS n_skipped, count(*) FILTER (WHERE ok AND bad) >= 2 AS collapsed FROM j GROUP BY 1""")
def segment_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Segments in which the second score falls behind the first in two years or more."""
    s = scored(spark, d).withColumn("fold", F.year("at"))
    by = ("fold", "segment")
    base, other = (M.ranking_metrics(s, "y", c, by).select(*by, "n_rows", "average_precision").join(M.error_metrics(s, "y", c, by).select(*by, "brier"), list(by)) for c in ("p", "p2"))
    return M.collapse_guard(base, other, ["segment"])


@query(f"""WITH s AS ({SCORED}), m AS (SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM s) SELECT 'brier' AS gate, brier AS value, CAST(0.25 AS DOUBLE) AS "limit", brier <= 0.25 AS passed FROM m""")
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    m = M.error_metrics(scored(spark, d), "y", "p").select(*r6("brier"))
    return U.gates(m, {"brier": ("<=", 0.25)})


@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, true AS moved FROM orders""")
def permutation_keeps_values(spark: SparkSession, d: str) -> DataFrame:
    """A column dealt to other rows keeps its values, and nearly all rows get another one."""
    o = orders(spark, d).select("o_orderkey", "o_totalprice", F.col("o_totalprice").alias("before"))
    return M.permuted(o, "o_totalprice").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), (F.avg((F.col("before") != F.col("o_totalprice")).cast("double")) > 0.9).alias("moved"))


@query(f"""WITH s AS ({SCORED}), r AS (SELECT y, row_number() OVER (ORDER BY p DESC, id) AS k, count(*) OVER () AS n, sum(y) OVER () AS t FROM s), c(s) AS (VALUES (0.05), (0.1), (0.15), (0.2))
SELECT CAST(s AS DOUBLE) AS capacity, CAST(ceil(max(n) * s) AS BIGINT) AS n, CAST(sum(CASE WHEN k <= ceil(n * s) THEN y ELSE 0 END) AS BIGINT) AS caught, round(sum(CASE WHEN k <= ceil(n * s) THEN y ELSE 0 END) / CAST(max(t) AS DOUBLE), 6) AS recall FROM r, c GROUP BY s""")
def capacity_frontier(spark: SparkSession, d: str) -> DataFrame:
    return I.capacity_frontier(scored(spark, d), "p", "y", "id").select("capacity", "n", "caught", *r6("recall"))


@query(f"""WITH s AS ({SCORED}) SELECT id, round(1 / (1 + exp(-(-1.3654809238334253 + -0.07879291027743833 * (p - 0.2274559337248017) / 0.27123990277928095 + -0.023995826779180347 * (p2 - 0.242284798534798) / 0.39717343361063623))), 8) AS q FROM s""")
def frozen_logistic(spark: SparkSession, d: str) -> DataFrame:
    """A frozen model as one expression."""
    # fixed values of the frozen model: intercept, coefficient, mean, spread, fill
    q = X.logistic(-1.3654809238334253, [(-0.07879291027743833, F.col("p"), 0.2274559337248017, 0.27123990277928095, 0.2), (-0.023995826779180347, F.col("p2"), 0.242284798534798, 0.39717343361063623, 0.0)])
    return scored(spark, d).select("id", F.round(q, 8).alias("q"))


@query()
def logistic_model(spark: SparkSession, d: str) -> DataFrame:
    """A regularised logistic model fitted before a date, scored after it by its coefficients as one expression."""
    train, test = _halves(spark, d)
    q = L.fit_logistic(train, "y", ["segment"], ["price", "p"])
    return M.ranking_metrics(test.withColumn("q", q), "y", "q").select("n_rows", "positives", "roc_auc", "lift_10")


@query()
def calibrated_scores(spark: SparkSession, d: str) -> DataFrame:
    """Platt and isotonic recalibration on the earlier half, errors on the later one."""
    validation, test = _halves(spark, d)
    a = M.error_metrics(L.platt(validation, test, "y", "p"), "y", "calibrated").select(F.lit("platt").alias("method"), "brier")
    b = M.error_metrics(L.isotonic(validation, test, "y", "p"), "y", "calibrated").select(F.lit("isotonic").alias("method"), "brier")
    return a.unionByName(b)


@query()
def boosted_model(spark: SparkSession, d: str) -> DataFrame:
    """500 boosted trees of depth 6 before a date, their number chosen on the last of these rows, scored after it."""
    early, test = _halves(spark, d)
    held_out = F.col("at") >= F.lit("1995-05-01").cast("timestamp")
    model = L.fit_boosted(early.filter(~held_out), early.filter(held_out), "y", ["segment"], ["price", "p"])
    return M.ranking_metrics(L.predict(model, test, ["segment"], "q"), "y", "q").select("n_rows", "positives", "roc_auc", "lift_10")


@query()
def customer_profiles(spark: SparkSession, d: str) -> DataFrame:
    """k-means profiles of customers named by size."""
    from tarnwell.sources.tables import load_table

    out = L.cluster(load_table(spark, d, "customer"), "kmeans", 3, ["c_mktsegment"], ["c_acctbal"])
    return out.groupBy("profile").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderpriority AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE o_orderpriority END AS b, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2.0) AS pairs FROM c),
x AS (SELECT sum(s * (s - 1) / 2.0) AS p FROM (SELECT sum(n) AS s FROM c GROUP BY a)), y AS (SELECT sum(s * (s - 1) / 2.0) AS p FROM (SELECT sum(n) AS s FROM c GROUP BY b))
SELECT round((pairs - x.p * y.p / (n * (n - 1) / 2.0)) / ((x.p + y.p) / 2 - x.p * y.p / (n * (n - 1) / 2.0)), 6) AS ari FROM t, x, y""")
def label_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two labelings that differ in a third of the rows."""
    o = orders(spark, d).select(F.col("o_orderpriority").alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("b"))
    return L.adjusted_rand(o, "a", "b").select(*r6("ari"))


@query("""WITH g AS (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS hits, quantile_cont(CAST(date_diff('day', o_orderdate, DATE '1999-01-01') AS DOUBLE), 0.5) AS median_lag, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0 END) AS b, avg(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0 ELSE 0 END) AS c FROM orders GROUP BY 1)
SELECT o_custkey, n, hits, median_lag, round(a, 6) AS urgent, round(b, 6) AS high, round(c, 6) AS medium, round((hits + 10.0) / (n + 20), 6) AS rate, CASE WHEN a >= b AND a >= c THEN 'share_1-URGENT' WHEN b >= c THEN 'share_2-HIGH' ELSE 'share_3-MEDIUM' END AS main,
 round(-(CASE WHEN a > 0 THEN a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c) ELSE 0 END) / ln(3.0), 6) AS entropy FROM g""")
def supply_profiles(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("lag", F.datediff(F.lit("1999-01-01"), "o_orderdate").cast("double"))
    out = L.supply_profile(o, "o_custkey", "lag", F.col("o_orderstatus") == "F", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], 0.5)
    shares = [F.round(F.col(f"`share_{v}`"), 6).alias(name) for v, name in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"))]
    return out.select("o_custkey", "n", "hits", "median_lag", *shares, "main", *r6("rate", "entropy"))


@query()
def extra_trees_model(spark: SparkSession, d: str) -> DataFrame:
    """100 extra trees on the orders of four customers in five, by segment on the fifth: which orders are dear or, if urgent, cheap, from price, day, scores and priority."""
    s = scored(spark, d)
    days = F.datediff("at", F.lit("1992-01-01")).cast("double")
    flags = [(F.col("segment") == v).cast("double") for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
    marked = (F.col("price") > 150000) != F.col("segment").isin("1-URGENT", "2-HIGH")
    rows = s.withColumns({"y": marked.cast("int"), "features": F.array(F.col("price"), days, F.col("p"), F.col("p2"), *flags)})
    held_out = F.pmod(F.xxhash64("lead"), F.lit(5)) == 0
    forest = R.fit_extra_trees(rows.filter(~held_out), "features", "y", 9)
    out = M.ranking_metrics(R.with_score(rows.filter(held_out), "features", forest, "q"), "y", "q", ("segment",))
    return out.select("segment", "n_rows", "positives", *r6("roc_auc", "lift_10"))
