"""Queries on what scores depend on, on their resampled metrics, and on their recalibration, each with SQL that draws and deals alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import calibrate as C
from tarnwell.operators import interpret as P
from tarnwell.operators import quantiles as Q
from tarnwell.operators import resampling as B
from tarnwell.plans.registry import SCORED, query, r6, scored
from tarnwell.sources.tables import load_table, scratch_folder

# ---- a frozen model over the scored population

# fixed values of the frozen model: intercept, and per feature coefficient, mean, spread and fill
_FROZEN = (-0.4, {"p": (1.1, 0.5, 0.29, 0.5), "p2": (-0.6, 0.5, 0.29, 0.5), "price": (0.35, 150000.0, 85000.0, 150000.0)})
_FROZEN_SQL = "1 / (1 + exp(-({} + {})))".format(_FROZEN[0], " + ".join(f"{c} * (coalesce(CAST({{{n}}} AS DOUBLE), {f}) - {m}) / {s}" for n, (c, m, s, f) in _FROZEN[1].items()))
_FROZEN_OF = _FROZEN_SQL.format(p="p", p2="p2", price="price")
#: Feature groups whose values are dealt together.
_GROUPS = {"scores": ["p", "p2"], "price": ["price"], "first": ["p"]}


def _frozen(df: DataFrame) -> DataFrame:
    terms = [(c, F.col(n), m, s, f) for n, (c, m, s, f) in _FROZEN[1].items()]
    return df.withColumn("q", F.round(X.logistic(_FROZEN[0], terms), 9))


def _ranked(table: str, keys: str) -> str:
    """SQL of score tables (keys, s, pos, n) with the counts above each score and the totals."""
    part = f"PARTITION BY {keys} " if keys else ""
    up = f"({part}ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT *, coalesce(sum(pos) OVER {up}, 0) AS bp, coalesce(sum(n) OVER {up}, 0) AS bn, sum(pos) OVER ({part}) AS pp, sum(n) OVER ({part}) AS nn FROM {table}"


_AUC = "sum(pos * (nn - pp - (bn - bp) - (n - pos) + (n - pos) / 2.0)) / (max(pp) * (max(nn) - max(pp)))"
_AP = "sum(pos * (bp + pos) / (bn + n)) / max(pp)"


def _top(share: float) -> tuple[str, str]:
    """SQL of lift and recall at a share."""
    k = f"greatest(1, ceil(round(nn * {share}, 9)))"
    hits = f"sum(pos * greatest(0, least(n, {k} - bn)) / n)"
    return f"{hits} / max({k}) / max(pp / nn)", f"{hits} / max(pp)"


_TASKS = ", ".join(f"('{g}', {r}, '{'|'.join(c)}', {', '.join(str(x in c).lower() for x in _FROZEN[1])})" for g, c in _GROUPS.items() for r in range(3))
_MOVED = _FROZEN_SQL.format(**{n: f"CASE WHEN g_{n} THEN d.{n} ELSE b.{n} END" for n in _FROZEN[1]})


@query(f"""WITH s AS ({SCORED}), b AS (SELECT id, p, p2, price, CAST(y AS DOUBLE) AS y, row_number() OVER (ORDER BY md5('42|' || id), id) - 1 AS place, count(*) OVER () AS n FROM s),
t(feature, repeat, columns, {", ".join(f"g_{n}" for n in _FROZEN[1])}) AS (VALUES {_TASKS}), h AS (SELECT *, sha256('42|' || feature || '|' || repeat) AS x, (SELECT max(n) FROM b) AS n FROM t),
f AS (SELECT *, 1 + CAST('0x' || x[1:8] AS BIGINT) % greatest(1, least(n - 1, 1048576)) AS a0, CAST('0x' || x[9:16] AS BIGINT) % n AS shift FROM h),
g AS (SELECT feature, repeat, columns, {", ".join(f"g_{n}" for n in _FROZEN[1])}, n, shift, (SELECT min(k) FROM (SELECT a0 + unnest(range(0, 200)) AS k) WHERE gcd(k, n) = 1) AS factor FROM f),
m AS (SELECT feature, repeat, columns, round({_MOVED}, 9) AS s, b.y FROM b, g JOIN b AS d ON d.place = (g.factor * b.place + g.shift) % g.n), mt AS (SELECT feature, repeat, columns, s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM m GROUP BY ALL),
mr AS ({_ranked("mt", "feature, repeat, columns")}), mm AS (SELECT feature, repeat, columns, {_AUC} AS auc, {_AP} AS ap FROM mr GROUP BY 1, 2, 3), wt AS (SELECT round({_FROZEN_OF}, 9) AS s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM b GROUP BY 1),
wr AS ({_ranked("wt", "")}), w AS (SELECT {_AUC} AS auc0, {_AP} AS ap0 FROM wr)
SELECT feature, columns, round(avg(ap0 - ap), 6) AS ap_drop_mean, round(stddev_samp(ap0 - ap), 6) AS ap_drop_sd, round(avg(auc0 - auc), 6) AS auc_drop_mean, round(stddev_samp(auc0 - auc), 6) AS auc_drop_sd FROM mm, w GROUP BY 1, 2""")
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """Drops of average precision and AUC of a frozen model where groups of columns are dealt to other rows, three repeats in one job."""
    out = P.permutation_importance(scored(spark, d), "y", _frozen, "q", _GROUPS, "id", repeats=3)
    return out.select("feature", "columns", *r6("ap_drop_mean", "ap_drop_sd", "auc_drop_mean", "auc_drop_sd"))


def _ends(c: str) -> str:
    return f"""SELECT '{c}' AS feature, 'quartiles' AS kind, '<=Q25' AS low_group, any_value(q25) AS low_edge, count(*) FILTER ({c} <= q25) AS low_n, avg(q) FILTER ({c} <= q25) AS low_rate,
 '>=Q75' AS high_group, any_value(q75) AS high_edge, count(*) FILTER ({c} >= q75) AS high_n, avg(q) FILTER ({c} >= q75) AS high_rate FROM m, (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75 FROM m)"""


@query(f"""WITH s AS ({SCORED}), m AS (SELECT *, round({_FROZEN_OF}, 9) AS q FROM s), g AS (SELECT segment AS v, count(*) AS n, avg(q) AS r FROM m WHERE segment IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
x AS ({_ends("p")} UNION ALL {_ends("price")} UNION ALL SELECT 'segment', 'groups', arg_min(v, (r, v)), NULL, arg_min(n, (r, v)), min(r), arg_max(v, (r, v)), NULL, arg_max(n, (r, v)), max(r) FROM g)
SELECT feature, kind, low_group, round(low_edge, 6) AS low_edge, low_n, round(low_rate, 6) AS low_rate, high_group, round(high_edge, 6) AS high_edge, high_n, round(high_rate, 6) AS high_rate, round(100 * (high_rate - low_rate), 6) AS delta_pp FROM x""")
def score_directions(spark: SparkSession, d: str) -> DataFrame:
    """Mean score at both ends of each feature: beyond the quartiles of numbers, in the extreme groups of categories."""
    out = P.directionality(_frozen(scored(spark, d)), "q", ["p", "price"], ["segment"])
    return out.select("feature", "kind", "low_group", "high_group", "low_n", "high_n", *r6("low_edge", "low_rate", "high_edge", "high_rate", "delta_pp"))


_CF = [20000.0, 150000.0, 400000.0]


@query(f"""WITH s AS ({SCORED}), x AS (SELECT 'segment' AS segment, segment AS value, p, p2 FROM s UNION ALL SELECT 'st', st, p, p2 FROM s),
c AS (SELECT segment, value, {", ".join(f"round({_FROZEN_SQL.format(p='p', p2='p2', price=v)}, 9) AS m{k}" for k, v in enumerate(_CF))} FROM x)
SELECT segment, value, count(*) AS n, round(avg(m0), 6) AS mean_0, round(avg(m1), 6) AS mean_1, round(avg(m2), 6) AS mean_2, round(100 * (avg(m0) - avg(m2)), 6) AS delta_pp FROM c GROUP BY 1, 2""")
def counterfactual_prices(spark: SparkSession, d: str) -> DataFrame:
    """Mean scores by segment if all orders had one of three prices."""
    out = P.counterfactual_scores(scored(spark, d), _frozen, "q", "price", _CF, ["segment", "st"])
    return out.select("segment", "value", "n", *r6("mean_0", "mean_1", "mean_2", "delta_pp"))


@query()
def forest_splits(spark: SparkSession, d: str) -> DataFrame:
    """Splits on price in a forest of ten trees: depth, threshold, samples and the features of the last three nodes above."""
    from tarnwell.operators import learned as L

    train = scored(spark, d)
    model = L.fit_classifier(train, "forest", "y", ["segment"], ["price", "p"], numTrees=10, maxDepth=5)
    names = L.feature_names(model, train, ["segment"], ["price", "p"])
    return P.tree_splits(P.tree_nodes(model, scratch_folder(spark, "forest")), dict(enumerate(names)), "price")


# ---- resampled metrics

_POISSON = """po AS (SELECT e, k, coalesce(lag(c) OVER (PARTITION BY e ORDER BY k), 0) AS lo, c AS hi FROM (SELECT e, k, sum(exp(k * ln(m) - m - lgamma(k + 1))) OVER (PARTITION BY e ORDER BY k) AS c FROM (SELECT e, k, pow(2, e) AS m FROM range(0, 9) a(e), range(0, 600) b(k))))"""
_METRIC_SQL = {"roc_auc": _AUC, "average_precision": _AP, "brier": "sum(pos * (1 - s) * (1 - s) + (n - pos) * s * s) / sum(n)", "log_loss": "sum(-(pos * ln(least(greatest(s, 1e-8), 1 - 1e-8)) + (n - pos) * ln(1 - least(greatest(s, 1e-8), 1 - 1e-8)))) / sum(n)", "lift_5": _top(0.05)[0], "lift_10": _top(0.1)[0], "recall_10": _top(0.1)[1], "recall_20": _top(0.2)[1]}


def _unit(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0"


def _metrics_sql(table: str, keys: str) -> str:
    """SQL of all metrics as rows (keys, metric, value) of score tables, those of one class left out."""
    every = ", ".join(f"{sql} AS {name}" for name, sql in _METRIC_SQL.items())
    head = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys} " if keys else ""
    rows = " UNION ALL ".join(f"SELECT {head}'{m}' AS metric, {m} AS value FROM x" for m in _METRIC_SQL)
    return f"WITH r AS ({_ranked(table, keys)}), x AS (SELECT {head}{every} FROM r {group}HAVING max(pp) > 0 AND max(pp) < max(nn)) {rows}"


def _drawn_sql(cells: str, keys: str, draws: int, seed: int) -> str:
    """SQL of cells (keys, cell, pos, neg) as drawn sides (keys, draw, y, w)."""
    parts = "SELECT *, unnest(range(0, 8)) AS e, 0 AS i FROM l0 UNION ALL SELECT *, 8 AS e, unnest(range(1, n // 256 + 1)) AS i FROM l0"
    u = _unit(f"'{seed}|' || cell || '|' || y || '|' || l.e || '|' || i || '|' || draw")
    return f"""WITH l0 AS (SELECT {keys}, cell, 1 AS y, CAST(pos AS BIGINT) AS n FROM {cells} UNION ALL SELECT {keys}, cell, 0, CAST(neg AS BIGINT) FROM {cells}), l1 AS ({parts}), l AS (SELECT * FROM l1 WHERE e = 8 OR (n >> e) & 1 = 1),
 u AS (SELECT *, {u} AS u FROM l, range(1, {draws} + 1) q(draw)) SELECT u.*, po.k AS w FROM u JOIN po ON po.e = u.e AND u.u >= po.lo AND u.u < po.hi WHERE po.k > 0"""


def _by_score(name: str) -> str:
    return f"SELECT '{name}' AS name, CAST({name} AS DOUBLE) AS s, min(id) AS cell, sum(y) AS pos, count(*) - sum(y) AS neg FROM s WHERE {name} IS NOT NULL AND y IS NOT NULL GROUP BY {name}"


@query(f"""WITH s AS ({SCORED}), {_POISSON}, c AS ({_by_score("p")} UNION ALL {_by_score("p2")}), d AS ({_drawn_sql("c", "name, s", 1000, 42)}),
t AS (SELECT draw, name, s, CAST(sum(w) FILTER (y = 1) AS DOUBLE) AS pos, CAST(sum(w) AS DOUBLE) AS n FROM d GROUP BY 1, 2, 3), tt AS (SELECT draw, name, s, coalesce(pos, 0) AS pos, n FROM t), m AS ({_metrics_sql("tt", "draw, name")}),
c1 AS (SELECT name, s, CAST(pos AS DOUBLE) AS pos, CAST(pos + neg AS DOUBLE) AS n FROM c), e AS ({_metrics_sql("c1", "name")})
SELECT m.name AS score_name, m.metric, round(any_value(e.value), 6) AS estimate, round(quantile_cont(m.value, 0.025), 6) AS ci_low, round(quantile_cont(m.value, 0.975), 6) AS ci_high, count(*) AS draws FROM m JOIN e ON e.name = m.name AND e.metric = m.metric GROUP BY 1, 2""")
def metric_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Percentile intervals of all metrics of two scores over 1000 row bootstraps, drawn at the level of distinct scores."""
    return B.metric_intervals(scored(spark, d), "y", ["p", "p2"], "id", draws=1000).select("score_name", "metric", *r6("estimate", "ci_low", "ci_high"), "draws")


_DELTAS = """SELECT r.metric, round(any_value(r.value), 6) AS reference, round(any_value(x.value), 6) AS challenger, round(any_value(x.value - r.value), 6) AS delta, round(avg(dd.d), 6) AS delta_mean, round(quantile_cont(dd.d, 0.025), 6) AS delta_low, round(quantile_cont(dd.d, 0.975), 6) AS delta_high,
 round(avg(CASE WHEN dd.d > 0 THEN 1.0 ELSE 0 END), 6) AS positive_share, count(*) AS draws FROM e r JOIN e x ON x.metric = r.metric AND r.name = 'p' AND x.name = 'p2' JOIN dd ON dd.metric = r.metric GROUP BY 1"""
_PAIRED = "SELECT b.metric, b.value - a.value AS d FROM m a JOIN m b ON a.draw = b.draw AND a.metric = b.metric AND a.name = 'p' AND b.name = 'p2'"
_DELTA_COLUMNS = ("reference", "challenger", "delta", "delta_mean", "delta_low", "delta_high", "positive_share")


@query(f"""WITH s AS ({SCORED}), {_POISSON}, c AS (SELECT p, p2, min(id) AS cell, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1, 2), d AS ({_drawn_sql("c", "p, p2", 200, 42)}),
l AS (SELECT draw, 'p' AS name, p AS s, y, w FROM d UNION ALL SELECT draw, 'p2', p2, y, w FROM d), tt AS (SELECT draw, name, s, coalesce(CAST(sum(w) FILTER (y = 1) AS DOUBLE), 0) AS pos, CAST(sum(w) AS DOUBLE) AS n FROM l GROUP BY 1, 2, 3), m AS ({_metrics_sql("tt", "draw, name")}),
cl AS (SELECT 'p' AS name, p AS s, CAST(y AS DOUBLE) AS y FROM s UNION ALL SELECT 'p2', p2, y FROM s), c1 AS (SELECT name, s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM cl GROUP BY 1, 2), e AS ({_metrics_sql("c1", "name")}), dd AS ({_PAIRED}) {_DELTAS}""")
def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of one score less those of another, both under the same 200 row bootstraps."""
    return B.paired_delta(scored(spark, d), "y", "p", "p2", "id", draws=200).select("metric", *r6(*_DELTA_COLUMNS), "draws")


_CLUSTERED = f"c AS (SELECT p, p2, lead AS cell, fold, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1, 2, 3, 4), u AS (SELECT *, {_unit("'42|' || cell || '|' || draw")} AS u FROM c, range(1, {{draws}} + 1) q(draw)), d AS (SELECT u.*, po.k AS w FROM u JOIN po ON po.e = 0 AND u.u >= po.lo AND u.u < po.hi WHERE po.k > 0)"


@query(f"""WITH s0 AS ({SCORED}), s AS (SELECT *, 0 AS fold FROM s0), {_POISSON}, {_CLUSTERED.format(draws=250)},
l AS (SELECT draw, 'p' AS name, p AS s, pos * w AS pos, (pos + neg) * w AS n FROM d UNION ALL SELECT draw, 'p2', p2, pos * w, (pos + neg) * w FROM d), tt AS (SELECT draw, name, s, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(n) AS DOUBLE) AS n FROM l GROUP BY 1, 2, 3), m AS ({_metrics_sql("tt", "draw, name")}),
cl AS (SELECT 'p' AS name, p AS s, CAST(y AS DOUBLE) AS y FROM s UNION ALL SELECT 'p2', p2, y FROM s), c1 AS (SELECT name, s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM cl GROUP BY 1, 2), e AS ({_metrics_sql("c1", "name")}), dd AS ({_PAIRED}) {_DELTAS}""")
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two scores under 250 draws of whole leads."""
    return B.paired_delta(scored(spark, d), "y", "p", "p2", "id", draws=250, cluster="lead").select("metric", *r6(*_DELTA_COLUMNS), "draws")


@query(f"""WITH s0 AS ({SCORED}), s AS (SELECT *, date_part('year', seen) AS fold FROM s0), {_POISSON}, {_CLUSTERED.format(draws=100)},
l AS (SELECT draw, fold, 'p' AS name, p AS s, pos * w AS pos, (pos + neg) * w AS n FROM d UNION ALL SELECT draw, fold, 'p2', p2, pos * w, (pos + neg) * w FROM d), tt AS (SELECT draw, fold, name, s, CAST(sum(pos) AS DOUBLE) AS pos, CAST(sum(n) AS DOUBLE) AS n FROM l GROUP BY 1, 2, 3, 4), mf AS ({_metrics_sql("tt", "draw, fold, name")}),
m AS (SELECT draw, name, metric, avg(value) AS value FROM mf GROUP BY 1, 2, 3), cl AS (SELECT fold, 'p' AS name, p AS s, CAST(y AS DOUBLE) AS y FROM s UNION ALL SELECT fold, 'p2', p2, y FROM s), c1 AS (SELECT fold, name, s, sum(y) AS pos, CAST(count(*) AS DOUBLE) AS n FROM cl GROUP BY 1, 2, 3), ef AS ({_metrics_sql("c1", "fold, name")}),
e AS (SELECT name, metric, avg(value) AS value FROM ef GROUP BY 1, 2), dd AS ({_PAIRED}) {_DELTAS}""")
def fold_macro_delta(spark: SparkSession, d: str) -> DataFrame:
    """Difference of two scores' means over yearly folds, under 100 draws of whole leads."""
    s = scored(spark, d).withColumn("fold", F.year("at"))
    return B.paired_delta(s, "y", "p", "p2", "id", draws=100, cluster="lead", fold="fold").select("metric", *r6(*_DELTA_COLUMNS), "draws")


# ---- recalibration

#: Value of the isotonic fit at each score of t (g, s, pos, n): the largest over lower ends of the least mean over upper ends.
_ISOTONIC = """i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) AS i, sum(pos) OVER (PARTITION BY g ORDER BY s) AS cp, sum(n) OVER (PARTITION BY g ORDER BY s) AS cn FROM t),
ab AS (SELECT a.g, a.i AS a, b.i AS b, (b.cp - a.cp + a.pos) / (b.cn - a.cn + a.n) AS m FROM i a JOIN i b ON a.g = b.g AND a.i <= b.i), lm AS (SELECT g, a, b, min(m) OVER (PARTITION BY g, a ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM ab),
v AS (SELECT lm.g, i.s, i.pos, i.n, max(m) AS v FROM lm JOIN i ON i.g = lm.g AND i.i = lm.b GROUP BY ALL)"""


@query(f"""WITH s AS ({SCORED}), t AS (SELECT segment AS g, p2 AS s, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1, 2), {_ISOTONIC}
SELECT g AS stage, round(min(s), 6) AS lo, round(max(s), 6) AS hi, CAST(sum(n) AS BIGINT) AS n, round(sum(pos) / sum(n), 6) AS rate FROM v GROUP BY g, round(v, 10)""")
def isotonic_pools(spark: SparkSession, d: str) -> DataFrame:
    """Pools of the isotonic fit of each segment."""
    cells = C.stage_cells(scored(spark, d), "y", "p2", "segment", F.lit(0))
    return C.isotonic_pools(cells).select(F.col("_g").alias("stage"), *r6("lo", "hi"), F.col("n").cast("long").alias("n"), F.round(F.col("pos") / F.col("n"), 6).alias("rate"))


@query(f"""WITH s0 AS ({SCORED}), s AS (SELECT segment, p2 AS p, y, CAST('0x' || substr(md5('42|' || id), 1, 8) AS BIGINT) % 5 AS fold FROM s0), c AS (SELECT segment, fold, p, CAST(sum(y) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1, 2, 3),
t AS (SELECT segment || '#' || f AS g, p AS s, sum(pos) AS pos, sum(n) AS n FROM c, range(0, 5) r(f) WHERE f <> fold GROUP BY 1, 2), {_ISOTONIC},
k AS (SELECT c.segment, c.fold, c.p, any_value(c.pos) AS pos, any_value(c.n) AS n, max(v.s) FILTER (v.s <= c.p) AS x0, arg_max(v.v, v.s) FILTER (v.s <= c.p) AS y0, min(v.s) FILTER (v.s > c.p) AS x1, arg_min(v.v, v.s) FILTER (v.s > c.p) AS y1 FROM c JOIN v ON v.g = c.segment || '#' || c.fold GROUP BY 1, 2, 3),
o AS (SELECT segment, pos, n, p AS raw, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (y1 - y0) * (p - x0) / (x1 - x0) END AS iso FROM k), l AS (SELECT segment, 'raw' AS method, pos, n, raw AS q FROM o UNION ALL SELECT segment, 'isotonic', pos, n, iso FROM o),
e AS (SELECT segment AS stage, method, CAST(sum(n) AS BIGINT) AS n, sum(pos * (1 - q) * (1 - q) + (n - pos) * q * q) / sum(n) AS brier, sum(-(pos * ln(least(greatest(q, 1e-8), 1 - 1e-8)) + (n - pos) * ln(1 - least(greatest(q, 1e-8), 1 - 1e-8)))) / sum(n) AS log_loss FROM l GROUP BY 1, 2),
w AS (SELECT *, max(brier) FILTER (method = 'raw') OVER (PARTITION BY stage) - brier AS bg, max(log_loss) FILTER (method = 'raw') OVER (PARTITION BY stage) - log_loss AS lg FROM e), z AS (SELECT *, method <> 'raw' AND greatest(bg, lg) >= 0.001 AND least(bg, lg) >= -0.005 AS qualifies FROM w)
SELECT stage, method, n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(bg, 6) AS brier_gain, round(lg, 6) AS log_loss_gain, qualifies, CASE WHEN method = 'raw' THEN NOT bool_or(qualifies) OVER (PARTITION BY stage) ELSE qualifies END AS chosen FROM z""")
def cross_fitted_isotonic(spark: SparkSession, d: str) -> DataFrame:
    """Errors of raw and isotonic scores by segment, learned on the other four folds, and which of them is kept."""
    values = C.cross_fitted(C.stage_cells(scored(spark, d), "y", "p2", "segment", C.fold_of("id")), methods=("raw", "isotonic"))
    out = C.calibration_choice(values, ("raw", "isotonic"))
    return out.select(F.col("_g").alias("stage"), "method", "n", *r6("brier", "log_loss", "brier_gain", "log_loss_gain"), "qualifies", "chosen")


@query()
def calibration_choice(spark: SparkSession, d: str) -> DataFrame:
    """Raw, Platt and isotonic scores by segment, learned on the other folds, and the one that is kept."""
    values = C.cross_fitted(C.stage_cells(scored(spark, d), "y", "p", "segment", C.fold_of("id")))
    return C.calibration_choice(values).select(F.col("_g").alias("stage"), "method", "n", *r6("brier", "log_loss"), "qualifies", "chosen")


# ---- quantiles within groups

_HOT = "SELECT CASE WHEN l_orderkey % 10 = 0 THEN l_returnflag ELSE 'hot' END AS kind, l_extendedprice AS v FROM lineitem"


@query(f"""WITH x AS ({_HOT}), r AS (SELECT kind, v, row_number() OVER (PARTITION BY kind ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY kind) AS n FROM x)
SELECT kind, max(n) AS n, round(quantile_cont(v, 0.1), 4) AS p10, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99, round(CAST(max(v) FILTER (i = floor(0.9 * (n - 1) + 0.5)) AS DOUBLE), 4) AS near_90 FROM r GROUP BY 1""")
def hot_group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles by both rules where one group holds nine tenths of the rows, narrowed until few values are ordered."""
    li = load_table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 10 == 0, F.col("l_returnflag")).otherwise("hot").alias("kind"), F.col("l_extendedprice").alias("v"))
    linear = Q.grouped_quantiles(li, ["kind"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, most=1000)
    near = Q.grouped_quantiles(li, ["kind"], "v", {"near_90": 0.9}, rule="nearest", most=1000).drop("n")
    return linear.join(near, "kind").select("kind", "n", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p99", "near_90")])
