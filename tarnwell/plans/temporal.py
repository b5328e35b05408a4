"""First events, histories, labels and splits; and the streaming counterparts."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import history as H
from tarnwell.operators import joins as J
from tarnwell.operators import ordering as O
from tarnwell.operators import targets as T
from tarnwell.plans.registry import ASKS, SNAPSHOTS, asks, events, orders, query, r6, snapshots
from tarnwell.sources.tables import load_table


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), h AS (SELECT max(ts) AS h FROM events)
SELECT user_id, event_id, event_type, CASE WHEN ts < h - INTERVAL 7 DAY THEN CAST(coalesce(event_type = 'purchase', false) AS INT) END AS target FROM f, h WHERE n = 1""")
def first_event_target(spark: SparkSession, d: str) -> DataFrame:
    """First event of each user with its label, null where it is not mature at the horizon."""
    e = events(spark, d)
    horizon = F.lit(e.agg(F.max("ts")).first()[0])
    first = H.first_per_key(e, "user_id", "ts", "event_id")
    return T.mature_label(first, "ts", F.col("event_type") == "purchase", horizon).select("user_id", "event_id", "event_type", "target")


@query("""WITH f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1), h AS (SELECT max(ts) AS h FROM events)
SELECT user_id, CASE WHEN t + INTERVAL 5 DAY <= h THEN CAST(EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = 'purchase' AND e.ts > t AND e.ts <= t + INTERVAL 5 DAY) AS INT) END AS target FROM f, h""")
def window_target(spark: SparkSession, d: str) -> DataFrame:
    """Whether a purchase follows a user's first event within (t, t + 5 days]; null past the horizon."""
    e = events(spark, d)
    horizon = F.lit(e.agg(F.max("ts")).first()[0])
    first = e.groupBy("user_id").agg(F.min("ts").alias("t"))
    return T.window_label(first, e.filter("event_type = 'purchase'"), "user_id", "t", "ts", horizon, 5).select("user_id", "target")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), h AS (SELECT max(o_orderdate) AS h FROM orders)
SELECT o_orderkey, CAST(n AS BIGINT) AS position, CASE WHEN o_orderdate < h - INTERVAL 7 DAY THEN CAST(o_orderstatus = 'F' AS INT) END AS target FROM f, h WHERE n > 1""")
def later_event_target(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    horizon = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    later = H.position_in_key(o, "o_custkey", "o_orderdate", "o_orderkey").filter("position > 1")
    return T.mature_label(later, "o_orderdate", F.col("o_orderstatus") == "F", horizon).select("o_orderkey", "position", "target")


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders), h AS (SELECT max(o_orderdate) AS h FROM orders), w(days) AS (VALUES (7), (14), (30))
SELECT CAST(days AS INT) AS days, count(*) AS n, count(*) FILTER (WHERE o_orderdate < h - to_days(days)) AS n_mature, count(*) FILTER (WHERE o_orderdate < h - to_days(days) AND o_orderstatus IN ('F', 'P')) AS n_positive FROM f, h, w WHERE n = 1 GROUP BY 1""")
def sensitivity_targets(spark: SparkSession, d: str) -> DataFrame:
    """Mature and positive counts of first orders under maturities of 7, 14 and 30 days, in one pass."""
    o = orders(spark, d)
    horizon = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    first = H.first_per_key(o, "o_custkey", "o_orderdate", "o_orderkey").withColumn("days", F.explode(F.array(F.lit(7), F.lit(14), F.lit(30))))
    mature = F.col("o_orderdate") < horizon - F.make_dt_interval(days=F.col("days"))
    return first.groupBy("days").agg(F.count("*").alias("n"), F.count_if(mature).alias("n_mature"), F.count_if(mature & F.col("o_orderstatus").isin("F", "P")).alias("n_positive"))


@query("""WITH h AS (SELECT max(o_orderdate) AS h FROM orders)
SELECT CASE WHEN o_orderdate + INTERVAL 14 DAY > h THEN 'CENSORED' WHEN o_orderstatus = 'F' THEN 'POSITIVE' WHEN o_orderstatus = 'O' THEN 'NEGATIVE' ELSE 'AMBIGUOUS' END AS status, count(*) AS n FROM orders, h GROUP BY 1""")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    horizon = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return o.groupBy(T.status_label(F.col("o_orderstatus"), F.col("o_orderdate"), horizon, ("F",), ("O",)).alias("status")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS mo, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS l, count(*) FILTER (WHERE o_orderstatus = 'F') AS k FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(l) AS BIGINT) AS n_labelled, round(sum(l) / sum(n), 6) AS coverage, round(sum(k) / sum(l), 6) AS prevalence, round(stddev_pop(CASE WHEN l >= 50 THEN CAST(k AS DOUBLE) / l END), 6) AS monthly_sd, round(max(CASE WHEN l >= 50 THEN CAST(k AS DOUBLE) / l END) - min(CASE WHEN l >= 50 THEN CAST(k AS DOUBLE) / l END), 6) AS monthly_range FROM m""")
def cohort_summary(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("target", F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("int")))
    return T.cohort_summary(o, "o_orderdate", "target").select("n", "n_labelled", *r6("coverage", "prevalence", "monthly_sd", "monthly_range"))


@query("""SELECT CASE WHEN o_orderstatus = 'P' THEN 'purge_or_censored' WHEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-06-01' THEN 'train' WHEN o_orderdate >= TIMESTAMP '1996-06-08' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'validation' WHEN o_orderdate >= TIMESTAMP '1997-01-08' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'test' ELSE 'purge_or_censored' END AS split, count(*) AS n FROM orders GROUP BY 1""")
def calendar_split(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("target", F.when(F.col("o_orderstatus") != "P", 1))
    windows = {"train": ("1995-01-01", "1996-06-01"), "validation": ("1996-06-08", "1997-01-01"), "test": ("1997-01-08", "1998-01-01")}
    return T.calendar_split(o, "o_orderdate", "target", windows).groupBy("split").agg(F.count("*").alias("n"))


@query("""SELECT CAST(k AS INT) AS fold, CAST(0 AS BIGINT) AS shared_entities, true AS in_order FROM range(1, 5) r(k)""")
def rolling_fold_isolation(spark: SparkSession, d: str) -> DataFrame:
    folds = T.rolling_folds(orders(spark, d), "o_orderdate", entity="o_custkey")
    return T.fold_isolation(folds, "o_custkey", "o_orderdate")


@query("""WITH f AS (SELECT o_custkey, min(o_orderdate) AS t FROM orders GROUP BY 1), r AS (SELECT o_custkey, row_number() OVER (ORDER BY t, o_custkey) AS n, count(*) OVER () AS c FROM f)
SELECT CASE WHEN n <= CAST(floor(c * 0.70) AS BIGINT) THEN 'train' WHEN n <= CAST(floor(c * 0.85) AS BIGINT) THEN 'validation' ELSE 'test' END AS split, count(DISTINCT o_custkey) AS n_entities, count(*) AS n FROM orders JOIN r USING (o_custkey) GROUP BY 1""")
def cohort_split(spark: SparkSession, d: str) -> DataFrame:
    out = H.cohort_split(orders(spark, d), "o_custkey", "o_orderdate")
    return out.groupBy("split").agg(F.count_distinct("o_custkey").alias("n_entities"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, row_number() OVER w - 1 AS prior_count, round(date_diff('day', first_value(o_orderdate) OVER w, o_orderdate), 6) AS days_since_first, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS DOUBLE) AS days_since_prior,
 round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS prior_mean FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def row_history(spark: SparkSession, d: str) -> DataFrame:
    """Prior orders by row order: of two on one day the later id sees the earlier."""
    out = H.row_history(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", ["o_totalprice"])
    return out.select("o_orderkey", "prior_count", *r6("days_since_first", "days_since_prior"), F.round("prior_o_totalprice_mean", 4).alias("prior_mean"))


_PAST = "PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"


@query(f"""SELECT o_orderkey, count(*) OVER p AS prior_count, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prior_count_30d,
 round(avg(o_totalprice) OVER p, 4) AS prior_mean, round(CASE WHEN count(*) OVER p = 1 THEN 0 ELSE stddev_samp(o_totalprice) OVER p END, 4) AS prior_std,
 CAST(len(list_distinct(list(o_orderpriority) OVER p)) AS BIGINT) AS priorities FROM orders WINDOW p AS ({_PAST})""")
def strict_history(spark: SparkSession, d: str) -> DataFrame:
    """Prior orders by strictly earlier time: orders of one day do not see each other."""
    out = H.strict_history(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", ["o_totalprice"], ["o_orderpriority"])
    return out.select(
        "o_orderkey", "prior_count", "prior_count_30d", F.round("prior_o_totalprice_mean", 4).alias("prior_mean"), F.round("prior_o_totalprice_std", 4).alias("prior_std"),
        F.when(F.col("prior_count") > 0, F.col("prior_o_orderpriority_unique")).alias("priorities"),
    )


@query(f"""SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prior_same,
 round(count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) / nullif(CAST(count(*) OVER p AS DOUBLE), 0), 6) AS same_rate FROM orders WINDOW p AS ({_PAST})""")
def same_channel_history(spark: SparkSession, d: str) -> DataFrame:
    out = H.same_value_history(orders(spark, d), "o_custkey", "o_orderdate", "o_orderpriority")
    return out.select("o_orderkey", F.col("prior_same_o_orderpriority").alias("prior_same"), F.round("prior_same_o_orderpriority_rate", 6).alias("same_rate"))


@query("""WITH g AS (SELECT *, CAST(date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS DOUBLE) AS gap FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, round(avg(gap) OVER u, 6) AS gap_mean, round(quantile_cont(gap, 0.5) OVER u, 6) AS gap_median FROM g WINDOW u AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def gap_statistics(spark: SparkSession, d: str) -> DataFrame:
    return H.gap_statistics(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", *r6("gap_mean", "gap_median"))


_RESP = f"WITH a AS ({ASKS}), r AS (SELECT *, CASE WHEN st <> 'O' THEN asked_at + to_days(CAST(1 + ask_id % 40 AS INT)) END AS responded_at FROM a)"


@query(f"""{_RESP} SELECT x.ask_id, count(y.ask_id) AS known_responses, count(y.ask_id) FILTER (WHERE y.st = 'F') AS known_hits, round(count(y.ask_id) FILTER (WHERE y.st = 'F') / nullif(CAST(count(y.ask_id) AS DOUBLE), 0), 6) AS known_rate
 FROM r x LEFT JOIN r y ON y.lead = x.lead AND y.responded_at <= x.asked_at GROUP BY 1""")
def response_history(spark: SparkSession, d: str) -> DataFrame:
    """Responses known at the time of each enquiry, whenever they were asked for."""
    r = asks(spark, d).withColumn("responded_at", F.when(F.col("st") != "O", F.col("asked_at") + F.make_dt_interval(days=(1 + F.col("ask_id") % 40).cast("int"))))
    return H.response_history(r, "lead", "asked_at", "responded_at", F.col("st") == "F", "ask_id").select("ask_id", "known_responses", "known_hits", *r6("known_rate"))


@query(f"""{_RESP} SELECT x.ask_id, count(y.ask_id) AS known_responses, count(y.ask_id) FILTER (WHERE y.st = 'F') AS known_hits FROM r x LEFT JOIN r y ON y.part_id = x.part_id AND y.responded_at <= x.asked_at GROUP BY 1""")
def supply_history(spark: SparkSession, d: str) -> DataFrame:
    """The same by part: what was known of the supply side."""
    r = asks(spark, d).withColumn("responded_at", F.when(F.col("st") != "O", F.col("asked_at") + F.make_dt_interval(days=(1 + F.col("ask_id") % 40).cast("int"))))
    return H.response_history(r, "part_id", "asked_at", "responded_at", F.col("st") == "F", "ask_id").select("ask_id", "known_responses", "known_hits")


@query("""SELECT o_orderkey, round((o_totalprice - first_value(o_totalprice) OVER w) / nullif(abs(first_value(o_totalprice) OVER w), 0), 6) AS change_vs_first, round((o_totalprice - lag(o_totalprice) OVER w) / nullif(abs(lag(o_totalprice) OVER w), 0), 6) AS change_vs_prior, coalesce(o_totalprice > lag(o_totalprice) OVER w, false) AS escalates FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def trajectory(spark: SparkSession, d: str) -> DataFrame:
    return H.trajectory(orders(spark, d), "o_custkey", "o_orderdate", "o_orderkey", "o_totalprice").select("o_orderkey", *r6("change_vs_first", "change_vs_prior"), "escalates")


@query(f"""{_RESP} SELECT CASE WHEN EXISTS (SELECT 1 FROM r y WHERE y.lead = x.lead AND y.responded_at <= x.asked_at AND y.st = 'F') THEN 'INELIGIBLE' ELSE 'ELIGIBLE' END AS eligibility, count(*) AS n FROM r x GROUP BY 1""")
def stage_eligibility(spark: SparkSession, d: str) -> DataFrame:
    r = asks(spark, d).withColumn("responded_at", F.when(F.col("st") != "O", F.col("asked_at") + F.make_dt_interval(days=(1 + F.col("ask_id") % 40).cast("int"))))
    known = H.response_history(r, "lead", "asked_at", "responded_at", F.col("st") == "F", "ask_id")
    return T.stage_eligibility(known, F.col("known_hits") > 0, F.lit(False)).groupBy("eligibility").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, rank, CASE WHEN rank <= ceil(n * 0.05) THEN 'PRIORITY' WHEN rank <= ceil(n * 0.10) THEN 'HIGH' WHEN rank <= ceil(n * 0.20) THEN 'MEDIUM' ELSE 'LOW' END AS band FROM r""")
def capacity_bands(spark: SparkSession, d: str) -> DataFrame:
    return O.capacity_bands(orders(spark, d), "o_totalprice", ("o_orderkey",)).select("o_orderkey", "rank", "band")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def daily_volume(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.groupBy(F.date_format(F.window("ts", "1 day").getField("start"), "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(count(DISTINCT k) AS BIGINT) AS n_sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = events(spark, d).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_daily_volume(spark: SparkSession, d: str) -> DataFrame:
    """The daily volume through the streaming engine, all input at once; complete mode keeps every window."""
    from tarnwell.streaming.events import run_available, table_stream

    windows = table_stream(spark, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return run_available(windows, "volume", "complete").select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("""SELECT user_id, ts, event_id, event_type, CAST(1 AS BIGINT) AS version FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) WHERE n = 1""")
def streamed_latest_states(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event, held as keyed state of the streaming engine; the table is one batch, so every state is its first version."""
    from tarnwell.streaming.events import current_states, latest_states, run_available, table_stream

    stream = table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 day")
    changes = run_available(latest_states(stream, "user_id", "ts", "event_id", ["event_type"], "36500 days"), "latest")
    return current_states(changes, "user_id", "ts", "event_id")


@query(f"""WITH a AS ({ASKS}), sn AS ({SNAPSHOTS}) SELECT ask_id, lead, sn.available, CAST(date_diff('day', sn.seen, asked_at) AS INT) AS age_days,
 round(1 / (1 + exp(-(-0.4 + 0.9 * (CAST(coalesce(sn.available, false) AS INT) - 0.5) / 0.5 - 0.3 * (coalesce(date_diff('day', sn.seen, asked_at), 365) - 90.0) / 120.0))), 8) AS score FROM a ASOF LEFT JOIN sn ON sn.part_id = a.part_id AND a.asked_at >= sn.seen""")
def streamed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every order scored as its batch arrives: the part's state as of then, its age, and a frozen model of the two."""
    from tarnwell.streaming.events import run_scored, table_stream

    li = load_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part_id"))
    states = snapshots(spark, d)

    def score(batch: DataFrame) -> DataFrame:
        a = batch.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("lead"), "part_id", F.col("o_orderdate").alias("asked_at"))
        known = J.state_coverage(J.asof_backward(a, states, "part_id", "asked_at", "at", ["available"]), "asked_at", "at")
        # fixed values of the frozen model: coefficient, mean, spread, fill
        model = X.logistic(-0.4, [(0.9, F.coalesce("available", F.lit(False)).cast("int"), 0.5, 0.5, 0.0), (-0.3, F.col("age_days"), 90.0, 120.0, 365.0)])
        return known.select("ask_id", "lead", "available", "age_days", F.round(model, 8).alias("score"))

    return run_scored(table_stream(spark, d, "orders"), "scores", score).drop("batch")
