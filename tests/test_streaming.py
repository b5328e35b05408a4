"""Streams over bounded input give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from tarnwell.operators.history import first_per_key
from tarnwell.streaming import events as E


def _input(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(k % 3, k, t + dt.timedelta(hours=k), float(k)) for k in range(48)] + [(9, 99, t + dt.timedelta(days=30), 1.0)]
    df = spark.createDataFrame(rows, "user int, event int, ts timestamp, value double")
    df.filter("event < 24").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.filter("event >= 24").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return df


def test_tumbling_windows_match_batch(spark, tmp_path):
    df = _input(spark, tmp_path)
    stream = E.read_events(spark, f"{tmp_path}/in", df.schema)
    out = E.run_available(E.tumbling(stream, "ts", "1 day", ["user"], F.count("*").alias("n")), "tumble", "complete")
    want = df.groupBy(F.window("ts", "1 day").getField("start").alias("start"), "user").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_first_events_match_batch(spark, tmp_path):
    df = _input(spark, tmp_path)
    stream = E.read_events(spark, f"{tmp_path}/in", df.schema)
    out = E.run_available(E.first_events(stream, "user", "ts", "event"), "first")
    want = {(r.user, r.event) for r in first_per_key(df, "user", "ts", "event").filter("user < 9").collect()}
    assert {(r.user, r.event) for r in out.collect() if r.user < 9} == want


def test_latest_rows_and_queue_by_batch(spark, tmp_path):
    df = _input(spark, tmp_path)
    sink = E.upsert_latest(f"{tmp_path}/latest", "user", "ts", "event")
    sink(df.filter("event < 24"), 0)
    sink(df.filter("event >= 24"), 1)
    assert {r.user: r.event for r in spark.read.parquet(f"{tmp_path}/latest/v1").collect()} == {0: 45, 1: 46, 2: 47, 9: 99}
    E.ranked_queue(f"{tmp_path}/queue", "value", "event", 0.1)(df, 0)
    assert spark.read.parquet(f"{tmp_path}/queue/batch=0").count() == 5


def test_latest_states_change_expire_and_ignore_late_rows(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    schema = "user int, event int, ts timestamp, value string"
    at = lambda d, h=0: t + dt.timedelta(days=d, hours=h)
    batches = [
        [(1, 1, at(0), "a"), (1, 2, at(0), "b"), (2, 3, at(0, 1), None), (None, 4, at(0), "x"), (3, 5, None, "x")],  # a tie, a null value, no key, no time
        [(1, 6, at(0, -3), "old"), (2, 7, at(1), "c")],  # late for key 1, inside the watermark
        [(2, 8, at(30), "d"), (4, 9, at(30), "e")],  # moves the watermark: key 1 expires
        [(2, 10, at(31), "f")],
        [(2, 10, at(31), "f"), (5, 11, at(2), "dropped")],  # a repeated row changes nothing; a row below the watermark of the batch before
    ]
    import time

    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times
    stream = E.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema)
    changes = E.run_available(E.latest_states(stream, "user", "ts", "event", ["value"], "10 days"), "changes")
    got = sorted((r.user, r.event, r.value, r.version, r.expired) for r in changes.collect())
    assert got == [(1, 2, "b", 1, False), (1, 2, "b", 1, True), (2, 3, None, 1, False), (2, 7, "c", 2, False), (2, 8, "d", 3, False), (2, 10, "f", 4, False), (4, 9, "e", 1, False)]
    assert sorted((r.user, r.event, r.ts) for r in E.current_states(changes, "user", "ts", "event").collect()) == [(2, 10, at(31)), (4, 9, at(30))]


def test_batches_are_scored_on_arrival_and_again_alike(spark, tmp_path):
    df = _input(spark, tmp_path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = E.run_scored(stream, "scored", lambda b: b.select("event", (F.col("value") * 2).alias("score")))
    assert sorted((r.event, r.score) for r in out.collect()) == sorted((r.event, r.value * 2) for r in df.collect())
    assert out.select("batch").distinct().count() == 2
    sink = E.scored_batches(f"{tmp_path}/again", lambda b: b.select("event"))
    for _ in range(2):
        sink(df, 0)
    assert spark.read.parquet(f"{tmp_path}/again/batch=0").count() == 49
