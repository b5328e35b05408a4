"""The batch operators on unbounded input: windows, sessions, latest states, first events, quality alarms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnwell.sources.tables import load_table, normalise, scratch_folder


def read_events(spark: SparkSession, path: str, schema, time: str = "ts", late: str = "1 day") -> DataFrame:
    """A Parquet folder as a stream with event time and a watermark."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, width: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.window(time, width), *by).agg(*aggregates).select(F.col("window.start").alias("start"), *by, *[a for a in _names(aggregates)])


def sliding(events: DataFrame, time: str, width: str, slide: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.window(time, width, slide), *by).agg(*aggregates).select(F.col("window.start").alias("start"), *by, *[a for a in _names(aggregates)])


def sessions(events: DataFrame, time: str, gap: str, by: list[str], *aggregates) -> DataFrame:
    return events.groupBy(F.session_window(time, gap), *by).agg(*aggregates).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *[a for a in _names(aggregates)])


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for a in aggregates]


def once_per_key(events: DataFrame, *keys: str) -> DataFrame:
    """Repeats of a key inside the watermark are dropped: the same request is served once."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def first_events(events: DataFrame, key: str, time: str, payload: str) -> DataFrame:
    """The first event of each key, emitted once it can no longer change (its batch's watermark); later ones are ignored."""
    kind = events.schema[key].dataType.simpleString()

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, value, sent = state.get
            if not sent:
                state.update((at, value, True))
                yield pd.DataFrame({key: [group[0]], "first_at": [at], payload: [value]})
            return
        at, value, sent = state.get if state.exists else (None, None, False)
        for pdf in frames:
            best = pdf.sort_values([time, payload]).iloc[0]
            if not sent and (at is None or (best[time].to_pydatetime(), best[payload]) < (at, value)):
                at, value = best[time].to_pydatetime(), best[payload]
        state.update((at, value, sent))
        if not sent:
            state.setTimeoutTimestamp(max(int(pd.Timestamp(at).timestamp() * 1000), state.getCurrentWatermarkMs()) + 1)

    pay = events.schema[payload].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, first_at timestamp, {payload} {pay}", f"at timestamp, value {pay}, sent boolean", "append", GroupStateTimeout.EventTimeTimeout)


def latest_states(events: DataFrame, key: str, time: str, tie: str, payload: list[str], keep: str) -> DataFrame:
    """Changes of the last state of each key, as keyed state of the engine: one row a key and batch in which its last row changed.

    Last is the row with the greatest time, of several at one time that with the greatest tie. `version` counts a key's changes. Once the watermark
    is `keep` beyond a key's last row, a row with `expired` is emitted and the key's state is dropped, so state is bounded by the keys seen in
    that span. Rows older than the watermark of the batch before are dropped by the engine, rows older than the key's last row change nothing; rows without a key or
    time are left out. The result can be appended to a table; `current_states` reads the last states out of it.
    """
    span = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("_us", F.unix_micros(time)).select(key, time, "_us", tie, *payload)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, tie, *payload)}
    plain = lambda v: v.item() if hasattr(v, "item") else None if pd.isna(v) else v

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda s, gone: pd.DataFrame([(group[0], *s, gone)], columns=[key, "_us", tie, *payload, "version", "expired"])
        if state.hasTimedOut:
            gone = state.get
            state.remove()
            yield row(gone, True)
            return
        held = state.get if state.exists else None
        best = held
        for pdf in frames:
            top = pdf.sort_values(["_us", tie]).iloc[-1]
            found = tuple(plain(top[c]) for c in ("_us", tie, *payload))
            if best is None or found[:2] > tuple(best[:2]):
                best = (*found, (held[-1] if held else 0) + 1)
        if best is not held:
            state.update(tuple(best))
            yield row(best, False)
        state.setTimeoutTimestamp(max(best[0] // 1000 + span, state.getCurrentWatermarkMs()) + 1)

    fields = ", ".join(f"{c} {kinds[c]}" for c in (tie, *payload))
    out = rows.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, _us long, {fields}, version long, expired boolean", f"_us long, {fields}, version long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn(time, F.timestamp_micros("_us")).select(key, time, tie, *payload, "version", "expired")


def current_states(changes: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The last state of each key that has not expired, from the changes: one aggregation, combined before the shuffle."""
    last = F.max_by(F.struct(*[c for c in changes.columns if c != key]), F.struct(time, tie, "expired"))
    return changes.groupBy(key).agg(last.alias("x")).select(key, "x.*").filter("not expired").drop("expired")


def scored_batches(target: str, score: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that scores each batch on arrival with batch operators; a batch that runs again replaces its own rows only."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return sink


def run_scored(stream: DataFrame, name: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything there is now, scored batch by batch, as a table in the shared folder with the number of its `batch`."""
    target = scratch_folder(stream.sparkSession, name)
    stream.writeStream.foreachBatch(scored_batches(target, score)).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(target)


def upsert_latest(target: str, key: str, time: str, tie: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key, batch by batch in versions of their own; reruns of a batch agree."""

    def sink(batch: DataFrame, number: int) -> None:
        from tarnwell.operators.joins import latest_per

        spark = batch.sparkSession
        old = spark.read.schema(batch.schema).parquet(f"{target}/v{number - 1}") if number else None
        both = batch if old is None else old.unionByName(batch)
        latest_per(both, [key], F.col(time).desc(), F.col(tie).desc()).write.mode("overwrite").parquet(f"{target}/v{number}")

    return sink


def ranked_queue(target: str, score: str, tie: str, share: float) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that ranks each micro-batch and keeps the share that capacity allows."""

    def sink(batch: DataFrame, number: int) -> None:
        from tarnwell.operators.ordering import capacity_bands

        capacity_bands(batch, score, (tie,), (share,), ("QUEUE", "REST")).filter("band = 'QUEUE'").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return sink


def with_alarms(events: DataFrame, name, **conditions) -> DataFrame:
    """Row counts of broken conditions, observed batch by batch for a listener; `name` is a name or an Observation."""
    return events.observe(name, F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def table_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table as a stream of all its files; a table that is one file is written out as a folder, as file sources read folders."""
    at = f"{root}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    table = load_table(spark, root, name)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        at = scratch_folder(spark, name)
        table.write.parquet(at)
    return normalise(spark.readStream.schema(spark.read.parquet(at).schema).parquet(at))


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything there is now, through the streaming engine, as a table in the shared folder.

    Batches of append mode are added; in complete mode every batch replaces the one before.
    """
    target = scratch_folder(df.sparkSession, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{target}-state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", target)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target))
    writer.start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(target)
