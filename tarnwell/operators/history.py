"""Histories of an entity before each of its events, by windows alone."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(column: str | Column) -> Column:
    return F.unix_micros((F.col(column) if isinstance(column, str) else column).cast("timestamp"))


def first_per_key(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """The first row of each key by time, then by the tie-breaking id."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(time, tie))).filter("_n = 1").drop("_n")


def position_in_key(df: DataFrame, key: str, time: str, tie: str, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(time, tie)).cast("long"))


def row_history(df: DataFrame, key: str, time: str, tie: str, means: list[str]) -> DataFrame:
    """Prior rows by order, so that of two rows at one time the later id sees the earlier one."""
    order = Window.partitionBy(key).orderBy(time, tie)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    out = {
        "prior_count": (F.row_number().over(order) - 1).cast("long"),
        "days_since_first": (micros(time) - F.first(micros(time)).over(order)) / DAY,
        "days_since_prior": (micros(time) - F.lag(micros(time)).over(order)) / DAY,
    }
    out |= {f"prior_{m}_mean": F.avg(m).over(past) for m in means}
    return df.withColumns(out)


def strict_history(df: DataFrame, key: str, time: str, tie: str, means: list[str] = (), distinct: list[str] = (), velocity_days: int = 30) -> DataFrame:
    """Prior rows by strictly earlier time: rows of one timestamp do not see each other."""
    order = Window.partitionBy(key).orderBy(micros(time))
    past = order.rangeBetween(Window.unboundedPreceding, -1)
    out = {
        "prior_count": F.count("*").over(past),
        f"prior_count_{velocity_days}d": F.count("*").over(order.rangeBetween(-velocity_days * DAY, -1)),
        "days_since_prior": (micros(time) - F.max(micros(time)).over(past)) / DAY,
    }
    for m in means:
        n, newest, oldest = F.count(m).over(past), F.last(m, ignorenulls=True).over(past), F.first(m, ignorenulls=True).over(past)
        out |= {
            f"prior_{m}_mean": F.avg(m).over(past),
            f"prior_{m}_std": F.when(n == 1, 0.0).when(n > 1, F.stddev_samp(m).over(past)),
            f"prior_{m}_last": newest,
            f"prior_{m}_trend": F.when(n > 1, (newest - oldest) / (n - 1)),
        }
    # a value counts once, at its first row in the key
    firsts = {f"_first_{d}": (F.col(d).isNotNull() & (F.row_number().over(Window.partitionBy(key, d).orderBy(time, tie)) == 1)).cast("long") for d in distinct}
    out |= {f"prior_{d}_unique": F.coalesce(F.sum(f"_first_{d}").over(past), F.lit(0)).cast("long") for d in distinct}
    return df.withColumns(firsts).withColumns(out).drop(*firsts) if distinct else df.withColumns(out)


def same_value_history(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Prior strictly earlier rows that share the row's value, and their share: revisits and same-channel rates."""
    past = (Window.unboundedPreceding, -1)
    same = F.count("*").over(Window.partitionBy(key, value).orderBy(micros(time)).rangeBetween(*past))
    every = F.count("*").over(Window.partitionBy(key).orderBy(micros(time)).rangeBetween(*past))
    return df.withColumns({f"prior_same_{value}": same, f"revisit_{value}": same > 0, f"prior_same_{value}_rate": F.try_divide(same.cast("double"), every)})


def gap_statistics(df: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Mean and median of the gaps (days) between a key's rows up to each row; peers of one time add a gap of 0.

    The median comes from two heaps that follow a key's rows in order, so a key of n rows takes n log n steps.
    """
    order = Window.partitionBy(key).orderBy(time, tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the windows find their partitioning and order as they need it
    dealt = df.repartition(key).sortWithinPartitions(key, time, tie)
    gapped = dealt.withColumn("_gap", (micros(time) - F.lag(micros(time)).over(order)) / DAY).withColumn("gap_mean", F.avg("_gap").over(upto))

    def medians(batches):
        now, low, high = object(), [], []
        for batch in batches:
            out, names = [], batch.schema.names
            for k, gap in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index("_gap")).to_pylist()):
                if k != now:
                    now, low, high = k, [], []
                if gap is not None:
                    # the lower half with its largest value on top, the upper one with its smallest
                    heapq.heappush(high, -heapq.heappushpop(low, -gap))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
                out.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
            kept = [i for i, name in enumerate(names) if name != "_gap"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(out, pa.float64())], names=[*[names[i] for i in kept], "gap_median"])

    return gapped.mapInArrow(medians, gapped.drop("_gap").schema.add("gap_median", "double"))


def response_history(df: DataFrame, key: str, time: str, response_time: str, outcome: Column, row_id: str) -> DataFrame:
    """Of each row: responses of the same key known by its time (at or before), and how many had the outcome.

    Responses and rows meet in one ordered union, so no pair of rows is ever joined.
    """
    asks = df.select(F.col(key).alias("_key"), micros(time).alias("_at"), F.lit(1).alias("_kind"), F.lit(0).alias("_one"), F.lit(0).alias("_hit"), F.struct(*df.columns).alias("_row"))
    known = df.filter(F.col(response_time).isNotNull()).select(F.col(key).alias("_key"), micros(response_time).alias("_at"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"), F.coalesce(outcome.cast("int"), F.lit(0)).alias("_hit"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"))
    upto = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = asks.unionByName(known).withColumns({"known_responses": F.sum("_one").over(upto), "known_hits": F.sum("_hit").over(upto)})
    return both.filter("_row is not null").select("_row.*", "known_responses", "known_hits", F.try_divide(F.col("known_hits").cast("double"), "known_responses").alias("known_rate"))


def trajectory(df: DataFrame, key: str, time: str, tie: str, value: str) -> DataFrame:
    """Change against the first and the previous row, and runs of growth."""
    order = Window.partitionBy(key).orderBy(time, tie)
    first, prior = F.first(value).over(order), F.lag(value).over(order)
    change = lambda a, b: F.try_divide(a - b, F.abs(b))
    return df.withColumns({"change_vs_first": change(F.col(value), first), "change_vs_prior": change(F.col(value), prior), "escalates": F.coalesce(F.col(value) > prior, F.lit(False))})


def cohort_split(df: DataFrame, key: str, time: str, cuts: tuple[float, float] = (0.70, 0.85)) -> DataFrame:
    """train, validation, test by the chronological position of a key's first row; keys never straddle."""
    from .ordering import with_position

    firsts = df.groupBy(key).agg(F.min(time).alias("_first"))
    n = firsts.count()
    placed = with_position(firsts, "_first", (key,), name="_at")
    split = F.when(F.col("_at") <= int(n * cuts[0]), "train").when(F.col("_at") <= int(n * cuts[1]), "validation").otherwise("test")
    return df.join(placed.select(key, split.alias("split")), key)
