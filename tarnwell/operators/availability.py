"""Labels of availability within a horizon, and rates of groups learned fold by fold from labels that had matured."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import shrunk_rate
from .ordering import with_position
from .targets import days

_DAY = 86_400_000_000


def availability_labels(rows: DataFrame, states: DataFrame, key: str, time: str, state_time: str, available: str, tie: str, horizon_days: int = 30) -> DataFrame:
    """Rows with `current` (available now), `target` (available now or in some state of the days that follow) and `matured_at`.

    The current state is the last one at or before the row's time, of several at one time the one with the greatest tie. Rows without a current
    state, and rows that are not available now and have no state in the days that follow, are left out: nothing is known of them. An unknown
    availability counts as none. A label that is available now matures at once, others when the days have passed. One shuffle by key and one sort.
    """
    free = F.coalesce(F.col(available), F.lit(False))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    state = F.struct(micros(state_time).alias("at"), F.col(tie).alias("tie"), free.alias("free"))
    right = states.filter(F.col(key).isNotNull() & F.col(state_time).isNotNull()).select(F.col(key).alias("_key"), micros(state_time).alias("_at"), state.alias("_state"), F.lit(None).cast(rows.schema).alias("_row"))
    left = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), micros(time).alias("_at"), F.lit(None).cast(right.schema["_state"].dataType).alias("_state"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"))
    w = Window.partitionBy("_key").orderBy("_at")
    out = left.unionByName(right).withColumns({
        "_now": F.max("_state").over(w.rangeBetween(Window.unboundedPreceding, 0)),
        "_later": F.max(F.col("_state.free").cast("int")).over(w.rangeBetween(1, horizon_days * _DAY)),
    }).filter("_row is not null and _now is not null and (_now.free or _later is not null)")
    now = F.col("_now.free")
    return out.select("_row.*", now.cast("int").alias("current"), F.when(now, 1).otherwise(F.col("_later")).alias("target"), F.when(now, F.col(f"_row.{time}")).otherwise(F.col(f"_row.{time}") + days(horizon_days)).alias("matured_at"))


def expanding_cuts(df: DataFrame, time: str, shares: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)) -> list[dt.datetime]:
    """The distinct times at shares of their number, rounded down; empty for an empty table. Only these reach the driver."""
    times = df.filter(F.col(time).isNotNull()).select(F.col(time).alias("t")).distinct()
    n = times.count()
    if not n:
        return []
    wanted = [int((n - 1) * s) + 1 for s in shares]
    found = {r.position: r.t for r in with_position(times, "t").filter(F.col("position").isin(wanted)).collect()}
    return [found[k] for k in wanted]


def matured_rates(labels: DataFrame, group: str, cuts: list[dt.datetime], strength: float = 20.0) -> DataFrame:
    """fold, group, n, hits, prior and rate from the labels that had matured before the fold begins, of rows not available now.

    Fold k reaches from cut k to cut k + 1. `prior` is the fold's rate of all groups; `rate` is shrunk to it. All folds come from one aggregation
    with two counts a fold, so no row is copied. Null groups are a group.
    """
    if len(cuts) < 2:
        raise ValueError("a fold needs two cuts")
    off = F.col("current") == 0
    counts = []
    for k, start in enumerate(cuts[:-1], 1):
        seen = off & (F.col("matured_at") < F.lit(start))
        counts += [F.count_if(seen).alias(f"n{k}"), F.count_if(seen & (F.col("target") == 1)).alias(f"h{k}")]
    wide = labels.groupBy(group).agg(*counts)
    folds = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"n{k}").alias("n"), F.col(f"h{k}").alias("hits")) for k in range(1, len(cuts))]))
    per = wide.select(group, folds.alias("x")).select("x.fold", group, "x.n", "x.hits")
    prior = per.groupBy("fold").agg(F.try_divide(F.sum("hits").cast("double"), F.sum("n")).alias("prior"))
    return per.join(F.broadcast(prior), "fold").withColumn("rate", shrunk_rate(F.col("hits"), F.col("n"), F.col("prior"), strength))  # one row a fold


def fold_of(time: Column, cuts: list[dt.datetime]) -> Column:
    """The folds whose closed interval holds a time, as an array: a time on an inner cut is in two."""
    inside = [F.when((time >= F.lit(a)) & (time <= F.lit(b)), F.lit(k)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]), 1)]
    return F.filter(F.array(*inside), lambda k: k.isNotNull())


def matured_scores(labels: DataFrame, group: str, time: str, cuts: list[dt.datetime], strength: float = 20.0, name: str = "p") -> DataFrame:
    """Every labelled row once a fold it lies in, with its chance to be available: 1 where it is now, else its group's matured rate."""
    rates = matured_rates(labels, group, cuts, strength).select("fold", F.col(group).alias("_group"), F.coalesce("rate", "prior").alias("_rate"))
    rows = labels.withColumn("fold", F.explode(fold_of(F.col(time), cuts)))
    joined = rows.join(rates, (rows["fold"] == rates["fold"]) & rows[group].eqNullSafe(rates["_group"]), "left").drop(rates["fold"])
    return joined.withColumn(name, F.when(F.col("current") == 1, 1.0).otherwise(F.col("_rate"))).drop("_group", "_rate")
