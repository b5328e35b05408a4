"""Labels at scoring moments: maturity, censoring, windows, ambiguity, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import interval_join


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def mature_label(df: DataFrame, time: str, positive: Column, horizon: Column, maturity_days: int = 7, name: str = "target") -> DataFrame:
    """1 or 0 where the row is older than the maturity at the horizon, else null; an unknown outcome is negative."""
    known = F.coalesce(positive, F.lit(False)).cast("int")
    return df.withColumn(name, F.when(F.col(time) < horizon - days(maturity_days), known))


def window_label(anchors: DataFrame, events: DataFrame, key: str, time: str, event_time: str, horizon: Column, window_days: int = 30, closed: str = "right", name: str = "target") -> DataFrame:
    """Whether an event follows inside the window; null where the window passes the horizon. One row an anchor."""
    e = events.select(F.col(key), F.col(event_time).alias("_et"))
    hit = interval_join(anchors, e, key, time, "_et", window_days, closed)
    grouped = hit.groupBy(*anchors.columns).agg(F.count("_et").alias("_n"))
    return grouped.withColumn(name, F.when(F.col(time) + days(window_days) <= horizon, (F.col("_n") > 0).cast("int"))).drop("_n")


def status_label(response: Column, time: Column, horizon: Column, positives: tuple[str, ...], negatives: tuple[str, ...], maturity_days: int = 14) -> Column:
    """POSITIVE, NEGATIVE, AMBIGUOUS (no or unknown response) or CENSORED (not mature at the horizon)."""
    return F.when(time + days(maturity_days) > horizon, "CENSORED").when(response.isin(*positives), "POSITIVE").when(response.isin(*negatives), "NEGATIVE").otherwise("AMBIGUOUS")


def response_time(asked: str, hours: str, responded: Column) -> Column:
    """Reconstructed time of a response: asked + hours, where there was one and its hours are known."""
    return F.when(responded & F.col(hours).isNotNull(), F.col(asked) + F.make_dt_interval(secs=(F.col(hours) * 3600).cast("decimal(18,6)")))


def stage_eligibility(df: DataFrame, known_before: Column, untimed_before: Column) -> DataFrame:
    """INELIGIBLE after a known outcome, AMBIGUOUS where one cannot be placed in time, else ELIGIBLE."""
    return df.withColumn("eligibility", F.when(F.coalesce(known_before, F.lit(False)), "INELIGIBLE").when(F.coalesce(untimed_before, F.lit(False)), "AMBIGUOUS").otherwise("ELIGIBLE"))


def cohort_summary(df: DataFrame, time: str, target: str, least: int = 50) -> DataFrame:
    """One row: rows, labelled, coverage, prevalence, and spread of monthly prevalence over months of enough labels."""
    months = df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count(target).alias("labelled"), F.sum(target).alias("hits"))
    r = F.when(F.col("labelled") >= least, F.col("hits") / F.col("labelled"))
    return months.agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("n_labelled"), (F.sum("labelled") / F.sum("n")).alias("coverage"), (F.sum("hits") / F.sum("labelled")).alias("prevalence"),
        F.stddev_pop(r).alias("monthly_sd"), (F.max(r) - F.min(r)).alias("monthly_range"),
    )


def calendar_split(df: DataFrame, time: str, target: str, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """The window [from, to) that holds the time; purge_or_censored between windows and where there is no label."""
    split = F.lit("purge_or_censored")
    for name, (lo, hi) in windows.items():
        split = F.when((F.col(time) >= F.lit(lo).cast("timestamp")) & (F.col(time) < F.lit(hi).cast("timestamp")), name).otherwise(split)
    return df.withColumn("split", F.when(F.col(target).isNull(), "purge_or_censored").otherwise(split))


def rolling_folds(df: DataFrame, time: str, folds: int = 4, purge_days: int = 7, entity: str | None = None) -> DataFrame:
    """Rows tagged (fold, role) for folds at quantiles of the times: train ends `purge_days` before validation begins.

    With an entity, those that a fold validates leave its train rows, so no entity stands on both sides.
    """
    cuts = df.agg(F.percentile_approx(F.unix_micros(F.col(time).cast("timestamp")), [(k + 1) / (folds + 1) for k in range(folds)], 10000)).first()[0]
    at, gap = F.unix_micros(F.col(time).cast("timestamp")), purge_days * 86_400_000_000
    tagged = []
    for k, c in enumerate(cuts):
        after = cuts[k + 1] if k + 1 < folds else None
        role = F.when(at < c - gap, "train").when((at >= c) & (F.lit(True) if after is None else at < after), "validation")
        tagged.append(F.struct(F.lit(k + 1).alias("fold"), role.alias("role")))
    out = df.withColumn("_f", F.explode(F.array(*tagged))).filter("_f.role is not null").select(*df.columns, "_f.fold", "_f.role")
    if entity is None:
        return out
    validated = out.filter("role = 'validation'").select("fold", entity).distinct().withColumn("_both", F.lit(True))
    return out.join(validated, ["fold", entity], "left").filter("role = 'validation' or _both is null").select(*df.columns, "fold", "role")


def expanding_folds(df: DataFrame, entity: str, time: str, ends: list[tuple[float, float, float]]) -> DataFrame:
    """Rows tagged (fold, role) by the place of their entity in the order of first times: train, validation and test end at shares of the entities.

    Each part holds one entity more than the one before at least; entities never stand in two parts of a fold.
    """
    from .ordering import with_position

    first = df.groupBy(entity).agg(F.min(time).alias("_first"))
    placed = with_position(first.withColumn("_at", F.unix_micros(F.col("_first").cast("timestamp"))), "_at", (entity,), name="_place")
    n = first.count()
    tagged = []
    for k, (train, validation, test) in enumerate(ends):
        a = max(1, int(n * train))
        b = max(a + 1, int(n * validation))
        c = min(n, max(b + 1, int(n * test)))
        role = F.when(F.col("_place") <= a, "train").when(F.col("_place") <= b, "validation").when(F.col("_place") <= c, "test")
        tagged.append(F.struct(F.lit(k + 1).alias("fold"), role.alias("role")))
    dealt = placed.select(entity, F.explode(F.array(*tagged)).alias("_f")).filter("_f.role is not null").select(entity, "_f.fold", "_f.role")
    return df.join(dealt, entity)


def assert_isolated(folds: DataFrame, entity: str) -> DataFrame:
    """The same rows, or an error if an entity stands in two roles of one fold."""
    bad = folds.groupBy("fold", entity).agg(F.count_distinct("role").alias("_r")).filter("_r > 1")
    if not bad.isEmpty():
        raise ValueError(f"entities of {entity} in two roles of a fold")
    return folds


def fold_isolation(df: DataFrame, entity: str, time: str) -> DataFrame:
    """Per fold: shared entities of train and validation, and whether train ends before validation begins."""
    ends = df.groupBy("fold").agg(F.max(F.when(F.col("role") == "train", F.col(time))).alias("_t"), F.min(F.when(F.col("role") == "validation", F.col(time))).alias("_v"))
    both = df.groupBy("fold", entity).agg(F.count_distinct("role").alias("_r")).groupBy("fold").agg(F.count_if(F.col("_r") > 1).alias("shared_entities"))
    return ends.join(both, "fold").select("fold", "shared_entities", (F.col("_t") < F.col("_v")).alias("in_order"))
