"""Audits as tables of checks, gates on columns, and the exploratory pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import duplicate_keys, orphans
from .ordering import exact_quantiles
from .quantiles import grouped_quantiles

#: Columns that no feature table may hold.
FORBIDDEN = ("lead_score_internal", "broker_response", "broker_response_hours", "days_on_market", "total_inquiries", "total_views", "is_active", "competing_inquiries_30d")


def forbidden_columns(columns: list[str], forbidden: tuple[str, ...] = FORBIDDEN, prefixes: tuple[str, ...] = ("future_",)) -> list[str]:
    return [c for c in columns if c in forbidden or c.startswith(prefixes)]


def assert_clean(df: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN) -> DataFrame:
    """The same frame, or an error before anything runs."""
    if bad := forbidden_columns(df.columns, forbidden):
        raise ValueError(f"columns that look ahead: {bad}")
    return df


def registry_errors(names: list[str], registry: DataFrame, stage: str, roles: tuple[str, ...] | None = None, statuses: tuple[str, ...] = ("active",), unproven: tuple[str, ...] = ("UNPROVEN", "NOT OBSERVABLE", "FORBIDDEN")) -> list[str]:
    """What keeps columns from use at a stage, in the order of the columns.

    The registry has name, stage (several joined by |) and status; where it has `role` and `earliest`, roles are checked against `roles`, forbidden
    ones and rejected columns are always refused, and so is what is `earliest` known at no proven time. Only rows of these columns are fetched.
    """
    have = [c for c in ("role", "earliest") if c in registry.columns]
    rows = {r["name"]: r for r in registry.filter(F.col("name").isin(names)).select("name", "stage", "status", *have).collect()}
    out = []
    for c in names:
        if c not in rows:
            out.append(f"{c}: not registered")
            continue
        r = rows[c].asDict()
        if stage not in str(r["stage"]).split("|"):
            out.append(f"{c}: stage {r['stage']}")
        role = r.get("role")
        if role == "FORBIDDEN" or r["status"] == "REJECTED":
            out.append(f"{c}: blocked")
        elif roles is not None and role not in roles:
            out.append(f"{c}: role {role}")
        if r["status"] not in statuses:
            out.append(f"{c}: status {r['status']}")
        if str(r.get("earliest") or "").upper().startswith(unproven):
            out.append(f"{c}: known {r['earliest']}")
    return out


def assert_registered(df: DataFrame, registry: DataFrame, stage: str, roles: tuple[str, ...] | None = None, statuses: tuple[str, ...] = ("active",)) -> DataFrame:
    """The same frame, or an error if the registry keeps a column from use at that stage."""
    if bad := registry_errors(df.columns, registry, stage, roles, statuses):
        raise ValueError(f"columns not allowed at {stage}: {'; '.join(bad)}")
    return df


def lineage_gaps(df: DataFrame, lineage: DataFrame) -> DataFrame:
    """Columns without lineage, and lineage without a column."""
    have = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    both = have.withColumn("_h", F.lit(1)).join(lineage.select("column").distinct().withColumn("_l", F.lit(1)), "column", "full")
    return both.filter("_h is null or _l is null").select("column", F.when(F.col("_h").isNull(), "no column").otherwise("no lineage").alias("gap"))


def count_check(df: DataFrame, name: str, condition: Column | None = None, expected: int = 0) -> DataFrame:
    """check_name, value, expected, passed of a number of rows."""
    value = F.count("*") if condition is None else F.count_if(condition)
    return df.agg(value.alias("value")).select(F.lit(name).alias("check_name"), "value", F.lit(expected).cast("long").alias("expected"), (F.col("value") == expected).alias("passed"))


def key_check(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """Surplus rows of a key: each repeated key counts its rows but one."""
    return duplicate_keys(df, *keys).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0)).alias("value")).select(F.lit(name).alias("check_name"), "value", F.lit(0).cast("long").alias("expected"), (F.col("value") == 0).alias("passed"))


def orphan_check(child: DataFrame, parent: DataFrame, name: str, fk: str, pk: str) -> DataFrame:
    return count_check(orphans(child, parent, fk, pk), name)


def checks(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("passed").agg(F.count("*").alias("n_checks"))


def consistency(df: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: for each name the share of rows where the two sides agree, of those where both are known."""
    return df.agg(*[F.avg(F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("double"))).alias(name) for name, (a, b) in pairs.items()])


def price_arithmetic(df: DataFrame, total: Column, unit: Column, size: Column) -> DataFrame:
    """Median and 95th percentile of the relative error of total = unit * size."""
    error = F.abs(F.try_divide(total - unit * size, total))
    errors = df.select(error.cast("double").alias("e"))
    median, p95 = exact_quantiles(errors, ["e"], [0.5, 0.95])["e"] or (None, None)
    return errors.agg(F.count("e").alias("n"), F.lit(median).cast("double").alias("median_error"), F.lit(p95).cast("double").alias("p95_error"))


def volume_by_period(df: DataFrame, time: str, target: Column, unit: str = "yyyy-MM") -> DataFrame:
    return df.groupBy(F.date_format(time, unit).alias("period")).agg(F.count("*").alias("n"), F.avg(target.cast("double")).alias("rate"))


def coverage_by_period(df: DataFrame, time: str, state: str, lag_days: Column) -> DataFrame:
    """Rows, share with a state, median and 90th percentile of its lag, by month."""
    rows = df.select(F.date_format(time, "yyyy-MM").alias("period"), F.col(state).isNotNull().cast("double").alias("_known"), lag_days.alias("_lag"))
    counts = rows.groupBy("period").agg(F.count("*").alias("n"), F.avg("_known").alias("coverage"))
    lags = grouped_quantiles(rows, ["period"], "_lag", {"median_lag": 0.5, "p90_lag": 0.9}).drop("n").withColumnRenamed("period", "_p")
    return counts.join(lags, F.col("period").eqNullSafe(F.col("_p")), "left").drop("_p")


def srm_z(df: DataFrame, arm: str, treatment: str = "treatment", share: float = 0.5) -> DataFrame:
    """z of the sample ratio of two arms against the planned share."""
    c = df.agg(F.count("*").alias("n"), F.count_if(F.col(arm) == treatment).alias("t"))
    return c.select("n", "t", ((F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))).alias("z"))


def gates(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """gate, value, limit, passed for a one-row table of figures; operators are >=, <=, > and <."""
    ops = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}
    made = [F.struct(F.lit(c).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.coalesce(ops[o](F.col(c), F.lit(x)), F.lit(False)).alias("passed")) for c, (o, x) in limits.items()]
    return values.select(F.explode(F.array(*made)).alias("x")).select("x.*")
