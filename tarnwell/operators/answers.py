"""Requests to an external model and its answers, without the client: admission against a budget, validation, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running


def admitted(requests: DataFrame, key: str, cost: str, budget: float | int, name: str = "admitted") -> DataFrame:
    """Whether each request still fits the budget when requests spend in the order of `key`, and `spent`, the cost up to and with it.

    Spending stops at the first request that does not fit: later, cheaper ones are refused too, so that reruns with a larger budget only add
    requests. One row a key; null costs count as 0; costs are not negative. Running sums are by buckets of the key, not in one task.
    """
    known = requests.withColumn("_cost", F.coalesce(F.col(cost), F.lit(0)))
    out = running(known, key, ["_cost"])
    spent = F.col("before__cost") + F.col("_cost")
    return out.select(*requests.columns, spent.alias("spent"), (spent <= F.lit(budget)).alias(name))


def validated(answers: DataFrame, text: str, statuses: list[str], kinds: list[str]) -> DataFrame:
    """Answers flattened: `status`, `n_issues`, `actionable`, and `error`, the first rule that the text breaks, null for valid ones.

    An answer is a JSON object with a status of `statuses`, and a list `issues` of objects with a classification of `kinds` and a boolean `actionable`.
    Errors, in the order they are looked for: no_answer (null text), not_json, no_status, unknown_status, no_issues, bad_issue. A broken
    answer is a failure of its row alone: its status is null, its number of issues 0, and it is not actionable.
    """
    schema = "status string, issues array<struct<classification string, actionable string>>, _broken string"
    parsed = F.from_json(F.col(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    got = answers.withColumn("_a", parsed)
    issue_ok = lambda x: F.coalesce(x["classification"].isin(kinds) & x["actionable"].isin("true", "false"), F.lit(False))
    error = (
        F.when(F.col(text).isNull(), "no_answer")
        .when(F.col("_a").isNull() | F.col("_a._broken").isNotNull() | (F.trim(text) == ""), "not_json")
        .when(F.col("_a.status").isNull(), "no_status")
        .when(~F.col("_a.status").isin(statuses), "unknown_status")
        .when(F.col("_a.issues").isNull(), "no_issues")
        .when(F.exists("_a.issues", lambda x: ~issue_ok(x)), "bad_issue")
    )
    got = got.withColumn("error", error)
    valid = F.col("error").isNull()
    return got.select(
        *answers.columns,
        F.when(valid, F.col("_a.status")).alias("status"),
        F.when(valid, F.size("_a.issues")).otherwise(0).alias("n_issues"),
        F.coalesce(valid & F.exists("_a.issues", lambda x: x["actionable"] == "true"), F.lit(False)).alias("actionable"),
        "error",
    )


def usage(answers: DataFrame, cached: Column, tokens_in: str, tokens_out: str, per_million: tuple[float, float] | None) -> DataFrame:
    """One row: answers, cached ones, failures, the share that is valid, tokens of answers that are not cached, and their cost (null without rates)."""
    fresh = lambda c: F.coalesce(F.sum(F.when(~cached, F.col(c))), F.lit(0))
    total = answers.agg(
        F.count("*").alias("n"), F.count_if(cached).alias("cached"), F.count("error").alias("errors"), fresh(tokens_in).cast("long").alias("tokens_in"), fresh(tokens_out).cast("long").alias("tokens_out")
    )
    cost = F.lit(None).cast("double") if per_million is None else (F.col("tokens_in") * per_million[0] + F.col("tokens_out") * per_million[1]) / 1e6
    return total.withColumns({"valid_rate": F.try_divide(F.col("n") - F.col("errors"), F.col("n")), "cost": cost})
