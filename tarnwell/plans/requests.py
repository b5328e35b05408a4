"""Queries on requests to an external model: what a budget admits, which answers are valid, what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import answers as A
from tarnwell.plans.registry import orders, query, r6


@query("""WITH c AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS cost FROM orders)
SELECT id, cost, CAST(sum(cost) OVER (ORDER BY id) AS BIGINT) AS spent, sum(cost) OVER (ORDER BY id) <= (SELECT sum(cost) // 5 * 2 FROM c) AS admitted FROM c""")
def admitted_requests(spark: SparkSession, d: str) -> DataFrame:
    """Orders as requests that cost their price, admitted in the order of their keys up to two fifths of what all would cost."""
    o = orders(spark, d).select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cost"))
    budget = o.agg(F.sum("cost")).first()[0] or 0
    return A.admitted(o, "id", "cost", budget // 5 * 2).select("id", "cost", "spent", "admitted")


#: Answers made of orders: cut off texts, texts without a status, without issues, and whole ones of all states and priorities.
_ANSWERS = """SELECT o_orderkey AS id, length(o_orderpriority) AS tokens_in, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '{"status":"F","issues":[{"class' WHEN o_orderkey % 13 = 0 THEN '{"issues":[]}' WHEN o_orderkey % 19 = 0 THEN '{"status":"F"}'
 ELSE '{"status":"' || o_orderstatus || '","issues":[{"classification":"' || o_orderpriority || '","actionable":' || CASE WHEN o_custkey % 3 = 0 THEN 'true' WHEN o_custkey % 3 = 1 THEN 'false' ELSE 'null' END || '}]}' END AS answer FROM orders"""
_STATUSES, _KINDS = ["F", "O"], ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]
_CHECKED = f"""WITH a AS (SELECT *, CASE WHEN json_valid(answer) THEN answer END AS whole FROM ({_ANSWERS})), e AS (SELECT *, CASE WHEN answer IS NULL THEN 'no_answer' WHEN whole IS NULL THEN 'not_json' WHEN json_extract_string(whole, '$.status') IS NULL THEN 'no_status'
 WHEN json_extract_string(whole, '$.status') NOT IN ('F', 'O') THEN 'unknown_status' WHEN json_extract(whole, '$.issues') IS NULL THEN 'no_issues'
 WHEN json_extract_string(whole, '$.issues[0].classification') NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') OR coalesce(json_extract_string(whole, '$.issues[0].actionable'), 'null') = 'null' THEN 'bad_issue' END AS error FROM a)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    o, k = orders(spark, d), F.col("o_orderkey")
    flag = F.when(F.col("o_custkey") % 3 == 0, "true").when(F.col("o_custkey") % 3 == 1, "false").otherwise("null")
    whole = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","issues":[{"classification":"'), "o_orderpriority", F.lit('","actionable":'), flag, F.lit("}]}"))
    text = F.when(k % 17 == 0, None).when(k % 11 == 0, '{"status":"F","issues":[{"class').when(k % 13 == 0, '{"issues":[]}').when(k % 19 == 0, '{"status":"F"}').otherwise(whole)
    return A.validated(o.select(k.alias("id"), F.length("o_orderpriority").alias("tokens_in"), text.alias("answer")), "answer", _STATUSES, _KINDS)


@query(f"""{_CHECKED} SELECT id, CASE WHEN error IS NULL THEN json_extract_string(whole, '$.status') END AS status, CAST(CASE WHEN error IS NULL THEN 1 ELSE 0 END AS INT) AS n_issues,
 error IS NULL AND json_extract_string(whole, '$.issues[0].actionable') = 'true' AS actionable, error FROM e""")
def validated_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers flattened, with the rule that each failed one breaks."""
    return _checked(spark, d).select("id", "status", "n_issues", "actionable", "error")


@query(f"""{_CHECKED} SELECT count(*) AS n, count(*) FILTER (id % 5 = 0) AS cached, count(error) AS errors, round((count(*) - count(error)) / count(*), 6) AS valid_rate,
 CAST(sum(tokens_in) FILTER (id % 5 <> 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(length(answer)) FILTER (id % 5 <> 0), 0) AS BIGINT) AS tokens_out,
 round((sum(tokens_in) FILTER (id % 5 <> 0) * 0.4 + sum(length(answer)) FILTER (id % 5 <> 0) * 1.6) / 1000000, 6) AS cost FROM e""")
def answer_usage(spark: SparkSession, d: str) -> DataFrame:
    """Failures, tokens and cost of the answers that did not come from a cache of every fifth order."""
    rows = _checked(spark, d).withColumn("tokens_out", F.length("answer"))
    return A.usage(rows, F.col("id") % 5 == 0, "tokens_in", "tokens_out", (0.4, 1.6)).select("n", "cached", "errors", "tokens_in", "tokens_out", *r6("valid_rate", "cost"))
