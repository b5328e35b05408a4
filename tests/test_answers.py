"""Admission against a budget, validation of answers, and their totals."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import answers as A


@pytest.mark.parametrize("budget", [0, 5, 17, 10**6])
def test_spending_stops_at_the_first_request_that_does_not_fit(spark, budget):
    costs = [3, None, 2, 40, 1, 0, 5]
    df = spark.createDataFrame(list(enumerate(costs)), "id long, cost long")
    spent, want = 0, {}
    for k, c in enumerate(costs):
        spent += c or 0
        want[k] = (spent, spent <= budget)
    assert {r.id: (r.spent, r.admitted) for r in A.admitted(df, "id", "cost", budget).collect()} == want
    assert A.admitted(df.filter("false"), "id", "cost", budget).count() == 0


ANSWERS = [
    (None, "no_answer"), ("", "not_json"), ("   ", "not_json"), ("{", "not_json"), ("text", "not_json"), ("{}", "no_status"), ('{"status":null,"issues":[]}', "no_status"), ('{"status":"x","issues":[]}', "unknown_status"),
    ('{"status":"ok"}', "no_issues"), ('{"status":"ok","issues":[{"classification":"a","actionable":"maybe"}]}', "bad_issue"), ('{"status":"ok","issues":[{"classification":"z","actionable":true}]}', "bad_issue"),
    ('{"status":"ok","issues":[{"classification":"a"}]}', "bad_issue"), ('{"status":"ok","issues":[null]}', "bad_issue"), ('{"status":"ok","issues":[]}', None),
    ('{"status":"bad","issues":[{"classification":"a","actionable":false},{"classification":"b","actionable":true}],"more":1}', None),
]


def test_each_rule_fails_its_own_row(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(ANSWERS)], "id long, answer string")
    got = {r.id: r for r in A.validated(df, "answer", ["ok", "bad"], ["a", "b"]).collect()}
    assert [got[k].error for k in range(len(ANSWERS))] == [e for _, e in ANSWERS]
    assert [(r.status, r.n_issues, r.actionable) for k, r in sorted(got.items()) if r.error is None] == [("ok", 0, False), ("bad", 2, True)]
    assert {(r.status, r.n_issues, r.actionable) for r in got.values() if r.error} == {(None, 0, False)}


def test_usage_counts_what_is_not_cached(spark):
    df = spark.createDataFrame([(0, None, 10, 5), (1, "not_json", 20, None), (2, None, 40, 7)], "id long, error string, a long, b long")
    row = A.usage(df, F.col("id") == 0, "a", "b", (1.0, 2.0)).first()
    assert (row.n, row.cached, row.errors, row.tokens_in, row.tokens_out) == (3, 1, 1, 60, 7)
    assert row.valid_rate == pytest.approx(2 / 3) and row.cost == pytest.approx(74e-6)
    assert A.usage(df, F.col("id") == 0, "a", "b", None).first().cost is None
    empty = A.usage(df.filter("false"), F.col("id") == 0, "a", "b", (1.0, 2.0)).first()
    assert (empty.n, empty.tokens_in, empty.valid_rate) == (0, 0, None)
