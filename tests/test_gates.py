"""The registry gate, and what an enquiry changes of what was known."""

import pytest
from pyspark.sql import functions as F

from tarnwell.operators.audit import assert_registered, registry_errors
from tarnwell.operators.features import change_features


def test_registry_gate_names_every_reason(spark):
    rows = [
        ("ok", "T0|T1", "active", "QUALITY", "at intake"), ("late", "T2", "active", "QUALITY", None), ("other", "T1", "active", "PRICE", "x"),
        ("secret", "T1", "active", "FORBIDDEN", "x"), ("gone", "T1", "REJECTED", "QUALITY", "x"), ("idea", "T1", "draft", "QUALITY", "unproven so far"),
    ]
    registry = spark.createDataFrame(rows, "name string, stage string, status string, role string, earliest string")
    names = ["ok", "late", "other", "secret", "gone", "idea", "new"]
    assert registry_errors(names, registry, "T1", ("QUALITY",)) == [
        "late: stage T2", "other: role PRICE", "secret: blocked", "gone: blocked", "gone: status REJECTED", "idea: status draft", "idea: known unproven so far", "new: not registered",
    ]
    df = spark.createDataFrame([(1, 2)], "ok int, other int")
    assert assert_registered(df.select("ok"), registry, "T0", ("QUALITY",)).count() == 1
    assert assert_registered(df, registry.drop("role", "earliest"), "T1").count() == 1
    with pytest.raises(ValueError, match="other: role PRICE"):
        assert_registered(df, registry, "T1", ("QUALITY",))
    assert registry_errors(["a"], registry.limit(0), "T1") == ["a: not registered"]


def test_changes_of_an_enquiry(spark):
    schema = "id int, mode string, wanted double, size double, words int, rlo double, rhi double, rask double, slo double, shi double, sask double, known double"
    rows = [
        (1, "rent", 100.0, 111.0, 9, 10.0, 20.0, 30.0, None, None, None, 0.5),
        (2, "both", 100.0, 104.0, None, 10.0, 20.0, 15.0, 1.0, 2.0, None, 1.0),
        (3, "sale", 0.0, 50.0, -1, None, None, 5.0, 1.0, 2.0, 3.0, 0.0),
        (4, None, None, None, None, None, None, None, None, None, None, None),
        (5, "both", 100.0, 90.0, 0, 10.0, 20.0, None, 1.0, 2.0, None, 0.0),
    ]
    df = spark.createDataFrame(rows, schema)
    f = change_features(df, "mode", "wanted", "size", "words", {"rent": ("rlo", "rhi", "rask"), "sale": ("slo", "shi", "sask")}, ["size", "words"], "known")
    got = {r.id: r for r in f.collect()}
    view = lambda *c: {k: tuple(r[x] for x in c) for k, r in got.items()}
    assert view("rent_asked_state", "sale_asked_state") == {1: ("OBSERVED", "NOT_APPLICABLE"), 2: ("OBSERVED", "UNKNOWN"), 3: ("NOT_APPLICABLE", "OBSERVED"), 4: ("NOT_APPLICABLE",) * 2, 5: ("UNKNOWN",) * 2}
    assert view("rent_asked_inside", "sale_asked_inside") == {1: (False, None), 2: (True, None), 3: (None, False), 4: (None, None), 5: (None, None)}
    assert view("size_direction", "mode_consistent", "need_changes") == {1: ("HIGHER", True, 2), 2: ("SAME", True, 0), 3: ("SAME", False, 1), 4: ("SAME", False, 0), 5: ("LOWER", False, 0)}
    assert view("asked_completeness") == {1: (1.0,), 2: (0.5,), 3: (1.0,), 4: (0.0,), 5: (0.5,)}
    assert got[1].rent_asked_distance == pytest.approx(10 / 15) and got[1].rent_asked_ratio == 2.0 and got[3].size_ratio is None and got[4].completeness_gain is None
    assert df.limit(0).count() == 0 and f.filter(F.col("id") > 9).count() == 0


def test_a_sentence_repeated_in_one_row_is_one_row(spark):
    from tarnwell.operators.textrules import sentence_frequency

    df = spark.createDataFrame([("Yes. No. Yes.",), ("Yes. Maybe.",), ("No. No.",), ("Solo. Solo.",), ("",), (None,)], "t string")
    assert sorted(map(tuple, sentence_frequency(df, "t").collect())) == [("No.", 2, 3), ("Yes.", 2, 3)]
