"""Availability labels and matured rates against plain loops, ties, nulls and empty tables included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import availability as V
from tarnwell.operators.metrics import collapse_guard

T0 = dt.datetime(2024, 1, 1)


def _tables(spark):
    r = random.Random(4)
    day = lambda: T0 + dt.timedelta(days=r.randrange(200))
    states = [(r.choice([1, 2, 3, 3, 3, None]), day(), k, r.choice([True, False, False, None])) for k in range(90)] + [(2, None, 900, True)]
    rows = [(k, r.choice([1, 2, 3, 4, None]), day(), r.choice(["a", "b", None])) for k in range(120)] + [(500, 1, None, "a")]
    return (
        rows, states,
        spark.createDataFrame(rows, "id int, part int, asked timestamp, kind string").repartition(3),
        spark.createDataFrame(states, "part int, at timestamp, snap int, free boolean").repartition(3),
    )


def _plain(rows, states):
    out = {}
    for i, part, asked, kind in rows:
        mine = [s for s in states if part is not None and s[0] == part and s[1] is not None and asked is not None]
        before = [s for s in mine if s[1] <= asked]
        later = [s for s in mine if asked < s[1] <= asked + dt.timedelta(days=30)]
        if not before:
            continue
        now = bool(max(before, key=lambda s: (s[1], s[2]))[3])
        if now or later:
            out[i] = (int(now), int(now or any(s[3] for s in later)), asked if now else asked + dt.timedelta(days=30), asked, kind)
    return out


def _labels(rows, states):
    return V.availability_labels(rows, states, "part", "asked", "at", "free", "snap")


def test_labels_match_plain_loops(spark):
    rows, states, a, b = _tables(spark)
    got = {r.id: (r.current, r.target, r.matured_at, r.asked, r.kind) for r in _labels(a, b).collect()}
    assert got == _plain(rows, states) and len(got) >= 50
    assert _labels(a.limit(0), b).count() == 0 and _labels(a, b.limit(0)).count() == 0


def test_matured_rates_and_scores_match_plain_loops(spark):
    rows, states, a, b = _tables(spark)
    labels, plain = _labels(a, b), _plain(rows, states)
    times = sorted({v[3] for v in plain.values()})
    cuts = V.expanding_cuts(labels, "asked")
    assert cuts == [times[int((len(times) - 1) * s)] for s in (0.2, 0.4, 0.6, 0.8, 1.0)]
    want, scores = {}, {}
    for k in range(1, 5):
        seen = [v for v in plain.values() if v[2] < cuts[k - 1] and not v[0]]
        prior = sum(v[1] for v in seen) / len(seen) if seen else None
        for kind in {v[4] for v in plain.values()}:
            own = [v for v in seen if v[4] == kind]
            rate = None if prior is None else (sum(v[1] for v in own) + 20 * prior) / (len(own) + 20)
            want[k, kind] = (len(own), sum(v[1] for v in own), prior, rate)
        for i, v in plain.items():
            if cuts[k - 1] <= v[3] <= cuts[k]:
                scores[k, i] = 1.0 if v[0] else want[k, v[4]][3]
    got = {(r.fold, r.kind): (r.n, r.hits, r.prior, r.rate) for r in V.matured_rates(labels, "kind", cuts).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    found = {(r.fold, r.id): r.p for r in V.matured_scores(labels, "kind", "asked", cuts).collect()}
    assert found.keys() == scores.keys() and all(found[k] == pytest.approx(scores[k]) for k in found)


def test_cuts_of_an_empty_table(spark):
    _, _, a, b = _tables(spark)
    assert V.expanding_cuts(_labels(a.limit(0), b), "asked") == []
    with pytest.raises(ValueError):
        V.matured_rates(_labels(a, b), "kind", [])


def test_collapse_guard_has_two_arms_and_forgets_no_segment(spark):
    schema = "fold int, seg string, n_rows long, average_precision double, brier double"
    base = [(f, s, 200, 0.5, 0.2) for f in (1, 2, 3) for s in ("ap", "brier", "fine", None, "gone")] + [(1, "small", 99, 0.5, 0.2)]
    other = [(f, "ap", 200, 0.4, 0.2) for f in (1, 2)] + [(3, "ap", 200, 0.5, 0.2)]
    other += [(f, "brier", 200, 0.5, 0.23 if f < 3 else 0.2) for f in (1, 2, 3)] + [(f, "fine", 200, 0.49, 0.21) for f in (1, 2, 3)]
    other += [(f, None, 200, 0.1, 0.9) for f in (1, 2, 3)] + [(1, "small", 99, 0.1, 0.9), (1, "new", 300, 0.9, 0.1)]
    out = collapse_guard(spark.createDataFrame(base, schema), spark.createDataFrame(other, schema), ["seg"])
    got = {r.seg: (r.n_worse, r.n_folds, r.n_skipped, r.collapsed) for r in out.collect()}
    assert got == {"ap": (2, 3, 0, True), "brier": (2, 3, 0, True), "fine": (0, 3, 0, False), None: (3, 3, 0, True), "gone": (0, 0, 3, False), "small": (0, 0, 1, False), "new": (0, 0, 1, False)}


def test_folding_takes_all_letters_that_decompose(spark):
    from tarnwell.functions.scalars import fold_text, mentions

    texts = ["ÁÉÍÓÚÜÑ àâçêîôû", "Šířka žluťoučký", "Ångström ǖ ế", "été", "ß ø ł đ", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(fold_text(F.col("t"))).collect()] == ["aeiouun aaceiou", "sirka zlutoucky", "angstrom u e", "ete", "ß ø ł đ", "", None]
    assert [r[0] for r in df.select(mentions(F.col("t"), ["ete", "sirka"])).collect()] == [False, True, False, True, False, False, False]
    assert not any(r[0] for r in df.select(mentions(F.col("t"), [])).collect())
