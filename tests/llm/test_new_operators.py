"""Filter audit, document fingerprints and fill-in-the-middle against plain loops, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import interactions, middles, versions
from tarnwell.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA
from tests.llm.test_llm import corpus, none, odd, words  # noqa: F401
from tests.oracle import connect, spark_rows, sql_rows

LABELS = "doc_id long, quality int, toxic int, part string"


# ---- interactions of filters


def brute_audit(rows, labels):
    """The audit by applying the filters to the documents themselves, order by order."""
    good, toxic = collections.Counter(), collections.Counter()
    for d, q, t in labels:
        good[d] |= q == 1
        toxic[d] |= t == 1
    fails = []
    for d, text, source in rows:
        w, text = words(text), text or ""
        copy = d is not None and any(e is not None and e < d and (u or "") == text for e, u, _ in rows)
        bad = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text), copy]
        fails.append((source or "", {x for x, b in zip("ABCDE", bad) if b}, d is not None and good[d], d is not None and toxic[d]))
    out = {}
    for part in {f[0] for f in fails}:
        mine, total = [f for f in fails if f[0] == part], collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [f for f in left if letter in f[1]], [f for f in left if letter not in f[1]]
                failing = sum(letter in f[1] for f in mine)
                total[letter] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for key, value in out.items():
            if key[0] == part:
                value.append(total[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(docs, labels):
    rows = interactions.audit_orders(*interactions.document_cells(docs, labels)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in interactions.MEASURES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_against_brute_force(spark, corpus, odd):  # noqa: F811
    rng = random.Random(3)
    texts = ["WORD " * 10, "a b c " * 100, "x$y", "", None, " ".join(f"w{k}" for k in range(250)), "W " + " ".join(f"w{k}" for k in range(250))]
    rows = [(k, rng.choice(texts), "en", rng.choice(["s", "t", "", None]), 1, None, 1, 1, None) for k in range(60)]
    mixed = odd.unionByName(spark.createDataFrame(rows, odd.schema))
    marks = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for k in range(50)] + [(1, 1, 0, "x"), (1, 0, 1, "x"), (None, 1, 1, "x")]
    labels = spark.createDataFrame(marks, LABELS)
    for docs in (mixed, corpus.filter("doc_id < 60")):
        want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [m[:3] for m in marks])
        assert audited(docs, labels) == want


def test_copies_of_many_ids_and_nothing(spark, odd, none):  # noqa: F811
    labels = spark.createDataFrame([], LABELS)
    same = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    got = audited(same, labels)
    first = {k[0]: v for k, v in got.items() if k[1] == "EABCD" and k[2] == 1}
    assert {p: v[0] for p, v in first.items()} == {"s0": 1, "s1": 0, "s2": 0} and sum(v[1] for v in first.values()) == 499
    assert audited(none, labels) == {}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_neighbour_swaps_visit_all_orders(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in interactions.neighbour_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_walk_counts_only_the_swapped_steps():
    rng = np.random.default_rng(1)
    walk = interactions.OrderWalk(rng.integers(0, 9, (3, 16, 3)), 4)
    counted = []
    count = walk._count
    walk._count = lambda step: (counted.append(step), count(step))
    for k in interactions.neighbour_swaps(4):
        walk.swap(k)
        fresh = interactions.OrderWalk(walk.cells, 4)
        fresh.order = list(walk.order)
        for step in range(4):
            fresh._count(step)
            assert (fresh.removed[step] == walk.removed[step]).all() and (fresh.kept[step] == walk.kept[step]).all()
    assert len(counted) == 2 * 23


# ---- fingerprints


def bag(text):
    return collections.Counter(versions.paragraphs((text or "").encode()))


def alike(a, b):
    x, y = bag(a), bag(b)
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


def followed(rows):
    """Rows (id, text) with the text of the next one."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, (r[1] or "").encode()))
    return [(d, t or "", order[(k + 1) % len(order)][1] or "") for k, (d, t) in enumerate(order)]


def test_paragraphs_are_the_text():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab .\n!ü\t") for _ in range(rng.randint(0, 60))).encode()
        got = versions.paragraphs(text)
        assert b"".join(got) == text and all(len(p.split()) <= 4 for p in got)
    assert versions.paragraphs(b"One two three four five. Six\nseven") == [b"One two three four ", b"five. ", b"Six\n", b"seven"]


@pytest.mark.parametrize("table", ["corpus", "odd"])
@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_fingerprints_against_brute_force(request, spark, table, partitions):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pairs = versions.with_next(docs).withColumn("edited", versions.half_replaced(F.col("text"), F.col("next_text")))
        got = versions.compare_versions(pairs.withColumn("m", F.sha2("edited", 256)), "text", ["edited", "next_text"], ["doc_id", "m"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = collections.Counter()
    for d, t, u in followed(rows):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        want[str(d), hashlib.sha256(edited.encode()).hexdigest(), round(alike(t, edited), 9), round(alike(t, u), 9), sum((bag(t) - bag(edited)).values()), sum((bag(edited) - bag(t)).values())] += 1
    assert collections.Counter((str(r.doc_id), r.m, round(r.likeness_edited, 9), round(r.likeness_next_text, 9), len(r.gone_edited), len(r.come_edited)) for r in got) == want


def test_equal_texts_have_equal_fingerprints(spark):
    rows = QUERIES["op12_document_fingerprints"](spark, DATA).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    by = collections.defaultdict(set)
    for r in rows:
        by[texts[r.doc_id]].add(r.fingerprint)
        assert r.n_chars == len(texts[r.doc_id]) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and len(r.fingerprint) == 4 * math.ceil(16 * versions.CELLS / 3)
    assert all(len(f) == 1 for f in by.values()) and len({f for x in by.values() for f in x}) == len(by)
    long = [r for r in rows if r.n_chars > 500]
    assert sum(r.near_edited > r.near_next or r.near_next == 1 for r in long) > 0.99 * len(long)


def test_peeling_recovers_the_difference_and_grows():
    rng = random.Random(7)
    for n, m in ((0, 0), (1, 0), (5, 3), (40, 0), (400, 300), (3000, 3000)):
        common, a, b = ([f"{kind}{rng.getrandbits(50)} x.\n" for _ in range(k)] for kind, k in (("c", 500), ("a", n), ("b", m)))
        texts = ["".join(rng.sample(x, len(x)) * 1).encode() for x in (common + a + a[:2], common + b)]
        left, right = versions.Digests([texts[0], b"", texts[0]]), versions.Digests([texts[1], texts[1], texts[0]])
        owner, keys, sign = versions.differences(left, right)
        assert collections.Counter(zip(owner.tolist(), sign.tolist())) == collections.Counter({(0, 1): n + len(a[:2]), (0, -1): m, (1, -1): 500 + m}) - collections.Counter()
        mine, theirs = set(left.of(np.array([0]))[0].tolist()), set(right.of(np.array([0]))[0].tolist())
        assert set(keys[(owner == 0) & (sign > 0)].tolist()) == mine - theirs and set(keys[(owner == 0) & (sign < 0)].tolist()) == theirs - mine


def test_fingerprints_of_one_and_of_none(spark, none):  # noqa: F811
    assert versions.with_next(none).count() == 0
    one = spark.createDataFrame([(5, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in versions.with_next(one).collect()] == [(5, "one two", "one two")]


# ---- fill in the middle


def brute_middle(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not text or any(m in text for m in middles.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = text[:low], text[low:high], text[high:]
    return (n, "spm", low, high - low, f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 20 else (n, "psm", low, high - low, f"<P>{a}<S>{c}<M>{b}")


@pytest.mark.parametrize("table", ["corpus", "odd"])
def test_middles_against_brute_force(request, table):
    docs = request.getfixturevalue(table)
    source = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    made = middles.fill_in_middle(docs)
    got = made.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == collections.Counter((str(d), *brute_middle(d, t)) for d, t in source)
    assert collections.Counter((str(r.doc_id), r.back) for r in got) == collections.Counter((str(d), t or "") for d, t in source)


def test_middles_of_all_widths_marks_and_ends(spark, none):  # noqa: F811
    rng = random.Random(5)
    parts = ["a", "é", "漢", "😀", "<", "<P", "S>", "<M", "\n", "\u0000"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for k in range(400)] + [(1000, "x<P>y"), (1001, "漢" * 70000), (1002, "é😀" * 3)]
    made = middles.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), slice_bytes=500)
    got = {r.doc_id: r for r in made.withColumn("back", middles.restored(F.col("output"), F.col("form"))).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(d, t) and r.back == t
    assert middles.fill_in_middle(none).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 20])
def test_class_runs_find_every_cut(piece):
    text = "abc" + "é" * 5 + "漢字😀😀x" + "ß" + "y" * 9 + "😀"
    data = text.encode()
    runs = middles.ClassRuns(data, piece)
    every = np.arange(len(text) + 1)
    assert runs.units == len(text) and runs.byte_of(every).tolist() == [len(text[:k].encode()) for k in every]
    assert runs.unit_of(runs.byte_of(every)).tolist() == every.tolist()
    # runs are maximal whatever the piece
    assert len(runs.unit) == 8 and (np.diff(runs.width) != 0).all()


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_against_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == sql_rows(connect(DATA), ORACLES[name])
