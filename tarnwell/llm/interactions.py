"""How the filters of a chain interact: what each one removes at each place of every order.

Documents become cells: per part of the table and per mask of failed filters, the number of documents and of good
and toxic ones among them. All orders of the filters are then visited by single swaps of neighbours; a swap at two
places changes what those two steps remove and what is left between them, and nothing else, so only these are counted
anew, from the cells. Shapley sums grow along the walk. Parts are walked together as numpy columns.

Whether a text is a copy of an earlier one is a matter of the whole table: digests of texts and ids are grouped,
never the texts, and who has its digest's smallest id is looked up by digest and id together, so that a text with any
number of copies is no hot key.

Edge cases: a null text is an empty one; a null part is the part of the empty string; whole texts are judged, however long;
a null id is smaller than no other and has no label, so such rows are never copies and make none; rows that repeat an id
and its text are all first ones (ties); a document labelled more than once is good or toxic if any label says so;
an empty table gives no rows; extra columns are ignored and their names never clash, as columns are picked and renamed first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD, materialize, table


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repeated words, many capitals, odd signs."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def document_cells(docs: DataFrame, labels: DataFrame, filters=text_filters, copies: str | None = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, list[str]]:
    """Cells (part, mask, n, good, toxic) and the letters of the mask's bits, the lowest first.

    `filters` gives the conditions on a text by letter; `copies` is the letter of the filter that fails for texts of a smaller id.
    """
    conditions = filters(F.col("_text"))
    letters = [*conditions, *([copies] if copies else [])]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    # rows without an id need no digest, so they fold to a few rows here
    judged = rows.select("id", "part", mask.cast("int").alias("mask"), F.when(F.col("id").isNotNull(), F.unhex(F.sha2("_text", 256))).alias("digest"))
    judged = judged.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    known = labels.select(F.col("doc_id").alias("id"), "quality", "toxic").filter("id is not null").groupBy("id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = judged.join(known, "id", "left").select("id", "digest", "part", "mask", "n", *[(F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])
    if copies:
        judged = materialize(judged, "judged")
        first = judged.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(0))
        judged = judged.join(first, ["digest", "id"], "left").withColumn("mask", F.col("mask") + F.when(F.col("digest").isNull(), 0).otherwise(F.coalesce("first", F.lit(1 << len(conditions)))))
    return judged.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in ("n", "good", "toxic")]), letters


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places whose elements change with the next ones, n! - 1 swaps through all orders of n elements.

    The largest element that can move walks through the others; every element remembers its direction.
    """
    order, step = list(range(n)), [-1] * n
    for _ in range(math.factorial(n) - 1):
        free = [x for k, x in enumerate(order) if 0 <= k + step[x] < n and order[k + step[x]] < x]
        x = max(free)
        k = order.index(x)
        j = k + step[x]
        order[k], order[j] = order[j], order[k]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield min(j, k)


class OrderWalk:
    """Steps of the filter order that is being visited, for many parts at once.

    `cells` holds, by part and mask, the documents, good and toxic ones. `removed` holds what each step removes, `kept` what it leaves.
    """

    def __init__(self, cells: np.ndarray, n: int):
        self.cells, self.n, self.masks = cells, n, np.arange(1 << n)
        self.order, self.removed, self.kept = list(range(n)), [None] * n, [None] * n
        for k in range(n):
            self._count(k)
        self.shapley = np.zeros((len(cells), n), dtype=np.int64)
        self._visit()

    def _count(self, step: int) -> None:
        before = sum(1 << f for f in self.order[:step])
        there = (self.masks & before) == 0
        fails = (self.masks >> self.order[step] & 1).astype(bool)
        self.removed[step] = self.cells[:, there & fails].sum(axis=1)
        self.kept[step] = self.cells[:, there & ~fails, 0].sum(axis=1)

    def _visit(self) -> None:
        for f, removed in zip(self.order, self.removed):
            self.shapley[:, f] += removed[:, 0]

    def swap(self, place: int) -> None:
        o = self.order
        o[place], o[place + 1] = o[place + 1], o[place]
        self._count(place)
        self._count(place + 1)
        self._visit()


def _walk(cells: np.ndarray, letters: list[str]) -> tuple[list[str], dict[str, np.ndarray]]:
    """All orders, in the walk's sequence, and measures by part, order and step."""
    n = len(letters)
    walk, orders, seen = OrderWalk(cells, n), [], []
    swaps = neighbour_swaps(n)
    while True:
        orders.append(list(walk.order))
        seen.append((np.stack(walk.removed, axis=1), np.stack(walk.kept, axis=1)))
        place = next(swaps, None)
        if place is None:
            break
        walk.swap(place)
    at = np.array(orders)  # order x step -> filter
    removed, kept = (np.stack(x, axis=1) for x in zip(*seen))
    failing = np.stack([cells[:, (walk.masks >> f & 1).astype(bool), 0].sum(axis=1) for f in range(n)], axis=1)
    alone = np.stack([cells[:, 1 << f, 0] for f in range(n)], axis=1)
    out = {
        "kept": kept, "removed": removed[..., 0], "redundant": failing[:, at] - removed[..., 0], "unique_fails": alone[:, at],
        "good_lost": removed[..., 1], "toxic_lost": removed[..., 2], "shapley": walk.shapley[:, at],
    }
    return ["".join(letters[f] for f in o) for o in orders], out


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_orders(cells: DataFrame, letters: list[str], parts_at_once: int = 64) -> DataFrame:
    """part, filter_order, step and the measures: a row per part, order and step, from cells (part, mask, n, good, toxic)."""
    n = len(letters)
    if n > 8:
        raise ValueError("all orders of more than 8 filters are too many")

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, parts_at_once):
                some = batch.slice(first, parts_at_once)
                table_ = np.zeros((some.num_rows, 1 << n, 3), dtype=np.int64)
                for k, cell in enumerate(some.column(1).to_pylist()):
                    for c in cell:
                        table_[k, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, measures = _walk(table_, letters)
                width = len(orders) * n
                names = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), width)))
                order = pa.array(np.tile(np.repeat(orders, n), some.num_rows).tolist(), pa.string())
                step = pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), some.num_rows * len(orders)))
                yield pa.RecordBatch.from_arrays([names, order, step, *[pa.array(measures[m].reshape(-1)) for m in MEASURES]], names=["part", "filter_order", "step", *MEASURES])

    # at most 2^n cells a part
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return per_part.mapInArrow(work, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))


OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END)
 + (CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN first < w.doc_id THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL), f(b, x) AS (VALUES (1, 'A'), (2, 'B'), (4, 'C'), (8, 'D'), (16, 'E')),
o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31),
s AS (SELECT filter_order, step, bs[step] AS bit, CAST(coalesce(list_sum(bs[1:step - 1]), 0) AS INT) AS before FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, any_value(bit) AS bit, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed,
 coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
 coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
 CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    cells, letters = document_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit_orders(cells, letters)
