"""Groups of rows that are compared with each other: hot groups are split, links become forests and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import forget, materialize


def split_hot(rows: DataFrame, key: str, spread: str, most: int, weight: Column | None = None, most_broadcast: int = 200_000) -> DataFrame:
    """Give each row the column `shard`, and `side`: 0 where all rows of a shard are compared with each other.

    A key with over `most` rows (or that sum of `weight`) is cut into chunks by a hash of `spread`; each pair of
    chunks becomes a shard of its own, whose rows of side 1 are compared with those of side 2.
    """
    hot = rows.groupBy(key).agg(F.sum(F.lit(1) if weight is None else weight).alias("_n")).filter(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_chunks"), "_n")
    n_hot = hot.count()
    if not n_hot:
        return rows.withColumns({"shard": F.xxhash64(key), "side": F.lit(0).cast("byte")})
    # by broadcast, so that rows of hot keys are not dealt out by key; of very many hot keys only the hottest
    looked_up = rows.join(F.broadcast(hot.drop("_n")), key, "left") if n_hot <= most_broadcast else join_per_key(rows, hot, key, most, most_broadcast)
    marked = looked_up.withColumn("_own", F.pmod(F.xxhash64(spread, F.lit(most)), F.coalesce("_chunks", F.lit(1))).cast("int"))
    dealt = marked.withColumn("_other", F.explode(F.sequence(F.lit(0), F.coalesce("_chunks", F.lit(1)) - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).cast("byte")
    return dealt.withColumns({"shard": F.xxhash64(key, F.least("_own", "_other"), F.greatest("_own", "_other")), "side": side}).drop("_chunks", "_own", "_other")


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, most: int = 500, most_broadcast: int = 200_000) -> DataFrame:
    """Left join of rows with a table of one row a key, whose column `_n` tells how many rows the key has.

    Keys of over `most` rows, of more than `most_broadcast` of them the hottest that many, are looked up in a broadcast table, and
    the rows of these keys are dealt out evenly instead of by key.
    """
    rest = [c for c in per_key.columns if c not in (key, "_n")]
    n_hot = per_key.filter(F.col("_n") > most).count()
    if not n_hot:
        return rows.join(per_key.drop("_n"), key, "left")
    if n_hot > most_broadcast:
        counts = per_key.filter(F.col("_n") > most).groupBy("_n").agg(F.count("*").alias("keys"))
        above = F.sum("keys").over(Window.orderBy(F.desc("_n")))  # over one row a count
        most = counts.withColumn("above", above).filter(F.col("above") > most_broadcast).agg(F.max("_n")).first()[0]
    hot = per_key.filter(F.col("_n") > most)
    known = hot.select(key, F.struct(*rest).alias("_hot"))
    marked = rows.join(F.broadcast(known), key, "left")
    # 0 for all rows but those of hot keys; an expression, as Spark would drop a constant from the join's key
    own = F.pmod(F.xxhash64(key), F.lit(1))
    marked = marked.withColumn("_spread", F.when(F.col("_hot").isNull(), own).otherwise(1 + F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 1)))
    cold = per_key.filter(F.col("_n") <= most).select(key, F.struct(*rest).alias("_cold")).withColumn("_spread", own)
    both = marked.join(cold, [key, "_spread"], "left").withColumn("_got", F.coalesce("_hot", "_cold"))
    return both.select(*rows.columns, *[F.col("_got")[c].alias(c) for c in rest])


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Of rows sorted by `by`: tables of whole groups, and where each group begins, with the end as last entry."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(b)).to_numpy(zero_copy_only=False) for b in by]
        if rest:
            last = [rest[-1].column(rest[-1].schema.get_field_index(b))[-1].as_py() for b in by]
            if all(c[0] == x and c[-1] == x for c, x in zip(cols, last)):
                rest.append(batch)
                continue
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut == 0 and not rest:
            rest = [batch]
            continue
        yield _bounded(pa.Table.from_batches([*rest, batch.slice(0, cut)]), by)
        rest = [batch.slice(cut)]
    if rest:
        yield _bounded(pa.Table.from_batches(rest), by)


def _bounded(table: pa.Table, by: list[str]) -> tuple[pa.Table, np.ndarray]:
    cols = [table.column(b).to_numpy() for b in by]
    new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
    return table, np.concatenate([[0], new, [table.num_rows]]).astype(np.int64)


class Forest:
    """Union-find over 0..n-1 that keeps the pairs which joined two trees."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.pairs: list[tuple[int, int]] = []

    def label(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label()
        apart = label[a] != label[b]
        parent = self.parent
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = x, y
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                self.pairs.append((x, y))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges stay the same; every
    round is written to the shared folder. Nothing but two numbers a round reaches the driver.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    pairs = materialize(pairs, "edges")
    seen = None
    while True:
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        least = materialize(least.select(F.col("u").alias("lo"), F.least("u", "m").alias("m"), "_n"), "least")
        large = join_per_key(pairs, least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        large = materialize(large, "large")
        down = materialize(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("_n")), "down")
        small = join_per_key(large, down, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(down.select("hi", F.col("m").alias("lo")))
        after = materialize(small.distinct(), "edges")
        sign = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        for done in (pairs, least, large, down):
            forget(done)
        pairs = after
        if sign == seen:
            break
        seen = sign
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)
