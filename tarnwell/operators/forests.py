"""Extremely randomised trees for 0/1 targets, grown level by level for all trees at once.

Every tree sees all rows. A node draws some features that are not constant in it and one threshold for each, uniform between the node's least
and greatest value, and takes the split with the least Gini impurity (ties: the lowest feature). A level takes two passes over a written table:
ranges of the features in every open node, then counts left of the drawn thresholds; each pass gives one partial result a task and one
aggregation. A batch of rows is turned into columns once for all trees. What reaches the driver has one row a node and feature, at most trees x 2^depth x features. Draws depend on seed, tree and node
alone and counts are exact, so the trees do not depend on how the rows are partitioned.

Rows whose features are null, of another length, or hold nulls, NaN or infinite numbers, or whose target is null, take no part in a fit and get
a null score. Repeated rows count as often as they occur. Without rows, or with one class, each tree is its root (an empty fit scores null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .clusters import _matrix, _summed, usable


@dataclass
class Forest:
    """Trees in heap order: the children of node i are 2i + 1 (value <= threshold) and 2i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def nodes(self, x: np.ndarray, tree: int, levels: int) -> np.ndarray:
        """The node of every row after some levels."""
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(levels):
            f = self.feature[tree, at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[tree, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def probability(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        return sum(self.value[t, self.nodes(x, t, depth)] for t in range(len(self.feature))) / len(self.feature)


def _places(columns: np.ndarray, n: int, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """The place of every row among the nodes of a level of one tree, from the table column by column. Rows of a leaf go on to places below it, which are not open."""
    at, rows, start = np.zeros(n, dtype=np.int64), np.arange(n), np.maximum(feature, 0).astype(np.int64) * n
    for _ in range(levels):
        right = columns.take(start.take(at) + rows) > threshold.take(at)
        at += at
        at += 1
        at += right
    return at - (2**levels - 1)


def _ranges(rows: DataFrame, dims: int, forest: Forest, slot: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each feature in every open node."""
    n, first, width = int(slot.max()) + 1, 2**level - 1, 2**level
    slot = slot[:, first : first + width]
    trees = np.flatnonzero((slot >= 0).any(axis=1))
    small = np.min_scalar_type(width - 1)  # short numbers are sorted by radix

    def partial(batches):
        lo, hi = np.full((dims, n), np.inf), np.full((dims, n), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.ascontiguousarray(_matrix(batch.column("x"), dims).T)
            for t in trees:
                place = _places(x.ravel(), x.shape[1], forest.feature[t], forest.threshold[t], level)
                size = np.bincount(place, minlength=width)
                found = np.flatnonzero(size)
                sorted_ = x.take(np.argsort(place.astype(small), kind="stable"), axis=1)
                starts = (np.cumsum(size) - size)[found]
                s = slot[t, found]
                keep = s >= 0
                s = s[keep]
                lo[:, s] = np.minimum(lo[:, s], np.minimum.reduceat(sorted_, starts, axis=1)[:, keep])
                hi[:, s] = np.maximum(hi[:, s], np.maximum.reduceat(sorted_, starts, axis=1)[:, keep])
        seen = np.flatnonzero(lo[0] <= hi[0])
        if len(seen):
            at = np.tile(np.arange(dims), len(seen)), np.repeat(seen, dims)
            yield pa.RecordBatch.from_arrays([pa.array(at[1].astype(np.int32)), pa.array(at[0].astype(np.int32)), pa.array(lo[at]), pa.array(hi[at])], names=["s", "f", "lo", "hi"])

    got = rows.mapInArrow(partial, "s int, f int, lo double, hi double").groupBy("s", "f").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).toArrow()
    lo, hi = np.zeros((n, dims)), np.zeros((n, dims))
    at = got.column("s").to_numpy(), got.column("f").to_numpy()
    lo[at], hi[at] = got.column("lo").to_numpy(), got.column("hi").to_numpy()
    return lo, hi


def draw(seed: int, tree: int, node: int, lo: np.ndarray, hi: np.ndarray, tried: int) -> list[tuple[int, float]]:
    """Features of a node, ascending, with a threshold each; fewer where fewer are not constant."""
    rng = np.random.default_rng([seed, tree, node])
    open_ = np.flatnonzero(lo < hi)
    picked = np.sort(rng.choice(open_, min(tried, len(open_)), replace=False))
    at = lo[picked] + rng.random(len(picked)) * (hi[picked] - lo[picked])
    return [(int(f), float(min(x, np.nextafter(hi[f], -np.inf)))) for f, x in zip(picked, at)]


def impurity(n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Gini impurity times the number of rows; 0 for none."""
    return 2 * pos * (n - pos) / np.maximum(n, 1)


def fit_extra_trees(df: DataFrame, features: str, target: str, dims: int, trees: int = 100, depth: int = 8, tried: int | None = None, least: int = 5, seed: int = 42) -> Forest:
    """A forest of `trees` trees of at most `depth` levels; `tried` features a node (the root of their number), `least` rows a leaf."""
    tried = tried or max(1, int(np.sqrt(dims)))
    rows = df.filter(usable(features, dims) & F.col(target).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    # dealt to all cores: a pass costs far more than reading, and files of few row groups would be few tasks
    rows = settled(rows.repartition(df.sparkSession.sparkContext.defaultParallelism), "trees")
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    size = 2 ** (depth + 1) - 1
    forest = Forest(np.full((trees, size), -1, dtype=np.int32), np.zeros((trees, size)), np.full((trees, size), np.nan), np.zeros((trees, dims)))
    n, pos = np.zeros((trees, size)), np.zeros((trees, size))
    n[:, 0], pos[:, 0] = total, positive
    if total:
        forest.value[:, 0] = positive / total
    for level in range(depth):
        first, last = 2**level - 1, 2 ** (level + 1) - 1
        here_n, here_pos = n[:, first:last], pos[:, first:last]
        t, i = np.nonzero((here_n >= 2 * least) & (here_pos > 0) & (here_pos < here_n))
        if not len(t):
            break
        i = i + first
        slot = np.full((trees, size), -1, dtype=np.int64)
        slot[t, i] = np.arange(len(t))
        lo, hi = _ranges(rows, dims, forest, slot, level)
        which, where = np.zeros((len(t), tried), dtype=np.int64), np.full((len(t), tried), np.inf)  # an infinite threshold splits nothing off
        for s in range(len(t)):
            for k, (f, x) in enumerate(draw(seed, int(t[s]), int(i[s]), lo[s], hi[s], tried)):
                which[s, k], where[s, k] = f, x
        width = len(t) * tried

        def left(batch: pa.RecordBatch, forest=forest, slot=slot[:, first:last], which=which, where=where, width=width, level=level) -> np.ndarray:
            x = np.ascontiguousarray(_matrix(batch.column("x"), dims).T)
            rows_, y = np.arange(x.shape[1]), batch.column("y").to_numpy()
            columns, out = x.ravel(), np.zeros(2 * width)
            for tree in np.flatnonzero((slot >= 0).any(axis=1)):
                place = _places(columns, len(rows_), forest.feature[tree], forest.threshold[tree], level)
                open_ = np.flatnonzero(slot[tree] >= 0)
                s = slot[tree, open_]
                for k in range(tried):
                    start, most = np.zeros(slot.shape[1], dtype=np.int64), np.full(slot.shape[1], -np.inf)
                    start[open_], most[open_] = which[s, k] * len(rows_), where[s, k]
                    code = 2 * place
                    code += columns.take(start.take(place) + rows_) <= most.take(place)
                    out[s * tried + k] += np.bincount(code, minlength=2 * slot.shape[1])[2 * open_ + 1]
                    out[width + s * tried + k] += np.bincount(code, weights=y, minlength=2 * slot.shape[1])[2 * open_ + 1]
            return out

        sums = _summed(rows, 2 * width, left).reshape(2, len(t), tried)
        nl, pl = sums
        nr, pr = n[t, i][:, None] - nl, pos[t, i][:, None] - pl
        after = np.where((nl >= least) & (nr >= least), impurity(nl, pl) + impurity(nr, pr), np.inf)
        best = after.argmin(axis=1)
        s = np.flatnonzero(np.isfinite(after[np.arange(len(t)), best]))
        k, t, i = best[s], t[s], i[s]
        forest.feature[t, i], forest.threshold[t, i] = which[s, k], where[s, k]
        for child, cn, cp in ((2 * i + 1, nl, pl), (2 * i + 2, nr, pr)):
            n[t, child], pos[t, child] = cn[s, k], cp[s, k]
            forest.value[t, child] = cp[s, k] / cn[s, k]
        np.add.at(forest.gain, (t, which[s, k]), impurity(n[t, i], pos[t, i]) - after[s, k])
    return forest


def with_score(df: DataFrame, features: str, forest: Forest, name: str = "p") -> DataFrame:
    """The frame with the mean share of class 1 over the rows' leaves."""
    dims = forest.gain.shape[1]

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        out, have = np.full(len(x), np.nan), np.flatnonzero(x.notna().to_numpy())
        if len(have):
            out[have] = forest.probability(np.stack(x.iloc[have].to_numpy()).astype(np.float64))
        return pd.Series(out)

    return df.withColumn(name, F.nanvl(score(F.when(usable(features, dims), F.col(features).cast("array<double>"))), F.lit(None).cast("double")))


def importances(forest: Forest) -> list[float]:
    """Share of each feature in the fall of impurity, meaned over the trees that split at all; zeros if none does."""
    total = forest.gain.sum(axis=1)
    split = forest.gain[total > 0] / total[total > 0, None]
    return (split.mean(axis=0) if len(split) else np.zeros(forest.gain.shape[1])).tolist()
