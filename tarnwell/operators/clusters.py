"""Clusterings that Spark ML lacks: mixtures with diagonal covariance, clustering-feature trees, truncated SVD of one-hot tables.

Features are an array of doubles, of one length in all rows. Rows whose array is null, of another length, or holds nulls, NaN or infinite
numbers take no part in a fit and get a null profile. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .ordering import exact_quantiles

#: Sums that one row of a partial result holds.
_WIDTH = 64


def usable(features: str, dims: int) -> Column:
    """Whether an array of features can take part."""
    bad = F.exists(features, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(features) == dims) & ~bad, F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _summed(rows: DataFrame, size: int, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of what `add` gives, `size` numbers: one partial result a task, then one aggregation."""

    def partial(batches):
        total, seen = np.zeros(size + -size % _WIDTH), False
        for batch in batches:
            if batch.num_rows:
                total[:size] += add(batch)
                seen = True
        if seen:
            parts = total.reshape(-1, _WIDTH)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(list(parts), pa.list_(pa.float64()))], names=["part", "w"])

    sums = [F.sum(F.get("w", F.lit(k))).alias(f"w{k}") for k in range(_WIDTH)]
    got = rows.mapInArrow(partial, "part int, w array<double>").groupBy("part").agg(*sums).toArrow()
    out = np.zeros((-(-size // _WIDTH), _WIDTH))
    out[got.column("part").to_numpy()] = np.stack([got.column(f"w{k}").to_numpy() for k in range(_WIDTH)], axis=1) if got.num_rows else 0
    return out.ravel()[:size]


def named_by_size(df: DataFrame, label: str, name: str = "profile") -> DataFrame:
    """Labels renamed by size, the largest 0, ties by the old label; null labels stay null."""
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    names = sizes.select(label, (F.row_number().over(Window.orderBy(F.desc("_n"), label)) - 1).alias(name))  # one row a cluster
    return df.join(F.broadcast(names), label, "left").drop(label)


# ---- mixtures


@dataclass
class Mixture:
    """Weights (k), means and variances (k x dims), and the mean log-likelihood of a row before each step."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    trace: list[float]

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        """log(weight times density) of rows by components."""
        dims = x.shape[1]
        out = np.empty((len(x), len(self.weights)))
        for k, (m, v) in enumerate(zip(self.means, self.variances)):
            out[:, k] = np.log(self.weights[k]) - 0.5 * (dims * np.log(2 * np.pi) + np.log(v).sum() + ((x - m) ** 2 / v).sum(axis=1))
        return out


def fit_mixture(df: DataFrame, features: str, start: list[list[float]], steps: int = 100, gain: float = 1e-3, floor: float = 1e-6) -> Mixture:
    """Expectation-maximisation with diagonal covariances from the means in `start`; each step is one aggregation of k (2 dims + 1) sums.

    Sums are taken about the means before, so no digits cancel. It ends when the mean log-likelihood gains less than `gain`. Variances stay at or above `floor`;
    a component without rows keeps its place with weight 1e-12 at least. Without usable rows the start comes back.
    """
    means = np.array(start, dtype=np.float64)
    k, dims = means.shape
    rows = settled(df.select(features).filter(usable(features, dims)), "mixture")
    spread = _summed(rows, 1 + 2 * dims, lambda b: (lambda x: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]))(_matrix(b.column(0), dims)))
    n = spread[0]
    centre = spread[1 : 1 + dims] / max(n, 1)
    model = Mixture(np.full(k, 1 / k), means, np.tile(np.maximum(spread[1 + dims :] / max(n, 1) - centre**2, floor), (k, 1)), [])
    for _ in range(steps if n else 0):

        def add(batch, model=model):
            x = _matrix(batch.column(0), dims)
            z = model.log_joint(x)
            top = z.max(axis=1, keepdims=True)
            share = np.exp(z - top)
            total = share.sum(axis=1, keepdims=True)
            share /= total
            first, second = [], []
            for j in range(k):
                away = x - model.means[j]
                first.append(share[:, j] @ away)
                second.append(share[:, j] @ (away * away))
            return np.concatenate([[(top + np.log(total)).sum()], share.sum(0), *first, *second])

        sums = _summed(rows, 1 + k + 2 * k * dims, add)
        likelihood, held = sums[0] / n, sums[1 : 1 + k]
        first, second = sums[1 + k :].reshape(2, k, dims) / np.maximum(held, 1e-300)[:, None]
        filled = (held > 1e-9)[:, None]
        trace = [*model.trace, float(likelihood)]
        if len(trace) > 1 and trace[-1] - trace[-2] < gain:
            model.trace = trace
            break
        weights = np.maximum(held / n, 1e-12)
        model = Mixture(weights / weights.sum(), np.where(filled, model.means + first, model.means), np.where(filled, np.maximum(second - first**2, floor), model.variances), trace)
    return model


def with_component(df: DataFrame, features: str, model: Mixture, label: str, probability: str | None = None) -> DataFrame:
    """The frame with each row's likeliest component (ties: the smallest number), and how likely it is."""
    k, dims = model.means.shape
    schema = "k int, p double"

    @F.pandas_udf(schema)
    def pick(x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"k": pd.array([None] * len(x), "Int32"), "p": np.nan})
        known = np.flatnonzero(x.notna().to_numpy())
        if len(known):
            z = model.log_joint(np.stack(x.to_numpy()[known]))
            best = z.argmax(axis=1)
            out.loc[known, "k"] = best
            out.loc[known, "p"] = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
        return out

    got = df.withColumn("_picked", pick(F.when(usable(features, dims), F.col(features))))
    out = got.withColumn(label, F.col("_picked.k"))
    if probability:
        out = out.withColumn(probability, F.when(F.col(label).isNotNull(), F.col("_picked.p")))
    return out.drop("_picked")


# ---- clustering-feature trees


class _Node:
    """Entries (count, sum, squared length summed) of a leaf, or of the children of an inner node."""

    def __init__(self, n, s, q, children=None):
        self.n, self.s, self.q, self.children = n, s, q, children

    def centres(self) -> np.ndarray:
        return self.s / self.n[:, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest centre (ties: the first) and the squared distance."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    near = d.argmin(axis=1)
    return near, ((x - centres[near]) ** 2).sum(axis=1)


class FeatureTree:
    """A clustering-feature tree of at most `most` leaf entries and `branching` entries a node.

    An item (a row, or an entry of another tree) goes down to the nearest leaf entry and joins it within the threshold, else it becomes an entry of its own. A
    node that is too full is split between its two farthest entries. Beyond `most` entries the threshold grows to the median distance of nearest
    entries and the tree is built anew from its entries. Items are taken in batches; equal rows always share an entry.
    """

    def __init__(self, dims: int, most: int = 512, branching: int = 32):
        self.dims, self.most, self.branching, self.threshold = dims, most, branching, 0.0
        self.root = self._empty()

    def _empty(self) -> _Node:
        return _Node(np.zeros(0), np.zeros((0, self.dims)), np.zeros(0))

    def leaves(self) -> list[_Node]:
        found, open_ = [], [self.root]
        while open_:
            node = open_.pop()
            if node.children is None:
                found.append(node)
            else:
                open_.extend(reversed(node.children))
        return found

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.leaves()
        return np.concatenate([x.n for x in found]), np.concatenate([x.s for x in found]), np.concatenate([x.q for x in found])

    def add(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        while len(n):
            rest = np.zeros(len(n), bool)
            self._put(self.root, n, s, q, np.arange(len(n)), rest)
            while len(self.root.n) > self.branching:
                parts = self._split(self.root)
                self.root = self._above(parts)
            if sum(len(x.n) for x in self.leaves()) > self.most:
                self._coarsen()
            n, s, q = n[rest], s[rest], q[rest]

    def _put(self, node: _Node, n, s, q, items: np.ndarray, rest: np.ndarray) -> None:
        """Items go into the node's entries; those that come after a full leaf are marked in `rest`."""
        if node.children is not None:
            near, _ = _nearest(s[items] / n[items][:, None], node.centres())
            for k in np.unique(near):
                self._put(node.children[k], n, s, q, items[near == k], rest)
            parts = [p for child in node.children for p in (self._split(child) if len(child.n) > self.branching else [child])]
            above = self._above(parts)
            node.n, node.s, node.q, node.children = above.n, above.s, above.q, above.children
            return
        while len(items):
            x = s[items] / n[items][:, None]
            if len(node.n):
                near, d = _nearest(x, node.centres())
                fits = d <= self.threshold**2
                got, to = items[fits], near[fits]
                np.add.at(node.n, to, n[got])
                np.add.at(node.s, to, s[got])
                np.add.at(node.q, to, q[got])
                items = items[~fits]
            if len(items) and len(node.n) <= self.branching:
                a = items[:1]
                node.n, node.s, node.q = np.append(node.n, n[a]), np.concatenate([node.s, s[a]]), np.append(node.q, q[a])
                items = items[1:]
            elif len(items):
                rest[items] = True
                return

    def _above(self, parts: list[_Node]) -> _Node:
        return _Node(np.array([p.n.sum() for p in parts]), np.stack([p.s.sum(0) for p in parts]), np.array([p.q.sum() for p in parts]), parts)

    def _split(self, node: _Node) -> list[_Node]:
        """Two nodes, around the two farthest entries; equal centres are halved."""
        c = node.centres()
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(d.argmax(), d.shape)
        left = d[a] <= d[b] if a != b else np.arange(len(c)) < len(c) // 2
        return [_Node(node.n[m], node.s[m], node.q[m], None if node.children is None else [x for x, y in zip(node.children, m) if y]) for m in (left, ~left)]

    def _coarsen(self) -> None:
        n, s, q = self.entries()
        c = s / n[:, None]
        d = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        self.threshold = max(1.5 * self.threshold, float(np.sqrt(np.median(d.min(axis=1)))), 1e-12)
        self.root = self._empty()
        self.add(n, s, q)


def ward(n: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Labels of weighted centres joined by Ward's rule down to k clusters."""
    n, c, label = n.astype(np.float64).copy(), centres.copy(), np.arange(len(n))
    d = ((c[:, None] - c[None]) ** 2).sum(axis=2) * (n[:, None] * n[None] / (n[:, None] + n[None]))
    np.fill_diagonal(d, np.inf)
    for _ in range(len(n) - k):
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        c[a] = (n[a] * c[a] + n[b] * c[b]) / (n[a] + n[b])
        n[a] += n[b]
        label[label == b] = a
        d[b], d[:, b] = np.inf, np.inf
        live = np.isfinite(d[a])
        cost = ((c[live] - c[a]) ** 2).sum(axis=1) * n[live] * n[a] / (n[live] + n[a])
        d[a, live], d[live, a] = cost, cost
    return np.unique(label, return_inverse=True)[1]


def feature_tree(df: DataFrame, features: str, dims: int, most: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and squared lengths of at most `most` entries: a tree a task, whose entries are brought into fewer trees round by round."""

    def build(batches):
        tree = FeatureTree(dims, most)
        for batch in batches:
            if batch.num_rows:
                n, q = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
                tree.add(n, _matrix(batch.column(1), dims), q)
        n, s, q = tree.entries()
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(list(s), pa.list_(pa.float64())), pa.array(q)], names=["n", "s", "q"])

    schema = "n double, s array<double>, q double"
    square = F.aggregate(features, F.lit(0.0), lambda a, x: a + x * x)
    rows = df.filter(usable(features, dims)).select(F.lit(1.0).alias("n"), F.col(features).cast("array<double>").alias("s"), square.alias("q"))
    found = settled(rows.mapInArrow(build, schema), "entries")
    while (total := found.count()) > most:
        found = settled(found.repartition(max(1, total // (16 * most))).mapInArrow(build, schema), "entries")
    got = found.orderBy(F.desc("n"), "s").toArrow()  # at most `most` rows
    return got.column("n").to_numpy(), np.array(got.column("s").to_pylist()).reshape(-1, dims), got.column("q").to_numpy()


def tree_profiles(df: DataFrame, features: str, dims: int, k: int, most: int = 512, name: str = "profile") -> DataFrame:
    """Rows labelled by the cluster of the nearest leaf entry; entries are clustered by Ward's rule. Fewer than k entries give fewer clusters."""
    n, s, _ = feature_tree(df, features, dims, most)
    if not len(n):
        return df.withColumn(name, F.lit(None).cast("int"))
    centres = s / n[:, None]
    labels = ward(n, centres, min(k, len(n)))

    @F.pandas_udf("int")
    def pick(x: pd.Series) -> pd.Series:
        out = pd.Series(pd.array([None] * len(x), "Int32"))
        known = np.flatnonzero(x.notna().to_numpy())
        if len(known):
            out.iloc[known] = labels[_nearest(np.stack(x.to_numpy()[known]), centres)[0]]
        return out

    return named_by_size(df.withColumn("_label", pick(F.when(usable(features, dims), F.col(features).cast("array<double>")))), "_label", name)


# ---- truncated SVD


@dataclass
class Components:
    """Singular values and right vectors (columns x k) of the table of standardised numbers and one-hot categories, not centred."""

    singular: np.ndarray
    vectors: np.ndarray
    names: list[str]


def coded(df: DataFrame, categorical: list[str], numeric: list[str], most_values: int = 1000) -> tuple[DataFrame, list[str]]:
    """The frame with `_numbers` (median-filled, standardised) and `_codes` (the place of each category's 1), and the names of all columns.

    A category has a column for each of its `most_values` most frequent values, and one for all others; null is the value <missing>.
    """
    medians = exact_quantiles(df, numeric, [0.5]) if numeric else {}
    filled = {x: F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(float((medians[x] or [0.0])[0] or 0.0))) for x in numeric}
    stats = df.agg(F.count("*"), *[a for x in numeric for a in (F.avg(filled[x]), F.stddev_pop(filled[x]))]).first()
    numbers = [(filled[x] - F.lit(stats[1 + 2 * i] or 0.0)) / F.lit(stats[2 + 2 * i] or 1.0) for i, x in enumerate(numeric)]
    names, codes, out = list(numeric), [], df
    for i, x in enumerate(categorical):
        text = F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("<missing>"))
        values = [r["v"] for r in df.groupBy(text.alias("v")).count().orderBy(F.desc("count"), "v").limit(most_values).collect()]
        known = df.sparkSession.createDataFrame([(v, len(names) + j) for j, v in enumerate(values)], f"_v{i} string, _k{i} int")
        out = out.withColumn(f"_t{i}", text).join(F.broadcast(known), F.col(f"_t{i}") == F.col(f"_v{i}"), "left")  # at most most_values rows
        names += [f"{x}={v}" for v in values] + [f"{x}=?"]
        codes.append(F.coalesce(f"_k{i}", F.lit(len(names) - 1)))
    empty = F.array().cast("array<double>")
    got = out.select(*df.columns, (F.array(*numbers) if numbers else empty).alias("_numbers"), (F.array(*codes) if codes else F.array().cast("array<int>")).alias("_codes"))
    return got, names


def fit_components(rows: DataFrame, names: list[str], n_numbers: int, k: int, extra: int = 8, rounds: int = 4, seed: int = 42) -> Components:
    """The k largest singular values by randomised range finding; `rows` come from coded().

    Each round multiplies an orthonormal basis by A'A in one pass: a row adds its product to the places of its ones and numbers only. The basis has
    k + extra vectors of one entry a column, so columns times k + extra numbers reach the driver. Signs: the largest entry of a vector is positive.
    """
    size, n_codes = len(names), None
    wide = min(size, k + extra)
    table = settled(rows.select("_numbers", "_codes"), "coded")

    def products(batch: pa.RecordBatch, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        numbers = _matrix(batch.column(0), n_numbers) if n_numbers else np.zeros((batch.num_rows, 0))
        y = numbers @ basis[:n_numbers]
        for j in range(codes.shape[1]):
            y += basis[codes[:, j]]
        return numbers, codes, y

    def spread(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
        numbers, codes, y = products(batch, basis)
        z = np.zeros((size, wide))
        z[:n_numbers] = numbers.T @ y
        for j in range(codes.shape[1]):
            np.add.at(z, codes[:, j], y)
        return z.ravel()

    def inner(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
        y = products(batch, basis)[2]
        return (y.T @ y).ravel()

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, wide)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_summed(table, size * wide, lambda b, q=basis: spread(b, q)).reshape(size, wide))[0]
    values, turn = np.linalg.eigh(_summed(table, wide * wide, lambda b, q=basis: inner(b, q)).reshape(wide, wide))
    best = np.argsort(-values, kind="stable")[:k]
    vectors = basis @ turn[:, best]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Components(np.sqrt(np.maximum(values[best], 0)), vectors, names)


def embedded(rows: DataFrame, found: Components, n_numbers: int, name: str = "features") -> DataFrame:
    """Rows of coded() with their products with the components."""
    vectors = found.vectors

    @F.pandas_udf("array<double>")
    def multiply(numbers: pd.Series, codes: pd.Series) -> pd.Series:
        if not len(numbers):
            return pd.Series([], dtype=object)
        y = np.stack(numbers.to_numpy()).reshape(len(numbers), -1)[:, :n_numbers] @ vectors[:n_numbers]
        places = np.stack(codes.to_numpy()).reshape(len(codes), -1).astype(np.int64)
        for j in range(places.shape[1]):
            y += vectors[places[:, j]]
        return pd.Series(list(y))

    return rows.withColumn(name, multiply("_numbers", "_codes")).drop("_numbers", "_codes")
