"""Near-duplicate vectors by p-stable hashing for the Euclidean distance.

Vectors are normalised, so a cosine bounds their distance. In each of several tables
a vector falls into the bucket of its quantised Gaussian projections; the vectors of
a bucket are compared exactly, in double precision. The numbers of projections and
tables follow from the number of distinct vectors, the least cosine and the recall
wanted for pairs exactly at that cosine (nearer pairs are found more surely).

Equal vectors are one class: its members link with each other without being compared.
A pair that shares buckets in several tables counts in the first one only, so links are
counted without emitting them; a bucket emits counts and just enough links to connect
what it connects. Hot buckets are cut into pairs of chunks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and stand alone; vectors of different lengths never link; null ids count
as links but never name a component (all null: null); repeated rows each give a row;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table
from ._shards import Forest, connected_components, join_per_key, split_hot, whole_groups

WIDTH = 2.0


def same_bucket(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees for two points at a distance (Gaussian is 2-stable)."""
    r = width / distance
    return 1 - 2 * (0.5 * math.erfc(r / math.sqrt(2))) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, cosine: float, recall: float, bucket: int = 256) -> tuple[int, int]:
    """(projections of a table, tables): unrelated vectors meet `bucket` others in a table, pairs at the cosine meet with the recall."""
    near, far = same_bucket(math.sqrt(2 - 2 * cosine) or 1e-6), same_bucket(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 2) / bucket) / -math.log(far))) if n > bucket else 2
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


class Hashes:
    """Bucket keys of normalised vectors, one for each table; the same everywhere for a seed."""

    def __init__(self, dims: int, k: int, tables: int, seed: int = 11):
        rng = np.random.default_rng([seed, dims, k, tables])
        self.k, self.tables = k, tables
        self.a = rng.standard_normal((dims, k * tables))
        self.b = rng.uniform(0, WIDTH, k * tables)
        self.mix = rng.integers(1, 1 << 62, k * tables, dtype=np.int64) * 2 + 1

    def keys(self, unit: np.ndarray) -> np.ndarray:
        q = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64)
        with np.errstate(over="ignore"):
            h = (q * self.mix).reshape(len(unit), self.tables, self.k).sum(axis=2)
            return (h ^ (h >> 29)) * np.int64(0x1F85EBCA6B2AE3D5)


def _unit(packed: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # keeps very large and very small vectors in range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(classes: DataFrame, n: int, cosine: float, recall: float, most: int) -> DataFrame:
    """Rows (a, b, n): links of class a counted (b null), or one link that joins a and b."""
    k, tables = parameters(n, cosine, recall)

    def deal(batches):
        made: dict[int, Hashes] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy().astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for dims in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dims)
                    packed = [flat[starts[r] : starts[r + 1]].tobytes() for r in rows]
                    keys = made.setdefault(int(dims), Hashes(int(dims), k, tables)).keys(_unit(packed))
                    who = np.repeat(np.arange(len(rows)), tables)
                    small = flat.astype(np.float32).astype(np.float64)
                    exact = [np.array_equal(small[starts[r] : starts[r + 1]], flat[starts[r] : starts[r + 1]]) for r in rows]
                    slim = [np.frombuffer(p).astype(np.float32).tobytes() if e else p for p, e in zip(packed, exact)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((keys + np.arange(tables, dtype=np.int64)[None] * 1000003 + int(dims)).ravel()),
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))),
                            pa.array(np.full(len(who), dims, np.int32)),
                            part.column(0).take(pa.array(rows[who])),
                            part.column(2).take(pa.array(rows[who])),
                            pa.array(slim, pa.binary()).take(pa.array(who)),
                        ],
                        names=["key", "t", "dims", "cid", "n", "v"],
                    )

    dealt = classes.select("cid", "v", "n").mapInArrow(deal, "key bigint, t int, dims int, cid bigint, n bigint, v binary")
    shards = split_hot(dealt, "key", "cid", most).select("shard", "side", "t", "dims", "cid", "n", "v")
    shards = shards.repartition("shard").sortWithinPartitions("shard", "t", "dims")

    def link(batches):
        made: dict[int, Hashes] = {}
        for rows, bounds in whole_groups(batches, ["shard", "t", "dims"]):
            cid, n, t, side, dims = (rows.column(c).to_numpy() for c in ("cid", "n", "t", "side", "dims"))
            packed = rows.column("v")
            counts: dict[int, int] = {}
            edges = []
            for g in np.flatnonzero(np.diff(bounds) > 1):
                lo, hi = int(bounds[g]), int(bounds[g + 1])
                d = int(dims[lo])
                raw = packed.slice(lo, hi - lo).to_pylist()
                unit = _unit([np.frombuffer(x, np.float32).astype(np.float64).tobytes() if len(x) == 4 * d else x for x in raw])
                s = side[lo:hi]
                left, right = (np.arange(hi - lo),) * 2 if s[0] == 0 else (np.flatnonzero(s == 1), np.flatnonzero(s == 2))
                forest, keys, total = Forest(hi - lo), None, np.zeros(hi - lo, np.int64)
                for at in range(0, len(left), 512):
                    part = left[at : at + 512]
                    i, j = np.nonzero(unit[part] @ unit[right].T >= cosine)
                    i, j = part[i], right[j]
                    if s[0] == 0:
                        i, j = i[i < j], j[i < j]
                    if not len(i):
                        continue
                    if keys is None:
                        keys = made.setdefault(d, Hashes(d, k, tables)).keys(unit)[:, : int(t[lo])]
                    first = np.concatenate([~(keys[i[x : x + 65536]] == keys[j[x : x + 65536]]).any(axis=1) for x in range(0, len(i), 65536)])
                    i, j = i[first], j[first]
                    np.add.at(total, i, n[lo + j])
                    np.add.at(total, j, n[lo + i])
                    forest.add(i, j)
                for x in np.flatnonzero(total):
                    counts[int(cid[lo + x])] = counts.get(int(cid[lo + x]), 0) + int(total[x])
                edges += [(int(cid[lo + x]), int(cid[lo + y])) for x, y in forest.pairs]
            a = list(counts) + [e[0] for e in edges]
            b = [None] * len(counts) + [e[1] for e in edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(counts.values()) + [0] * len(edges), pa.int64())], names=["a", "b", "n"])

    return shards.mapInArrow(link, "a bigint, b bigint, n bigint")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.995, most: int = 4096) -> DataFrame:
    """Id, n_links and component_id of every vector."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("_id"), v.alias("v"), usable.alias("_usable"))
    grouped = rows.filter("_usable").groupBy("v").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("cid"), "v", "n", "first"), "classes")
    found = materialize(_links(classes, classes.count(), cosine, recall, most), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("more"))
    parts = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    rooted = classes.join(parts, "cid", "left").join(counts, "cid", "left").withColumn("root", F.coalesce("component", "cid"))
    rooted = materialize(rooted.select("v", "n", "first", "root", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rooted")
    # one component or one vector may hold a third of all rows
    roots = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")), "roots")
    named = join_per_key(rooted, roots, "root").select("v", "n_links", "component_id", F.col("n").alias("_n"))
    named = materialize(named, "named")
    linked = join_per_key(rows.filter("_usable"), named, "v", most_broadcast=20_000).select(F.col("_id").alias(id_col), "n_links", "component_id")
    alone = rows.filter("not _usable").select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    return linked.unionByName(alone)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
