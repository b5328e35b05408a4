"""SimHash near-duplicates, joined through BK-trees.

A text's fingerprint is the bitwise majority over the XXH64 of its word shingles.
Two fingerprints within `radius` bits agree on at least p of radius + p blocks of
bits, so equal bits of p blocks deal the distinct fingerprints into shards of about `members` and no link
is lost; p and the bits taken of a block follow from the number of fingerprints. Each shard gets a BK-tree (children keyed by their Hamming distance to the
parent, every fingerprint a node) and asks it for the neighbours of its members; a search follows only the edges that the triangle inequality leaves open.
Trees stay where their shard is: to broadcast them would take the fingerprints of all documents through the driver.
A shard gives just enough links to connect what it connects, never all pairs, and a
hot shard is cut into pairs of chunks. Components are found by star contraction.

Similarities such as 0.8 of five-word shingles differ in too many bits of 64 for blocks. For
these, fingerprints of `words` times 64 bits (the further words mix each shingle's hash) of the sets
of distinct shingles are dealt into shards by samples of their bits in several tables, whose numbers follow
from the number of fingerprints and the recall wanted for pairs exactly at the similarity; the radius
is the expected distance at the similarity plus three standard deviations. Fingerprints only propose:
inside each component of theirs the distinct shingle sets are compared exactly, and only pairs that
reach the similarity become links.

Edge cases: a null, empty or blank text has fingerprint 0 and links like any other;
a text of fewer words than a shingle is one shingle; very long texts are hashed piece by piece, whole; null ids are members but never
name a component (all null: null); repeated rows each give a row; an empty table
gives an empty result; extra columns are ignored, or kept by keep_one().
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, placed, raw_bytes, table, unused
from ._shards import Forest, connected_components, join_per_key, split_hot, whole_groups

_LANES = np.uint64(0x0101010101010101)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _digests(text: bytes, width: int, piece: int = 1 << 16):
    """The XXH64 of a text's word shingles, in pieces."""
    found = text.lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - width + 1)
    starts, stops = first[:n].tolist(), ends[len(found) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, piece):
        yield np.array([digest(joined[s:e], 42) for s, e in zip(starts[at : at + piece], stops[at : at + piece])], dtype=np.uint64)


def _majority(pieces, words: int) -> np.ndarray:
    """The bits that most of the hashes have, `words` times 64."""
    ones, n = np.zeros((words, 64), np.int64), 0
    for h in pieces:
        n += len(h)
        for k in range(words):
            g = h if k == 0 else _mix(h + np.uint64(k) * _STEP)
            g = np.concatenate([g, np.zeros(-len(g) % 255, np.uint64)]).reshape(-1, 255)
            for bit in range(8):  # eight counters of a byte each at once
                lanes = ((g >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
                ones[k, bit::8] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return ((2 * ones > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprint(text: bytes, width: int = 4, piece: int = 1 << 16) -> np.ndarray:
    """The SimHash of a text's word shingles."""
    return _majority(_digests(text, width, piece), 1)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_digests(text, width)]))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Id and fingerprint of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or b"", width) for t in raw_bytes(batch.column(1))]
            fp = pa.array([int(x) for x in np.concatenate(found).view(np.int64)] if found else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp bigint")


def set_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, piece: int = 1 << 16) -> DataFrame:
    """Id, fingerprint of the set of distinct shingles (binary) and digest of that set for every document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t or b"", width) for t in raw_bytes(batch.column(1))]
            fps = [_majority((x[at : at + piece] for at in range(0, len(x), piece)), words).tobytes() for x in sets]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary()), pa.array(digests, pa.binary())], names=[id_col, "fp", "set"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, fp binary, set binary")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of points, words last."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKTrees:
    """BK-trees over points of one or more 64-bit words, one tree a group, built and searched for many points at once.

    Every member is a node. A node's children are keyed by their distance to it, and all that hangs below a
    child has that distance too. `asked` counts the distances that searches computed.
    """

    def __init__(self, points: np.ndarray, members: np.ndarray, group: np.ndarray):
        """`group` (0 to groups - 1) of each member; members of a group are not empty."""
        self.points, self.fan, self.asked = points, 64 * points.shape[1] + 1, 0
        own = np.full(len(points), -1, np.int64)  # parent * fan + edge
        order = np.argsort(group, kind="stable")
        waiting, place, self.roots = members[order], group[order].astype(np.int64), None
        while self.roots is None or len(waiting):
            # of those that wait at a place the first becomes its node, the others move on to the child at their distance
            first = np.ones(len(waiting), bool)
            first[1:] = place[1:] != place[:-1]
            nodes = waiting[first]
            if self.roots is None:
                self.roots = nodes
            else:
                own[nodes] = place[first]
            at = nodes[np.cumsum(first) - 1][~first]
            waiting = waiting[~first]
            place = at * self.fan + _distance(points[waiting], points[at])
            order = np.argsort(place, kind="stable")
            waiting, place = waiting[order], place[order]
        self.kids = np.argsort(own, kind="stable")[np.count_nonzero(own < 0) :]
        self.keys = own[self.kids]

    def search(self, queries: np.ndarray, nodes: np.ndarray, radius: int, piece: int = 1 << 16):
        """Yields (queries, members) within the radius, in blocks, from the node given for each query downwards."""
        todo = [(queries[at : at + piece], nodes[at : at + piece]) for at in range(0, len(queries), piece)]
        while todo:
            q, node = todo.pop()
            away = _distance(self.points[q], self.points[node])
            self.asked += len(q)
            near = away <= radius
            if near.any():
                yield q[near], node[near]
            base = node * self.fan
            lo = np.searchsorted(self.keys, base + np.maximum(away - radius, 0))
            open_ = np.searchsorted(self.keys, base + np.minimum(away + radius, self.fan - 1), "right") - lo
            upto = np.cumsum(open_)
            start = 0
            while start < len(q):
                stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + piece, "right")))
                n = open_[start:stop]
                if n.any():
                    from_ = np.repeat(lo[start:stop] - (np.cumsum(n) - n), n)
                    todo.append((np.repeat(q[start:stop], n), self.kids[from_ + np.arange(n.sum())]))
                start = stop


def block_plan(n: int, radius: int, members: int = 1024) -> list[list[tuple[int, int]]]:
    """For each key its (first bit, bits) pieces: p whole or cut blocks of radius + p, so that n random fingerprints give shards of about `members`."""
    want = max(0, math.ceil(math.log2(max(n, 1) / members)))
    if not want:
        return [[]]
    p = next(p for p in range(1, 64 - radius) if p * (64 // (radius + p)) >= want or p == 8)
    size = 64 // (radius + p)
    bits = min(size, math.ceil(want / p))
    return [[(k * size, bits) for k in some] for some in combinations(range(radius + p), p)]


def _block_keys(fp: Column, plan: list[list[tuple[int, int]]]) -> Column:
    """One key for each entry of the plan; keys of different entries differ."""
    keys = []
    for k, pieces in enumerate(plan):
        parts = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for at, bits in pieces]
        keys.append(F.xxhash64(F.lit(k), *parts))
    return F.array(*keys)


def _link_shards(keyed: DataFrame, radius: int, words: int, most: int) -> DataFrame:
    """Links (a, b) between the fingerprints of a key that connect all within the radius of each other."""
    shards = split_hot(keyed, "key", "fp", most).select("shard", "side", "fp").repartition("shard").sortWithinPartitions("shard")
    kind = "bigint" if words == 1 else "binary"

    def link(batches):
        for rows, bounds in whole_groups(batches, ["shard"]):
            column = rows.column("fp")
            raw = column.to_numpy() if words == 1 else np.frombuffer(b"".join(column.to_pylist()), np.uint64)
            points, side = raw.view(np.uint64).reshape(-1, words), rows.column("side").to_numpy()
            sizes = np.diff(bounds)
            shard = np.repeat(np.arange(len(sizes)), sizes)
            # side 1 of a pair of chunks is the tree that side 2 asks
            held = np.flatnonzero((side != 2) & (sizes[shard] > 1))
            own, number = np.unique(shard[held], return_inverse=True)
            ask = np.flatnonzero((side != 1) & np.isin(shard, own))
            forest = Forest(len(points))
            if len(held) and len(ask):
                trees = BKTrees(points, held, number)
                roots = trees.roots[np.searchsorted(own, shard[ask])]
                for a, b in trees.search(ask, roots, radius):
                    once = (side[a] != 0) | (a < b)
                    forest.add(a[once], b[once])
            a, b = np.array(forest.pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([column.take(pa.array(x)).combine_chunks() for x in (a, b)], names=["a", "b"])

    return shards.mapInArrow(link, f"a {kind}, b {kind}")


def link_fingerprints(distinct: DataFrame, radius: int = 4, most: int = 8192) -> DataFrame:
    """Links (a, b) that connect all 64-bit fingerprints of column fp which lie within the radius of each other."""
    keyed = distinct.select("fp", F.explode(_block_keys(F.col("fp"), block_plan(distinct.count(), radius))).alias("key"))
    return _link_shards(keyed, radius, 1, most)


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two texts whose shingle sets have that Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@functools.cache
def most_differing_share(similarity: float, most: int = 40) -> float:
    """The largest expected share of differing bits at that Jaccard similarity or above: small sets have ties and differ more than large ones."""
    half = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    share = differing_share(similarity)
    for union in range(1, most + 1):
        apart = math.floor(union * (1 - similarity) + 1e-9)
        for a in range(apart + 1):
            b, c = apart - a, union - apart
            bit = lambda own, both: sum(p for k, p in enumerate(half(own)) if 2 * (both + k) > own + c)  # noqa: B023, E731
            ones = [(p, bit(a, both), bit(b, both)) for both, p in enumerate(half(c))]
            share = max(share, sum(p * (x + y - 2 * x * y) for p, x, y in ones))
    return share


def link_wide(distinct: DataFrame, similarity: float, words: int, recall: float = 0.99, most: int = 8192, seed: int = 3) -> DataFrame:
    """Links (a, b) between wide fingerprints of column fp (binary), by samples of bits in several tables: a connection of all that may be similar."""
    share, bits = most_differing_share(similarity), 64 * words
    n = distinct.count()
    width = max(8, math.ceil(math.log2(max(n, 2))) - 7)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** width))
    radius = math.floor(bits * share + 3 * math.sqrt(bits * share * (1 - share)))
    rng = np.random.default_rng(seed)
    places = np.stack([rng.choice(bits, width, replace=False) for _ in range(tables)])

    def deal(batches):
        for batch in batches:
            fps = batch.column(0)
            flat = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), -1)
            set_ = np.unpackbits(flat, axis=1, bitorder="little")
            keys = np.stack([(set_[:, p].astype(np.int64) << np.arange(width)).sum(axis=1) | (t << 40) for t, p in enumerate(places)], axis=1)
            yield pa.RecordBatch.from_arrays([fps.take(pa.array(np.repeat(np.arange(len(fps)), tables))), pa.array(keys.ravel())], names=["fp", "key"])

    return _link_shards(distinct.select("fp").mapInArrow(deal, "fp binary, key bigint"), radius, words, most)


def similar_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that connect all pairs whose Jaccard similarity reaches `similarity`, by exact intersections.

    Sets are of distinct values, ascending. Each one is compared with those that nothing has reached yet, so sets that are all alike take one pass.
    """
    order = np.array(sorted(range(len(sets)), key=lambda k: len(sets[k])))
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    sizes = np.array([len(sets[k]) for k in order])
    ends = np.cumsum(sizes)
    mark, free, links = np.zeros(int(codes.max(initial=-1)) + 1, np.uint8), np.ones(len(sets), bool), []
    # those compared with, smallest first: places, sizes, bounds of their codes
    ids, n, bounds, those = np.arange(len(sets)), sizes, np.concatenate([[0], ends]), codes
    for start in range(len(sets)):
        if not free[start] or not sizes[start]:
            continue
        free[start], todo = False, [start]
        while todo:
            x = todo.pop()
            if 2 * free[ids].sum() < len(ids):
                stay = free[ids]
                those, ids, n = those[np.repeat(stay, n)], ids[stay], n[stay]
                bounds = np.concatenate([[0], np.cumsum(n)])
            lo, hi = np.searchsorted(n, similarity * sizes[x] - 1e-6), np.searchsorted(n, sizes[x] / similarity + 1e-6, side="right")
            if lo == hi:
                continue
            own = codes[ends[x] - sizes[x] : ends[x]]
            mark[own] = 1
            shared = np.add.reduceat(mark[those[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], dtype=np.int64)
            mark[own] = 0
            near = ids[lo:hi][(shared * (1 + similarity) >= similarity * (sizes[x] + n[lo:hi]) - 1e-6) & free[ids[lo:hi]]]
            free[near] = False
            links += [(int(order[x]), int(order[y])) for y in near]
            todo += near.tolist()
    return links


def link_sets(members: DataFrame, similarity: float, width: int, most: int = 1 << 19) -> DataFrame:
    """Links (a, b) of the sets (columns set, root, text) of a root, verified on their shingles; a root of over `most` shingles is cut into pairs of chunks."""

    def hashes(batches):
        for batch in batches:
            grams = [shingle_set(t or b"", width).tobytes() for t in raw_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.binary())], names=["set", "root", "grams"])

    grams = materialize(members.select("set", "root", "text").mapInArrow(hashes, "set binary, root binary, grams binary"), "grams")
    shards = split_hot(grams, "root", "set", most, F.length("grams") / 8).select("shard", "set", "grams").repartition("shard").sortWithinPartitions("shard")

    def link(batches):
        for rows, bounds in whole_groups(batches, ["shard"]):
            names, grams, pairs = rows.column("set"), rows.column("grams"), []
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if last - first > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in grams.slice(first, last - first).to_pylist()]
                    pairs += [(first + a, first + b) for a, b in similar_sets(sets, similarity)]
            if pairs:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())).combine_chunks() for x in zip(*pairs)], names=["a", "b"])

    return shards.mapInArrow(link, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """Id, fp (fp_ if the id is named so) and component_id (the smallest id of the component) of every document; 64-bit fingerprints link within the radius."""
    found = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min(id_col).alias("first"), F.count("*").alias("_n")), "distinct")
    named = _named(distinct, "fp", link_fingerprints(distinct.select("fp"), radius))
    own = unused(docs.select(id_col), "fp")
    return join_per_key(found.select(F.col(id_col).alias("_id"), "fp"), named, "fp").select(F.col("_id").alias(id_col), F.col("fp").alias(own), "component_id")


def _named(distinct: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """Key, component_id (the smallest `first` of its component) and _n of the rows of `distinct`."""
    rooted = materialize(_rooted(distinct, key, links), "rooted")
    per_root = materialize(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n")), "roots")
    return materialize(join_per_key(rooted.select(key, "root", F.col("_n").alias("n")), per_root, "root").select(key, "component_id", F.col("n").alias("_n")), "named")


def _rooted(distinct: DataFrame, key: str, links: DataFrame) -> DataFrame:
    """The rows with `root`, the smallest key of the component."""
    parts = connected_components(links).withColumnRenamed("node", key)
    return distinct.join(parts, key, "left").select(*distinct.columns, F.coalesce("component", key).alias("root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, with all columns.

    A group is connected by pairs whose sets of shingles have at least that Jaccard similarity.
    Of repeated ids and of documents without an id one row each may stay; an empty table stays empty.
    """
    place = unused(docs, "_row")
    rows = placed(docs, place)
    # ids order rows, nulls last; the place tells repeated ids apart
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col(place).alias("row"))
    found = materialize(set_fingerprints(rows.select(order.alias("order"), F.col(text_col).alias("text")), "order", "text", width, words), "fingerprints")
    distinct = materialize(found.groupBy("set").agg(F.min("fp").alias("fp"), F.min("order").alias("first"), F.count("*").alias("_n")), "distinct")
    maybe = materialize(_rooted(distinct, "fp", link_wide(distinct.select("fp").distinct(), similarity, words)), "candidates")
    per_root = materialize(maybe.groupBy("root").agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("several", F.lit(True)), "roots")
    members = join_per_key(maybe.drop("_n"), per_root, "root").filter("several").select(F.col("first.row").alias("row"), "set", "root")
    texts = rows.select(F.col(place).alias("row"), F.col(text_col).alias("text"))
    links = link_sets(texts.join(members, "row"), similarity, width)
    named = _named(distinct, "set", links)
    others = join_per_key(found, named, "set").filter(F.col("order.row") != F.col("component_id.row")).select(F.col("order.row").alias(place))
    return rows.join(others, place, "left_anti").select(docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
