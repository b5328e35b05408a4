"""Document fingerprints that tell versions apart: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, a sentence or four words in a row of one, whichever is shortest; its digest is the XXH64 of its
bytes, mixed with how often it came before in the same text, so repeated paragraphs count. A sketch has three parts of cells;
a digest falls into one cell of each and adds 1 to its count, itself to the cell's key and a check of itself to the cell's check.
The sketches of two versions are subtracted cell by cell: what both hold is gone. A cell with a count of 1 or -1 whose check
fits its key holds one differing digest; taken out of its three cells it lays others bare, until all cells are zero. Where
peeling stops before that, the two are sketched again with four times the cells. All documents of a slice are peeled together.

The fingerprint is the smallest of these sketches as text, of one size whatever the document. Likeness is
the number of paragraphs in common over that of all in either version, from the counts and the recovered difference.

Edge cases: null and empty texts have no paragraphs and fingerprints of zeros; two of them are alike (1), one of them and
another text are not (0); whole texts are sketched, however long; equal texts have equal fingerprints and likeness 1; an empty table gives an
empty result; extra columns are ignored and their names never clash, as columns are picked and renamed first. Documents follow
each other by ascending id, null ids last, those of equal ids (repeated rows, ties) by text; the last one is followed by the first, a single one by itself.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import raw_bytes, slices, table

#: Cells of a fingerprint, and by how much a sketch grows where peeling fails.
CELLS, GROWTH = 24, 4

_SENTENCE = re.compile(rb"[^\n.!?]*(?:[\n.!?]+[\x20\x09-\x0D]*|\Z)")
_WORDS = re.compile(rb"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,4}|[\x20\x09-\x0D]+")


def paragraphs(text: bytes) -> list[bytes]:
    """The text in pieces that end with a line, a sentence or the fourth word; joined they are the text."""
    return [p for s in _SENTENCE.findall(text) if s for p in _WORDS.findall(s)]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer of unsigned numbers (multiply and shift)."""
    x = (x + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Digests:
    """Paragraph digests of texts, one text after the other; `start` holds where each text's begin."""

    def __init__(self, texts: list[bytes]):
        parts = [paragraphs(t) for t in texts]
        self.start = np.cumsum([0] + [len(p) for p in parts])
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for one in parts for p in one), np.uint64, self.start[-1])
        owner = np.repeat(np.arange(len(texts)), np.diff(self.start))
        order = np.lexsort((keys, owner))
        k, o = keys[order], owner[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        run = np.flatnonzero(new)
        nth = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
        again = nth > 0
        k[again] = _mix(k[again], 1) + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.keys = k

    def counts(self) -> np.ndarray:
        return np.diff(self.start)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The digests of some texts, and the place in `which` that each belongs to."""
        n = self.counts()[which]
        owner = np.repeat(np.arange(len(which)), n)
        return self.keys[np.arange(n.sum()) + np.repeat(self.start[which] - (np.cumsum(n) - n), n)], owner


class Sketches:
    """Invertible sketches of n documents: count, key and check of every cell, documents one after the other."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count, self.key, self.check = np.zeros(n * cells, np.int32), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)

    def places(self, keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The three cells of each digest, one in each third of its document's cells."""
        third = self.cells // 3
        return np.concatenate([owner * self.cells + k * third + (_mix(keys, self.cells + 7 * k + 2) % np.uint64(third)).astype(np.int64) for k in range(3)])

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        """Put digests in (sign 1) or take them out (-1); returns their cells."""
        at, sign = self.places(keys, owner), np.broadcast_to(np.asarray(sign), keys.shape)
        up = np.tile(sign > 0, 3)
        k, c = np.tile(keys, 3), np.tile(self.checks(keys), 3)
        np.add.at(self.count, at, np.where(up, 1, -1).astype(np.int32))
        np.add.at(self.key, at, np.where(up, k, np.uint64(0) - k))
        np.add.at(self.check, at, np.where(up, c, np.uint32(0) - c))
        return at

    @staticmethod
    def checks(keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, 5) >> np.uint64(32)).astype(np.uint32)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take all digests out that can be: their owners, keys and signs, and which documents came out whole."""
        found = []
        at = np.flatnonzero(self.count)
        while len(at):
            at = at[np.abs(self.count[at]) == 1]
            sign = self.count[at]
            keys = np.where(sign > 0, self.key[at], np.uint64(0) - self.key[at])
            check = np.where(sign > 0, self.check[at], np.uint32(0) - self.check[at])
            pure = self.checks(keys) == check
            at, sign, keys = at[pure], sign[pure], keys[pure]
            owner = at // self.cells
            # a digest may stand alone in more than one of its cells
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.ones(len(keys), dtype=bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            owner, keys, sign = owner[new], keys[new], sign[new]
            if not len(keys):
                break
            found.append((owner, keys, sign))
            at = np.unique(self.add(keys, owner, -sign))
        rest = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = ~rest.reshape(self.n, self.cells).any(axis=1)
        owner, keys, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
        return owner, keys, sign, whole

    def texts(self) -> list[str]:
        """The sketches as text: base64 of counts, keys and checks, least byte first."""
        c, k, x = (a.reshape(self.n, self.cells) for a in (self.count.astype("<i4"), self.key.astype("<u8"), self.check.astype("<u4")))
        return [base64.b64encode(c[i].tobytes() + k[i].tobytes() + x[i].tobytes()).decode() for i in range(self.n)]


def sketched(digests: Digests, which: np.ndarray, cells: int) -> Sketches:
    out = Sketches(len(which), cells)
    out.add(*digests.of(which))
    return out


def differences(a: Digests, b: Digests, first: tuple[Sketches, Sketches] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, digests and signs (1: only in a, -1: only in b) of what differs between a's and b's texts, pair by pair.

    `first` are sketches of CELLS cells, if there are some already.
    """
    open_, cells, found = np.arange(len(a.counts())), CELLS, []
    while len(open_):
        x, y = first if first and cells == CELLS else (sketched(a, open_, cells), sketched(b, open_, cells))
        owner, keys, sign, whole = x.minus(y).peel()
        keep = whole[owner]
        found.append((open_[owner[keep]], keys[keep], sign[keep]))
        open_, cells = open_[~whole], cells * GROWTH
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))


def likeness(a: Digests, b: Digests, owner: np.ndarray) -> np.ndarray:
    """Common over all paragraphs of each pair, by the owners of the differing ones."""
    total, apart = a.counts() + b.counts(), np.bincount(owner, minlength=len(a.counts()))
    return np.where(total > 0, (total - apart) / np.maximum(total + apart, 1), 1.0)


def compare_versions(df: DataFrame, text_col: str, others: list[str], keep: list[str], slice_bytes: int = 1 << 20) -> DataFrame:
    """The columns `keep`, the text's `fingerprint`, and of each other text its `fingerprint_<name>`, `likeness_<name>` and the digests
    that only the first (`gone_<name>`) or only the other version (`come_<name>`) has."""
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], "fingerprint string", *[f"`fingerprint_{o}` string, `likeness_{o}` double, `gone_{o}` array<bigint>, `come_{o}` array<bigint>" for o in others]])

    def lists(n, owner, keys):
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=n))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys[order].view(np.int64)))

    def work(batches):
        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            for k in range(1 + len(others)):
                sizes += np.diff(np.frombuffer(batch.column(k).cast(pa.large_binary()).buffers()[1], dtype=np.int64, offset=8 * batch.column(k).offset, count=batch.num_rows + 1)) if batch.num_rows else 0
            for i, j in slices(sizes.tolist(), slice_bytes):
                every = np.arange(j - i)
                own = Digests([t or b"" for t in raw_bytes(batch.column(0).slice(i, j - i))])
                mine = sketched(own, every, CELLS)
                columns = [c.slice(i, j - i) for c in batch.columns[1 + len(others) :]] + [pa.array(mine.texts())]
                for k in range(len(others)):
                    other = Digests([t or b"" for t in raw_bytes(batch.column(1 + k).slice(i, j - i))])
                    theirs = sketched(other, every, CELLS)
                    owner, keys, sign = differences(own, other, (mine, theirs))
                    columns += [pa.array(theirs.texts()), pa.array(likeness(own, other, owner)), lists(j - i, owner[sign > 0], keys[sign > 0]), lists(j - i, owner[sign < 0], keys[sign < 0])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "fingerprint", *[x.format(o) for o in others for x in ("fingerprint_{}", "likeness_{}", "gone_{}", "come_{}")]])

    return df.select(F.col(text_col).alias("_0"), *[F.col(o).alias(f"_{k + 1}") for k, o in enumerate(others)], *keep).mapInArrow(work, schema)


def _bucket(id_: Column, bounds: list[int], width: int = 128) -> Column:
    """How many of the sorted bounds are at or below the id, in two steps: among every 128th one, then in one block."""
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    block = F.size(F.filter(numbers(bounds[::width]), lambda x: x <= id_))
    inside = F.slice(numbers(bounds), F.greatest(block - 1, F.lit(0)) * width + 1, F.lit(width))
    return F.when(block == 0, 0).otherwise((block - 1) * width + F.size(F.filter(inside, lambda x: x <= id_)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_buckets: int = 20_000) -> DataFrame:
    """id, text and next_text of every document: the text of the one with the next larger id, of the last one the first.

    Ids (whole numbers) are cut at ids that exist into ranges, four a shuffle partition; a document at a cut goes to the range
    before it too, as the end of that. Each range is ordered on its own, so the texts are shuffled once and no task has more than its range.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = min(most_buckets, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("cuts"), F.min("id").alias("first")).first()
    bounds = sorted({int(x) for x in found["cuts"] or []} - {found["first"]})
    id_, last = F.col("id"), F.lit(len(bounds))
    own = F.when(id_.isNull(), last).otherwise(_bucket(id_, bounds)) if bounds else F.lit(0)
    at_cut = F.coalesce(F.get(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), own - 1) == id_, F.lit(False)) if bounds else F.lit(False)
    places = F.array(F.struct(own.cast("int").alias("bucket"), F.lit(0).alias("kind")), F.when(at_cut, F.struct((own - 1).cast("int").alias("bucket"), F.lit(1).alias("kind"))), F.when(id_.eqNullSafe(F.lit(found["first"])), F.struct(last.cast("int").alias("bucket"), F.lit(1).alias("kind"))))
    dealt = rows.withColumn("_at", F.explode(F.filter(places, lambda x: x.isNotNull()))).select("id", "text", "_at.bucket", "_at.kind")
    order = Window.partitionBy("bucket").orderBy("kind", F.col("id").asc_nulls_last(), "text")
    return dealt.withColumn("next_text", F.lead("text").over(order)).filter("kind = 0").select(F.col("id").alias(id_col), F.col("text").alias(text_col), "next_text")


def half_replaced(text: Column, other: Column) -> Column:
    """The text with its last half (rounded down, code points) replaced by the other text's first as many."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and how many paragraphs went and came by the edit."""
    docs = with_next(table(spark, sf_dir, "documents")).withColumn("edited", half_replaced(F.col("text"), F.col("next_text")))
    docs = docs.withColumns({"n_chars": F.char_length("text").cast("long"), "edited_sha256": F.sha2("edited", 256)})
    made = compare_versions(docs, "text", ["edited", "next_text"], ["doc_id", "n_chars", "edited_sha256"])
    return made.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("fingerprint_edited").alias("edited_fingerprint"), F.col("likeness_edited").alias("near_edited"),
        F.col("likeness_next_text").alias("near_next"), F.size("gone_edited").cast("long").alias("n_gone"), F.size("come_edited").cast("long").alias("n_come"),
    )
