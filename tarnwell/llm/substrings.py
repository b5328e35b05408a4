"""Exact removal of long repeats by recompression.

Words get names that are the same in all documents. One round names short runs of an
equal word, further rounds name pairs of neighbouring symbols, where a symbol's own bits
say whether it may stand left or right, so that every decision depends on the symbols
alone and never makes a symbol of over four words. Names are made from the names of the parts, so equal
runs and pairs are named alike everywhere, without asking anybody.

Equal passages therefore get equal symbols but at their ends. What a passage is parsed to whatever stands
around it is found by peeling: in each round the symbol at an end goes if it may belong to a run or pair that reaches outside.
What is peeled, round by round, and the symbols that are left spell the passage, so their name is a name of the passage:
two windows are equal if and only if their spellings are. Of a window of 35 words at most 13 at each end
are peeled, so at least three whole symbols are left in its middle.

Spark then runs two global rounds. In the first one three neighbouring symbols, a high-level symbol, are looked for everywhere (every other one, by its name): those that occur once
prove that no window around them is repeated. In the second one the windows of which all high-level symbols
are shared meet by the names of their spellings (128 bits, made of 128-bit names of the words), and those that occur twice or more
are repeats. What is shared is joined back to the documents by a shuffle, so nothing is broadcast and no table has a fixed size.

Edge cases: null, empty and short texts (under a window) have nothing removed; very long texts are parsed whole; kept words
are joined by one space; repeated documents are repeats of each other; null ids stay null;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import forget, materialize, raw_bytes, slices, table

WINDOW = 35
#: Words that a symbol may hold, pair rounds, and symbols of a high-level symbol.
SYMBOL, ROUNDS, HIGH = 4, 3, 3
#: Most words that peeling takes from an end of a window: a short run, then in each round a symbol that still may grow.
LOSS = SYMBOL + ROUNDS * (SYMBOL - 1)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _C
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _name(left: np.ndarray, right: np.ndarray, kind: int) -> np.ndarray:
    return _mix(left * _A + _mix(right ^ np.uint64(kind)) * _B)


def word_names(words: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit names of the words: the halves of their 128-bit hashes."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T.copy()


class Parse:
    """The rounds of recompression over concatenated documents of word names (two rows); `ends` has each document's end.

    `rounds` holds, for each round, the symbols before it and what peeling needs: where a run begins and ends or which symbols may
    grow to the left or right, and which symbol of the next round holds each symbol. `top` has the last round's symbols, `at` where they begin.
    """

    def __init__(self, names: np.ndarray, ends: np.ndarray):
        n = names.shape[1]
        last = np.zeros(n, bool)
        last[ends[ends > 0] - 1] = True
        # runs of 2 to SYMBOL equal words
        new = np.ones(n, bool)
        new[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0) | last[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        one = np.where((size > 1) & (size <= SYMBOL), 1, size)  # symbols that the run gives
        at = np.repeat(first, one) + (np.arange(one.sum()) - np.repeat(np.cumsum(one) - one, one))
        long = np.repeat(np.where(one == size, 1, size), one)
        run = np.cumsum(new) - 1
        self.rounds = [(names, first[run], (first + size)[run], np.repeat(np.arange(len(at)), long))]
        sym = np.where(long > 1, _name(names[:, at], long.astype(np.uint64), 1), names[:, at])
        last = last[at + long - 1]
        for k in range(ROUNDS):
            right = (_mix(sym[0] + np.uint64(k + 101)) >> np.uint64(63)).astype(bool)
            grows = long < SYMBOL
            pair = np.flatnonzero(~right[:-1] & right[1:] & ~last[:-1] & (long[:-1] + long[1:] <= SYMBOL))
            keep = np.ones(len(at), bool)
            keep[pair + 1] = False
            self.rounds.append((sym, right & grows, ~right & grows, np.cumsum(keep) - 1))
            sym = sym.copy()
            sym[:, pair] = _name(sym[:, pair], sym[:, pair + 1], 2 + k)
            long[pair] += long[pair + 1]
            last[pair] = last[pair + 1]
            sym, at, long, last = sym[:, keep], at[keep], long[keep], last[keep]
        self.top, self.at, self.last = sym, at, last

    def high_symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """(keys, whether one is looked for) for each top symbol: it and the next ones, inside one document.

        Every other one by its key is looked for; a window whose middle holds none of these stays a candidate.
        """
        m = len(self.at)
        whole = np.ones(m, bool)
        key = self.top[0]
        for k in range(1, HIGH):
            whole[m - k :] = False
            whole[: m - k] &= ~self.last[k - 1 : m - 1]
            key = _name(key, np.append(self.top[0][k:], np.zeros(min(k, m), np.uint64)), 50 + k)
        return key, whole & (key & np.uint64(1) == 0)

    def peel(self, starts: np.ndarray, width: int, name: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """First and end of the top symbols in the middle of the windows, and the names of what they are spelled by, if asked for."""
        a, b = starts.astype(np.int64), starts.astype(np.int64) + width
        spelled = np.zeros((2, len(a)), np.uint64) if name else None

        def spell(who: np.ndarray, symbols: np.ndarray, kind: int) -> None:
            if name and len(who):
                spelled[:, who] = _name(spelled[:, who], symbols, kind)

        names, begin, end, to = self.rounds[0]
        some = np.minimum(end[a], b) - a
        short = np.flatnonzero(some <= SYMBOL)
        spell(short, _name(names[:, a[short]], some[short].astype(np.uint64), 60), 61)
        a[short] += some[short]
        open_ = np.flatnonzero(a < b)
        some = b[open_] - np.maximum(begin[b[open_] - 1], a[open_])
        short = open_[some <= SYMBOL]
        some = some[some <= SYMBOL]
        spell(short, _name(names[:, b[short] - 1], some.astype(np.uint64), 62), 63)
        b[short] -= some
        a, b = self._up(a, b, to)
        for k, (sym, from_left, to_right, to) in enumerate(self.rounds[1:]):
            who = np.flatnonzero(a < b)
            who = who[from_left[a[who]]]
            spell(who, sym[:, a[who]], 70 + 2 * k)
            a[who] += 1
            who = np.flatnonzero(a < b)
            who = who[to_right[b[who] - 1]]
            spell(who, sym[:, b[who] - 1], 71 + 2 * k)
            b[who] -= 1
            a, b = self._up(a, b, to)
        if name:
            at, who = a.copy(), np.flatnonzero(a < b)
            while len(who):
                spell(who, self.top[:, at[who]], 90)
                at[who] += 1
                who = who[at[who] < b[who]]
        return a, b, spelled

    @staticmethod
    def _up(a: np.ndarray, b: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same middles in the symbols of the next round."""
        some = a < b
        first = np.where(some, to[np.minimum(a, len(to) - 1)], 0)
        return first, np.where(some, to[np.maximum(b, 1) - 1] + 1, first)

    def candidates(self, starts: np.ndarray, width: int, shared: np.ndarray) -> np.ndarray:
        """Those windows that hold no high-level symbol in their middle that is not shared."""
        unique = np.concatenate([[0], np.cumsum(~shared)])
        # what no peeling reaches is looked at first
        n = self.rounds[0][0].shape[1]
        owner = np.repeat(np.arange(len(self.at)), np.diff(np.append(self.at, n)))
        a = owner[starts + LOSS]
        a += self.at[a] < starts + LOSS
        starts = starts[unique[np.maximum(owner[starts + width - LOSS] - HIGH + 1, a)] == unique[a]]
        a, b, _ = self.peel(starts, width)
        return starts[unique[np.maximum(b - HIGH + 1, a)] == unique[a]]


def _starts(ends: np.ndarray, width: int) -> np.ndarray:
    """Where windows begin in concatenated documents that hold at least one each."""
    begin = np.append(0, ends[:-1])
    n = ends - begin - width + 1
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _blocks(texts: list[bytes | None], width: int, piece: int = 1 << 20):
    """(first document, all documents' words, numbers of those parsed, their ends and parse or None) for runs of documents."""
    for first, last in slices([len(t or b"") for t in texts], piece):
        words = [(t or b"").split() for t in texts[first:last]]
        held = [k for k, w in enumerate(words) if len(w) >= width]
        flat = [x for k in held for x in words[k]]
        ends = np.cumsum([len(words[k]) for k in held], dtype=np.int64)
        yield first, words, held, ends, Parse(word_names(flat), ends) if held else None


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have an equal one, which rows are the first of equal ones)."""
    n = len(keys[0])
    order = np.lexsort(keys)
    same = np.ones(max(0, n - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    twice, head = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        twice[order] = np.append(False, same) | np.append(same, False)
        head[order] = ~np.append(False, same)
    return twice, head


def _shared_symbols(docs: DataFrame, width: int) -> DataFrame:
    """_row and the numbers (list) of its high-level symbols that occur elsewhere too.

    What a batch holds twice is decided there, and one witness of it goes to the others: frequent symbols are pre-aggregated.
    """

    def keys(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            found, row, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for first, _, held, ends, parse in _blocks(raw_bytes(batch.column(1)), width):
                if parse is None:
                    continue
                key, whole = parse.high_symbols()
                doc = np.searchsorted(ends, parse.at, "right")
                number = np.arange(len(parse.at)) - np.searchsorted(parse.at, np.append(0, ends[:-1]))[doc]
                found.append(key[whole])
                row.append(rows[first + np.array(held)[doc[whole]]])
                place.append(number[whole].astype(np.int32))
            key, row, place = np.concatenate(found), np.concatenate(row), np.concatenate(place)
            twice, head = _groups(key)
            told = np.flatnonzero(twice & head)
            # decided rows only pass by, spread evenly
            spread = np.where(twice, _mix(row.view(np.uint64) * _A + place.astype(np.uint64)), key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([spread, key[told]]).view(np.int64)),
                    pa.array(np.concatenate([row, row[told]]), mask=np.concatenate([np.zeros(len(row), bool), np.ones(len(told), bool)])),
                    pa.array(np.concatenate([place, place[told]])),
                    pa.array(np.concatenate([twice, np.zeros(len(told), bool)])),
                ],
                names=["key", "_row", "place", "sure"],
            )

    found = docs.select("_row", "text").mapInArrow(keys, "key bigint, _row bigint, place int, sure boolean")
    beside = Window.partitionBy("key", "sure").orderBy("_row")
    other = F.coalesce(F.lag("place").over(beside), F.lead("place").over(beside)).isNotNull()
    shared = found.withColumn("other", other).filter("(sure or other) and _row is not null")
    return shared.groupBy("_row").agg(F.collect_list("place").alias("shared"))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """For each document: id, n_words, n_removed, kept_sha256, and kept_text where words were removed (else null)."""
    if width - 2 * LOSS < SYMBOL * (HIGH - 1) + 1:
        raise ValueError(f"a window needs {2 * LOSS + SYMBOL * (HIGH - 1) + 1} words or more")
    id_type = docs.schema[id_col].dataType.simpleString()
    # written out, as both global rounds read the documents and their numbers must agree
    placed = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text")), "texts")
    shared = materialize(_shared_symbols(placed, width), "shared")

    def windows(batches):
        for batch in batches:
            texts, known = raw_bytes(batch.column(2)), batch.column(3)
            n_words, sha, text = [], [], [None] * len(texts)
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for first, words, held, ends, parse in _blocks(texts, width):
                n_words += [len(w) for w in words]
                sha += [_sha(w) for w in words]
                if parse is None:
                    continue
                # symbols that are not looked for tell nothing
                is_shared = ~parse.high_symbols()[1]
                for k, at in zip(held, np.searchsorted(parse.at, np.append(0, ends[:-1]))):
                    if known[first + k].is_valid:
                        is_shared[at + known[first + k].values.to_numpy()] = True
                start = _starts(ends, width)
                start = parse.candidates(start, width, is_shared)
                spelled = parse.peel(start, width, name=True)[2]
                doc = np.searchsorted(ends, start, "right")
                for k in np.unique(doc):
                    text[first + held[k]] = b" ".join(words[held[k]])
                for into, x in zip(found, (np.array(held)[doc] + first, start - np.append(0, ends)[doc], spelled[0], spelled[1])):
                    into.append(x)
            doc, start, high, low = (np.concatenate(x) for x in found)
            # a window twice in the batch is decided here; one witness of it goes to the others
            twice, head = _groups(low, high)
            seen = twice & head
            listed = lambda mask, x, kind: pa.ListArray.from_arrays(np.searchsorted(doc[mask], np.arange(len(texts) + 1)).astype(np.int32), pa.array(x[mask], kind))
            witness = lambda x, kind: pa.ListArray.from_arrays(np.array([0] + [seen.sum()] * len(texts), np.int32), pa.array(x[seen], kind))
            h, g = high.view(np.int64), low.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n_words, pa.int64()),
                    pa.array(sha),
                    pa.array(text, pa.binary()),
                    listed(twice, start.astype(np.int32), pa.int32()),
                    listed(~twice, start.astype(np.int32), pa.int32()),
                    listed(~twice, h, pa.int64()),
                    listed(~twice, g, pa.int64()),
                    witness(h, pa.int64()),
                    witness(g, pa.int64()),
                ],
                names=["_row", "_id", "n_words", "sha", "words", "sure", "start", "high", "low", "w_high", "w_low"],
            )

    schema = f"_row bigint, _id {id_type}, n_words bigint, sha string, words binary, sure array<int>, start array<int>, high array<bigint>, low array<bigint>, w_high array<bigint>, w_low array<bigint>"
    rows = materialize(placed.join(shared, "_row", "left").select("_row", "_id", "text", "shared").mapInArrow(windows, schema), "windows")
    for done in (shared, placed):
        forget(done)
    open_ = rows.filter(F.size("start") > 0).select("_row", F.explode(F.arrays_zip("start", "high", "low")).alias("w")).select("_row", "w.start", "w.high", "w.low")
    told = rows.filter(F.size("w_high") > 0).select(F.explode(F.arrays_zip("w_high", "w_low")).alias("w"))
    told = told.select(F.lit(None).cast("bigint").alias("_row"), F.lit(None).cast("int").alias("start"), F.col("w.w_high").alias("high"), F.col("w.w_low").alias("low"))
    # equal windows are neighbours in the order of their names, so one shuffle both counts and places them
    beside = Window.partitionBy("high").orderBy("low")
    again = F.coalesce(F.lag("low").over(beside) == F.col("low"), F.lit(False)) | F.coalesce(F.lead("low").over(beside) == F.col("low"), F.lit(False))
    marks = open_.unionByName(told).withColumn("again", again).filter("again and _row is not null").groupBy("_row").agg(F.collect_list("start").alias("more"))
    marks = materialize(marks, "marks")

    def cut(batches):
        for batch in batches:
            removed, kept = [], []
            for text, sure, more in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                words = text.split()
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.concatenate([x.values.to_numpy() for x in (sure, more) if x.is_valid])
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append([w for w, g in zip(words, gone) if not g])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array([_sha(w) for w in kept]), pa.array([b" ".join(w) for w in kept], pa.binary()).cast(pa.string())],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    held = rows.filter("words is not null").select("_row", "_id", "n_words", "sha", "words", "sure").join(marks, "_row", "left")
    hit = held.filter("more is not null or size(sure) > 0").select("_id", "n_words", "words", "sure", "more")
    cleaned = hit.mapInArrow(cut, f"`{id_col}` {id_type}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    same = lambda df: df.select(F.col("_id").alias(id_col), "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept_text"))
    return cleaned.unionByName(same(held.filter("more is null and size(sure) = 0"))).unionByName(same(rows.filter("words is null")))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
