"""Language-model scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Vocabulary. Words are dealt to buckets by their hash; a bucket has an input vector, an output vector and a bias of its own. There are as
many buckets as a power of four needs to be near the number of different training words (`most_classes` squared at most), so
the net follows the vocabulary, up to a bound that keeps its weights small; up to there most words have vectors to themselves.
Within its bucket a word has its share of the bucket's count; a bucket keeps the
share of words seen once for words never seen, so the probabilities of all words,
one unseen word a bucket included, sum to 1. The end of a text is a word too.

Model. A context is the last SPAN words and the mean of all words before in the document. Its vector is
the sum of the buckets' input vectors, weighted by place. The probability of a bucket is that of its class times that inside the class, both
a softmax of products with output vectors plus biases: by batched matrix products over all classes, and over all buckets of a class
for the tokens of that class. Documents are encoded once as buckets.

Training contrasts each class with noise classes, and each bucket with noise buckets of its class. Every token of every training document
trains once: the blocks of about 16 000 tokens of a task are dealt to the `rounds` in turn. Tasks of a round start
from the same weights, draw noise of their own, and their results are averaged, weighted by tokens, in one aggregation.

Counts. All training tokens are counted exactly. The counts of the `known` most frequent words are broadcast, those of
all other words come by a join; a word's score is the same either way, so that bound changes no result.

Edge cases: null and empty texts are one end token; very long texts are scored whole, in blocks; without training documents all
counts are 0 and the base score is log10(0.5 / 0.5) a token; null ids are held out of training and
not reported as held_out; repeated rows each give a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_remainder, materialize, raw_bytes, slices, table

SPAN, DIMS = 4, 16
KNOWN = 200_000
#: The end of a text: no word holds a line feed.
END = b"\n"


def classes_for(kinds: int, least: int = 8, most: int = 64) -> int:
    """Classes, and buckets of a class, for so many different words: a power of two between the bounds."""
    return min(most, max(least, 1 << math.ceil(math.log2(max(kinds, 1)) / 2)))


def word_bucket(word: bytes, buckets: int) -> int:
    """Bucket of a word: XXH64 with seed 42, as Spark's xxhash64, modulo the buckets."""
    return xxhash.xxh64_intdigest(word, 42) % buckets


class Parameters:
    """Input vectors (one more for the start), place weights, and output vectors and biases of classes and buckets."""

    names = ("r", "c", "qc", "bc", "q", "b")

    def __init__(self, counts: np.ndarray, seed: int = 5):
        self.buckets, self.classes = len(counts), math.isqrt(len(counts))
        rng = np.random.default_rng(seed)
        # output vectors of zero: the untrained model is the table of counts
        self.r = rng.normal(0, 0.3, (self.buckets + 1, DIMS)).astype(np.float32)
        self.qc, self.q = np.zeros((self.classes, DIMS), np.float32), np.zeros((self.buckets, DIMS), np.float32)
        self.c = np.full((SPAN + 1, DIMS), 1.0 / (SPAN + 1), np.float32)
        share = (counts + 0.5).reshape(self.classes, -1)
        self.bc = np.log(share.sum(1) / share.sum()).astype(np.float32)
        self.b = np.log(share / share.sum(1, keepdims=True)).ravel().astype(np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([getattr(self, x).ravel() for x in self.names])

    def unpack(self, flat: np.ndarray) -> Parameters:
        for name in self.names:
            old = getattr(self, name)
            setattr(self, name, flat[: old.size].reshape(old.shape).astype(np.float32))
            flat = flat[old.size :]
        return self


class Contexts:
    """Contexts of the tokens of concatenated documents: the last SPAN tokens, and the mean input vector of all tokens before.

    `padded` holds the documents, each after SPAN start symbols; `at` is each token's place there.
    """

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, r: np.ndarray):
        sizes = np.diff(starts)
        self.at = np.arange(len(tokens)) + np.repeat(SPAN * np.arange(1, len(sizes) + 1), sizes)
        self.padded = np.full(len(tokens) + SPAN * len(sizes), len(r) - 1, np.int32)
        self.padded[self.at] = tokens
        upto = np.zeros((len(tokens) + 1, DIMS))
        np.cumsum(r.take(tokens, axis=0), axis=0, dtype=np.float64, out=upto[1:])
        mean = upto[:-1]
        mean -= np.repeat(upto[starts[:-1]], sizes, axis=0)
        mean /= np.maximum(np.arange(len(tokens)) - np.repeat(starts[:-1], sizes), 1)[:, None]
        self.mean = mean.astype(np.float32)

    def __call__(self, some: slice) -> tuple[list[np.ndarray], np.ndarray]:
        return [self.padded.take(self.at[some] - 1 - j) for j in range(SPAN)], self.mean[some]


def _hidden(p: Parameters, last: list[np.ndarray], mean: np.ndarray, weighted: list[np.ndarray]) -> np.ndarray:
    """Context vectors; `weighted` holds the input vectors times each place's weights."""
    h = mean * p.c[SPAN]
    for j in range(SPAN):
        h += weighted[j].take(last[j], axis=0)
    return h


def _sigmoid(z: np.ndarray) -> np.ndarray:
    np.clip(z, -30, 30, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.reciprocal(z, out=z)


class Trainer:
    """Noise-contrastive steps: noise classes shared by a batch, and for each class noise buckets shared by its tokens, drawn by their frequencies."""

    def __init__(self, p: Parameters, counts: np.ndarray, noise_classes: int = 32, noise_buckets: int = 8, rate: float = 0.12):
        self.p, self.noise_classes, self.noise_buckets, self.rate = p, noise_classes, noise_buckets, rate
        share = (counts + 0.5) / (counts + 0.5).sum()
        of_class = share.reshape(p.classes, -1).sum(1)
        self.width = p.buckets // p.classes
        self.draw = np.append(0.0, np.cumsum(share))
        self.draw_class = np.cumsum(of_class)
        self.log_class = np.log(noise_classes * of_class).astype(np.float32)
        self.log_bucket = np.log(noise_buckets * share / np.repeat(of_class, self.width)).astype(np.float32)
        self.seen = {k: np.full_like(getattr(p, k), 1e-3) for k in p.names}

    def step(self, contexts: Contexts, first: int, last: int, rng: np.random.Generator) -> None:
        """One step on the tokens first to last (exclusive), which follow each other: each input vector is fetched and moved once."""
        p, n = self.p, last - first
        low = contexts.at[first] - SPAN
        inputs = contexts.padded[low : contexts.at[last - 1] + 1]
        m = len(inputs) - SPAN
        target = inputs.take(contexts.at[first:last] - low)
        # in the order of buckets, and so of classes
        order = np.argsort(target.astype(np.uint16), kind="stable")
        place = (contexts.at[first:last] - low - SPAN).take(order)
        r = p.r.take(inputs, axis=0)
        near = r[SPAN - 1 : SPAN - 1 + m] * p.c[0]
        for j in range(1, SPAN):
            near += r[SPAN - 1 - j : SPAN - 1 - j + m] * p.c[j]
        mean = contexts.mean[first:last].take(order, axis=0)
        h = near.take(place, axis=0)
        h += mean * p.c[SPAN]
        target = target.take(order)
        kind = target // self.width
        # classes
        noise = np.minimum(np.searchsorted(self.draw_class, rng.random(self.noise_classes)), p.classes - 1)
        own, offset = p.qc.take(kind, axis=0), p.bc - self.log_class
        g_own = (_sigmoid(np.einsum("nd,nd->n", h, own) + offset.take(kind)) - 1) / n
        g_noise = _sigmoid(h @ p.qc[noise].T + offset[noise])
        g_noise /= n
        g_h = g_own[:, None] * own
        g_h += g_noise @ p.qc[noise]
        edges = np.flatnonzero(np.diff(kind, prepend=-1))
        classes = kind[edges]
        moves = [("qc", np.append(classes, noise), np.concatenate([np.add.reduceat(g_own[:, None] * h, edges, axis=0), g_noise.T @ h]))]
        moves.append(("bc", np.append(classes, noise), np.append(np.add.reduceat(g_own, edges), g_noise.sum(0))))
        # buckets inside the tokens' classes
        begins, after = self.draw[classes * self.width], self.draw[(classes + 1) * self.width]
        spots = begins[:, None] + rng.random((len(classes), self.noise_buckets)) * (after - begins)[:, None]
        other = np.clip(np.searchsorted(self.draw, spots, "right") - 1, (classes * self.width)[:, None], (classes * self.width + self.width - 1)[:, None])
        own, offset = p.q.take(target, axis=0), p.b - self.log_bucket
        g_own = (_sigmoid(np.einsum("nd,nd->n", h, own) + offset.take(target)) - 1) / n
        g_h += g_own[:, None] * own
        runs = np.flatnonzero(np.diff(target, prepend=-1))
        rows, biases = [np.add.reduceat(g_own[:, None] * h, runs, axis=0)], [np.add.reduceat(g_own, runs)]
        for a, b, q, z in zip(edges, np.append(edges[1:], n), p.q[other], offset[other]):
            g = _sigmoid(h[a:b] @ q.T + z)
            g /= n
            g_h[a:b] += g @ q
            rows.append(g.T @ h[a:b])
            biases.append(g.sum(0))
        where = np.append(target[runs], other.ravel())
        moves += [("q", where, np.concatenate(rows)), ("b", where, np.concatenate(biases))]
        # inputs
        g_place = np.zeros((m, DIMS), np.float32)
        g_place[place] = g_h
        g_in, c = np.zeros_like(r), np.empty_like(p.c)
        c[SPAN] = np.einsum("nd,nd->d", g_h, mean)
        for j in range(SPAN):
            s = slice(SPAN - 1 - j, SPAN - 1 - j + m)
            c[j] = np.einsum("nd,nd->d", g_place, r[s])
            g_in[s] += g_place * p.c[j]
        for name, at, g in [*moves, ("r", inputs, g_in), ("c", np.arange(SPAN + 1), c)]:
            self._move(name, at, g)

    def _move(self, name: str, at: np.ndarray, rows: np.ndarray) -> None:
        """An adaptive step of the rows that the batch touched."""
        order = np.argsort(at.astype(np.uint16), kind="stable")
        at = at.take(order)
        runs = np.flatnonzero(np.diff(at, prepend=-1))
        some, g = at[runs], np.add.reduceat(rows.take(order, axis=0), runs, axis=0)
        seen = self.seen[name].take(some, axis=0) + g * g
        self.seen[name][some] = seen
        getattr(self.p, name)[some] -= self.rate * g / np.sqrt(seen)


def _log_softmax(h: np.ndarray, q: np.ndarray, b: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log-probability of one column of each row of the products with all output vectors."""
    z = h @ q.T
    z += b
    if np.sqrt((h * h).sum(axis=1).max() * (q * q).sum(axis=1).max()) + np.abs(b).max() > 60:  # the exponentials could overflow
        z -= z.max(axis=1, keepdims=True)
    mine = z[np.arange(len(z)), own].astype(np.float64)
    np.exp(z, out=z)
    return mine - np.log((z @ np.ones(len(b), np.float32)).astype(np.float64))


def log_probabilities(p: Parameters, tokens: np.ndarray, starts: np.ndarray, rows: int = 4096) -> np.ndarray:
    """Normalised natural log-probability of each token's bucket, by batched products with the vectors of all classes and of all buckets of its class."""
    n = len(tokens)
    contexts, out = Contexts(tokens, starts, p.r), np.empty(n)
    width = p.buckets // p.classes
    kind = tokens // width
    h, weighted = np.empty((n, DIMS), np.float32), [p.r * p.c[j] for j in range(SPAN)]
    for at in range(0, n, rows):
        s = slice(at, min(at + rows, n))
        h[s] = _hidden(p, *contexts(s), weighted)
        out[s] = _log_softmax(h[s], p.qc, p.bc, kind[s])
    order = np.argsort(kind.astype(np.uint16), kind="stable")
    edges = np.searchsorted(kind[order], np.arange(p.classes + 1))
    for k in range(p.classes):
        q, b = p.q[k * width : (k + 1) * width], p.b[k * width : (k + 1) * width]
        for at in range(edges[k], edges[k + 1], rows):
            s = order[at : min(at + rows, edges[k + 1])]
            out[s] += _log_softmax(h.take(s, axis=0), q, b, tokens[s] - k * width)
    return out


def _token_blocks(symbols: list[bytes], most: int = 1 << 16):
    """(first, tokens, starts) of runs of encoded documents."""
    for first, last in slices([len(x) // 2 for x in symbols], most):
        tokens = np.frombuffer(b"".join(symbols[first:last]), np.uint16).astype(np.int32)
        yield first, tokens, np.concatenate([[0], np.cumsum([len(x) // 2 for x in symbols[first:last]])]).astype(np.int64)


def count_words(train: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all training words; ends are counted apart. Tasks combine their counts before the shuffle."""

    def count(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in raw_bytes(batch.column(0)):
                counts.update((text or b"").lower().split())
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return train.select(text_col).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(counts: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def train_model(train: DataFrame, counts: np.ndarray, rounds: int = 2, batch: int = 4096) -> Parameters:
    """Every token of the training documents (column symbols) trains once, in one of the rounds; each round averages the tasks' weights in one aggregation of a fixed number of rows."""
    p = Parameters(counts)
    size = len(p.pack())
    width = 256
    for turn in range(rounds):
        start = p.pack()

        def learn(batches, start=start, turn=turn):
            own, tokens_seen, block = Parameters(counts).unpack(start), 0, TaskContext.get().partitionId()
            trainer, rng = Trainer(own, counts), np.random.default_rng([17, turn, TaskContext.get().partitionId()])
            for rows in batches:
                for _, tokens, starts in _token_blocks(rows.column(0).to_pylist(), 1 << 14):
                    block += 1
                    if block % rounds != turn:
                        continue
                    contexts = Contexts(tokens, starts, own.r)
                    for at in range(0, len(tokens), batch):
                        trainer.step(contexts, at, min(at + batch, len(tokens)), rng)
                    tokens_seen += len(tokens)
            flat = np.concatenate([own.pack() * np.float32(tokens_seen), np.zeros(-size % width, np.float32)]).reshape(-1, width)
            if tokens_seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.full(len(flat), tokens_seen, np.int64)), pa.array(list(flat), pa.list_(pa.float32()))], names=["part", "n", "w"]
                )

        sums = [F.sum(F.get("w", F.lit(k)).cast("double")).alias(f"w{k}") for k in range(width)]
        learned = train.select("symbols").mapInArrow(learn, "part int, n bigint, w array<float>")
        got = materialize(learned.groupBy("part").agg(F.sum("n").alias("n"), *sums), "weights").toArrow()
        if not got.num_rows:
            continue
        order = np.argsort(got.column("part").to_numpy())
        flat = np.stack([got.column(f"w{k}").to_numpy()[order] for k in range(width)], axis=1) / got.column("n").to_numpy()[order][:, None]
        # rounded, so that the order of additions never shows
        p.unpack(np.round(flat, 7).ravel()[:size])
    return p


class Vocabulary:
    """The bounded table of frequent words: for each its bucket and what it adds to both scores."""

    def __init__(self, words: list[bytes], buckets: int, base: np.ndarray, share: np.ndarray):
        self.at = {w: k for k, w in enumerate(words)}
        # one more row for words that are not in the table
        self.bucket = np.array([*(word_bucket(w, buckets) for w in words), 0], dtype=np.int32)
        self.base, self.share, self.buckets = np.append(base, 0.0), np.append(share, 0.0), buckets


def _blocks(texts: list[bytes], vocabulary: Vocabulary, piece: int = 1 << 18):
    """For runs of documents: (first, words of each, all words, places in the table or -1, which words are not in it, buckets with ends, first token of each)."""
    get, end = vocabulary.at.get, word_bucket(END, vocabulary.buckets)
    for first, last in slices([len(t) for t in texts], piece):
        words = [t.split() for t in texts[first:last]]
        flat = list(chain.from_iterable(words))
        at = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
        bucket = vocabulary.bucket[at]
        out = np.flatnonzero(at < 0)
        bucket[out] = [word_bucket(flat[k], vocabulary.buckets) for k in out]
        starts = np.concatenate([[0], np.cumsum([len(ws) + 1 for ws in words])])
        tokens = np.full(starts[-1], end, np.int32)
        tokens[np.delete(np.arange(starts[-1]), starts[1:] - 1)] = bucket
        yield first, words, flat, at, out, tokens, starts


def bucket_shares(total: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the share of words never seen, by its tokens of words seen once, and the share of a seen word for each time it was seen."""
    unseen = np.where(total > 0, (once + 0.5) / (total + 1.0), 1.0)
    return unseen, np.where(total > 0, (1 - unseen) / np.maximum(total, 1.0), 0.0)


def score_documents(docs: DataFrame, is_train: Column, id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN, most_classes: int = 64) -> DataFrame:
    """Id, n_tokens, n_known, train_tokens, base_score and score of every document; those for which is_train holds are learned from."""
    spark = docs.sparkSession
    train = docs.filter(is_train)
    counts = materialize(count_words(train, text_col), "counts")
    ends = train.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)
    norm = n + 0.5 * (v + 1)
    buckets = classes_for(v, most=most_classes) ** 2
    of_word = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    # one row a bucket, of which there are at most most_classes squared
    stats = counts.groupBy(of_word("word").alias("bucket")).agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    total, once = np.zeros(buckets), np.zeros(buckets)
    for r in stats:
        total[r["bucket"]], once[r["bucket"]] = r["n"], r["once"]
    total[word_bucket(END, buckets)] += ends
    unseen, each = bucket_shares(total, once)
    frequent = counts.filter("n > 1").orderBy(F.desc("n"), "word").limit(known).toArrow()
    found = sorted(zip(frequent.column("n").to_pylist(), frequent.column("word").to_pylist()), key=lambda x: (-x[0], x[1]))
    words, c = [w for _, w in found], np.array([k for k, _ in found], dtype=np.float64)
    vocabulary = Vocabulary(words, buckets, np.log10((c + 0.5) / norm), np.zeros(len(words)))
    vocabulary.share[:-1] = np.log10(c * each[vocabulary.bucket[:-1]])
    shared = spark.sparkContext.broadcast(vocabulary)
    base_end = float(np.log10((ends + 0.5) / norm))
    share_end = float(np.log10(ends * each[word_bucket(END, buckets)])) if ends else 0.0
    cut = (found[-1][0], found[-1][1]) if found else (1 << 62, b"")
    # the rest of the words: everything after the last one of the table, in the order of counts and bytes
    rest = counts.filter((F.col("n") < cut[0]) | ((F.col("n") == cut[0]) & (F.col("word") > F.lit(bytearray(cut[1])))))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        voc = shared.value
        for batch in batches:
            texts = [(t or b"").lower() for t in raw_bytes(batch.column(3))]
            for first, words_of, flat, at, out, tokens, starts in _blocks(texts, voc):
                k = len(words_of)
                doc = np.repeat(np.arange(k), [len(w) for w in words_of])
                inside = at >= 0
                rare: list[dict[bytes, int]] = [{} for _ in words_of]
                for i in out.tolist():
                    d = rare[doc[i]]
                    d[flat[i]] = d.get(flat[i], 0) + 1
                data = tokens.astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(first, k) for c in range(3)],
                        pa.array(np.diff(starts)),
                        pa.array((np.bincount(doc[inside], minlength=k) + (ends > 0)).astype(np.int64)),
                        pa.array(base_end + np.bincount(doc, voc.base[at], k)),
                        pa.array(share_end + np.bincount(doc, voc.share[at], k)),
                        pa.array([data[2 * a : 2 * b] for a, b in zip(starts[:-1], starts[1:])], pa.binary()),
                        pa.array([list(d.items()) for d in rare], pa.map_(pa.binary(), pa.int64())),
                    ],
                    names=["_row", "_id", "train", "n_tokens", "seen", "base", "within", "symbols", "rare"],
                )

    schema = f"_row bigint, _id {id_type}, train boolean, n_tokens bigint, seen bigint, base double, within double, symbols binary, rare map<binary,bigint>"
    encoded = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.coalesce(is_train, F.lit(False)).alias("train"), text_col).mapInArrow(encode, schema)
    encoded = materialize(encoded, "encoded")
    p = spark.sparkContext.broadcast(train_model(encoded.filter("train"), total))

    def score(batches):
        for batch in batches:
            totals = [np.zeros(0)]
            for _, tokens, starts in _token_blocks(batch.column(0).to_pylist()):
                totals.append(np.add.reduceat(log_probabilities(p.value, tokens, starts), starts[:-1]) / np.log(10))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(1, batch.num_columns)], pa.array(np.concatenate(totals))], names=[*batch.schema.names[1:], "total"])

    kept = ["_row", "_id", "n_tokens", "seen", "base", "within"]
    scored = encoded.select("symbols", *kept).mapInArrow(score, f"_row bigint, _id {id_type}, n_tokens bigint, seen bigint, base double, within double, total double")
    # words outside the table: their counts come by a join, and what their bucket keeps for unseen words from a table of one row a bucket
    bucket_rows = spark.createDataFrame([(k, float(unseen[k]), float(each[k])) for k in range(buckets)], "bucket int, unseen double, each double")
    pairs = encoded.select("_row", F.explode("rare").alias("word", "tf"))
    pairs = pairs.join(rest.select("word", F.col("n").alias("c")), "word", "left").withColumn("bucket", of_word("word")).join(F.broadcast(bucket_rows), "bucket")
    c = F.coalesce("c", F.lit(0)).cast("double")
    added = pairs.groupBy("_row").agg(
        F.sum(F.col("tf") * F.log10((c + 0.5) / norm)).alias("base_more"),
        F.sum(F.col("tf") * F.log10(F.when(c > 0, c * F.col("each")).otherwise(F.col("unseen")))).alias("total_more"),
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("seen_more"),
    )
    both = scored.join(added, "_row", "left")
    more = lambda name: F.coalesce(name, F.lit(0))
    return both.select(
        F.col("_id").alias(id_col),
        "n_tokens",
        (F.col("seen") + more("seen_more")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + more("base_more")).alias("base_score"),
        (F.col("total") + F.col("within") + more("total_more")).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, id_remainder("doc_id", 5) != 1)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")
