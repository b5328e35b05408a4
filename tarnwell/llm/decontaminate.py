"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of `width` consecutive words (an item of fewer words is one
window) become a hash set. Each document's words are hashed once; the hashes of all its
windows are tested against the set, and what hits is verified word by word in a join
with the windows themselves. The set goes to the tasks as literals in parts of at most about `most_broadcast`
hashes, one part a pass over the documents, however large the benchmark is.

Edge cases: null texts and texts without a word have no words and no hits; null
item ids are not listed or counted, though their windows hit; items without words have no window; repeated
documents each give a row; very long texts are scanned whole; repeated items count once; empty tables give empty or clean
results; extra columns are ignored by scan_benchmark() and kept by drop_contaminated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, placed, table, unused

#: Between words: everything that is not a lower-case letter, a digit or non-ASCII, once A-Z are folded.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    found = F.split(F.translate(text, _UPPER, _LOWER), _BREAK)
    return F.coalesce(F.filter(found, lambda w: w != ""), F.array().cast("array<string>"))


def _windows(ws: Column, width: int) -> Column:
    """Start places (from 1) of all windows of that width."""
    return F.when(F.size(ws) >= width, F.sequence(F.lit(1), F.size(ws) - width + 1)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """item, width, hash and words of every window of the benchmark."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    sized = items.withColumn("width", F.least(F.size("ws"), F.lit(width)))
    dealt = sized.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - F.col("width") + 1), lambda i: F.slice("ws", i, F.col("width")))).alias("window"))
    return dealt.distinct().withColumn("hash", F.xxhash64(F.transform("window", lambda w: F.xxhash64(w))))


def _hits(hashes: Column, ws: Column, width: int, test) -> Column:
    """(start, width, hash, words) of the windows whose hash passes the test."""
    at = lambda i: F.xxhash64(F.slice(hashes, i, width))
    return F.transform(
        F.filter(_windows(ws, width), lambda i: test(at(i))),
        lambda i: F.struct(i.alias("start"), F.lit(width).alias("width"), at(i).alias("hash"), F.slice(ws, i, width).alias("window")),
    )


def _found(docs: DataFrame, windows: DataFrame, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """From _row, _id and _text: (_row, _id, n_words) of all documents, and (_row, start, width, hash, window) of the windows whose hash is known.

    The hashes go to the tasks in parts of at most about `most_broadcast`; each part is one pass over the
    documents that writes its hits, so what is sent at once is bounded and only hits are ever shuffled.
    """
    wanted = materialize(windows.select("width", "hash").distinct(), "hashes")
    parts = max(1, -(-wanted.count() // max(1, most_broadcast)))
    passes = []
    for k in range(parts):
        sets: dict[int, list[int]] = {}
        for r in wanted.filter(F.pmod("hash", F.lit(parts)) == k).collect():
            sets.setdefault(r["width"], []).append(r["hash"])

        def scan(ws: Column, hashes: Column, sets=sets) -> Column:
            found = [_hits(hashes, ws, w, lambda h, w=w: h.isin(sorted(sets[w]))) for w in sorted(sets)]
            hits = F.concat(*found) if found else F.array().cast("array<struct<start:int,width:int,hash:bigint,window:array<string>>>")
            return F.struct(F.size(ws).cast("long").alias("n_words"), hits.alias("hits"))

        # lambda variables hold the words and their hashes, so that no rewrite of the plan computes them again for each window
        once = lambda column, use: F.get(F.transform(F.array(column), use), F.lit(0))
        x = once(words(F.col("_text")), lambda ws: once(F.transform(ws, lambda w: F.xxhash64(w)), lambda hashes: scan(ws, hashes)))  # noqa: B023
        passes.append(materialize(docs.select("_row", "_id", x.alias("x")), "hits"))
    both = passes[0].select("_row", "x.hits")
    for more in passes[1:]:
        both = both.unionByName(more.select("_row", "x.hits"))
    return passes[0].select("_row", "_id", "x.n_words"), both.filter(F.size("hits") > 0).select("_row", F.inline("hits"))


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, most_broadcast: int = 200_000) -> DataFrame:
    """For each document: id, n_words, n_hit, items (sorted distinct ids of benchmark items found)."""
    found = _scan(docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), benchmark, item_col, item_text_col, width, most_broadcast)
    return found.select(F.col("_id").alias(id_col), "n_words", "n_hit", "items")


def _scan(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, width: int, most_broadcast: int) -> DataFrame:
    """_row, _id, n_words, n_hit and items of every document of _row, _id, _text; with several passes the rows' numbers must stay the same."""
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, width).withColumnRenamed("window", "wanted"), "windows")
    if windows.count() > most_broadcast:
        docs = materialize(docs, "rows")
    sizes, hits = _found(docs, windows, most_broadcast)
    same = (hits["hash"] == windows["hash"]) & (hits["width"] == windows["width"]) & (hits["window"] == windows["wanted"])
    # the words themselves decide
    verified = hits.join(windows, same).select("_row", "item", F.struct("start", (F.col("start") + hits["width"]).alias("stop")).alias("span"))
    grouped = verified.groupBy("_row").agg(F.collect_set("span").alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("to")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["to"], s["start"])).cast("long")).alias("n"),
            F.greatest(acc["to"], s["stop"]).alias("to"),
        ),
    )
    marked = grouped.select("_row", covered["n"].alias("n_hit"), "items")
    return sizes.join(marked, "_row", "left").select("_row", "_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", width: int = 10, most_broadcast: int = 200_000) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns; null and empty texts stay."""
    place = unused(docs, "_place")
    rows = placed(docs, place)
    items = benchmark.select(F.lit(0).alias("item_id"), F.col(item_text_col).alias("text"))
    found = _scan(rows.select(F.col(place).alias("_row"), F.lit(None).cast("long").alias("_id"), F.col(text_col).alias("_text")), items, "item_id", "text", width, most_broadcast)
    return rows.join(found.filter("n_hit > 0").select(F.col("_row").alias(place)), place, "left_anti").select(docs.columns)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark),
bw AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS k, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT r, i, k, item FROM dw JOIN bw USING (k, phrase)),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(places.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
