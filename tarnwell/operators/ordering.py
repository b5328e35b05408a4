"""Order over whole tables without one task sorting them.

A table is cut into buckets at quantiles of the leading key. Windows run inside a
bucket; the buckets' totals, one row a bucket, give the offsets. The quantiles are
literals, so every evaluation cuts alike; equal keys share a bucket.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, key: Column, buckets: int, rows_a_bucket: int = 250_000, grid: int = 1024) -> DataFrame:
    """The rows with `_bucket`, the number of quantiles below the key: at least `buckets` of them, more for tables of more rows."""
    n, found = df.agg(F.count("*"), F.percentile_approx(key, [k / grid for k in range(1, grid)], 10_000)).first()
    buckets = max(buckets, min(grid, math.ceil(n / rows_a_bucket)))
    cuts = sorted({found[k * grid // buckets - 1] for k in range(1, buckets)}) if found else []
    return df.withColumn("_bucket", F.coalesce(_below(key, cuts), F.lit(0)) if cuts else F.lit(0))


def _below(key: Column, cuts: list[float], width: int = 32) -> Column:
    """How many of the sorted cuts are below the key: among every 32nd one first, then in one block."""
    if len(cuts) <= 2 * width:
        return sum(((key > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    array = lambda x: F.array(*[F.lit(float(c)) for c in x])
    block = F.size(F.filter(array(cuts[::width]), lambda c: c < key))
    inside = F.slice(array(cuts), F.greatest(block - 1, F.lit(0)) * width + 1, F.lit(width))
    return F.when(block == 0, 0).otherwise((block - 1) * width + F.size(F.filter(inside, lambda c: c < key)))


def as_number(df: DataFrame, key: str) -> Column:
    """A number that orders as the key does: numbers, dates and times as they are, strings by the six bytes that follow what all of them begin with."""
    kind = df.schema[key].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(key).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(key).cast("double")
    if kind == "string":
        # what the least and the greatest string begin with, all of them do
        ends = df.agg(F.hex(F.min(key)), F.hex(F.max(key))).first()
        shared = len(os.path.commonprefix([e or "" for e in ends])) // 2 * 2
        return F.conv(F.rpad(F.substring(F.hex(F.col(key)), shared + 1, 12), 12, "0"), 16, 10).cast("double")
    return F.col(key).cast("double")


def with_position(df: DataFrame, key: str, ties: tuple[str, ...] = (), descending: bool = False, name: str = "position", buckets: int = 64) -> DataFrame:
    """Row number over the whole table by key and ties, from 1; nulls come last. Ties end in a unique column."""
    number = as_number(df, key)
    parts = _bucketed(df, -number if descending else number, buckets).withColumn("_bucket", F.when(F.col(key).isNull(), F.lit(1 << 20)).otherwise(F.col("_bucket")))
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), *ties]
    sizes = parts.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_bucket", before.alias("_before"))
    ranked = parts.withColumn("_inside", F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)))
    # one row a bucket
    return ranked.join(F.broadcast(offsets), "_bucket").withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_before", "_inside")


def running(df: DataFrame, key: str, measures: list[str], by: tuple[str, ...] = (), descending: bool = False, buckets: int = 32, small: int = 100_000) -> DataFrame:
    """For a table with one row a key (and group): `before_<m>`, sums of each measure over all preceding keys, and `all_<m>`, its sums over the group.

    Groups of up to `small` rows are one window each; if one is larger, all are cut into buckets whose totals give the offsets.
    """
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()
    back = (Window.unboundedPreceding, -1)
    if by and (df.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0) <= small:
        whole = Window.partitionBy(*by)
        before = whole.orderBy(order).rowsBetween(*back)
        return df.withColumns({f"before_{m}": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures} | {f"all_{m}": F.sum(m).over(whole) for m in measures})
    number = as_number(df, key)
    parts = _bucketed(df, -number if descending else number, buckets)
    inner = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(*back)
    sums = parts.groupBy(*by, "_bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    # over one row a bucket
    whole = Window.partitionBy(*by)
    outer = whole.orderBy("_bucket").rowsBetween(*back)
    offsets = sums.select(*[F.col(b).alias(f"_k_{b}") for b in by], F.col("_bucket").alias("_b"), *[c for m in measures for c in (F.coalesce(F.sum(f"_t_{m}").over(outer), F.lit(0)).alias(f"_o_{m}"), F.sum(f"_t_{m}").over(whole).alias(f"all_{m}"))])
    same = F.col("_bucket") == F.col("_b")
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"_k_{b}"))
    out = parts.withColumns({f"_i_{m}": F.coalesce(F.sum(m).over(inner), F.lit(0)) for m in measures}).join(offsets, same)
    out = out.withColumns({f"before_{m}": F.col(f"_i_{m}") + F.col(f"_o_{m}") for m in measures})
    return out.drop("_bucket", "_b", *[f"_k_{b}" for b in by], *[f"_{x}_{m}" for m in measures for x in ("i", "o")])


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float], accuracy: int = 10_000) -> dict[str, list[float] | None]:
    """Exact quantiles (linear between neighbours) of each column as doubles, None for a column without values.

    Two passes: approximate quantiles give a narrow interval around each one, then the values below an interval are
    counted and only the distinct ones inside it, about 4 / accuracy of the rows, are ordered. An interval that misses is
    widened to the whole column. Up to `accuracy` rows are ordered as they are. Only the quantiles reach the driver.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    near = [min(1.0, max(0.0, q + side * 2 / accuracy)) for q in shares for side in (-1, 1)]
    first = df.agg(*[x for c, v in value.items() for x in (F.count(v).alias(f"n_{c}"), F.min(v).alias(f"a_{c}"), F.max(v).alias(f"b_{c}"), F.percentile_approx(v, near, accuracy).alias(f"q_{c}"))]).first()
    found: dict[tuple[str, int], float] = {}
    wide = {c for c in columns if first[f"n_{c}"] <= accuracy}
    while missing := [(c, k) for c in columns for k in range(len(shares)) if first[f"n_{c}"] and (c, k) not in found]:
        at = [shares[k] * (first[f"n_{c}"] - 1) for c, k in missing]
        ends = [(first[f"a_{c}"], first[f"b_{c}"]) if c in wide else tuple(first[f"q_{c}"][2 * k : 2 * k + 2]) for c, k in missing]
        # null stands for all values below the interval
        spots = [F.when(value[c] <= b, F.struct(F.lit(i).alias("i"), F.when(value[c] >= a, value[c]).alias("x"))) for i, ((c, _), (a, b)) in enumerate(zip(missing, ends))]
        counts = df.select(F.explode(F.array(*spots)).alias("s")).filter("s is not null").groupBy("s.i", "s.x").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first()))
        holds = lambda ranks: F.max(F.when((F.array(*[F.lit(r) for r in ranks])[F.col("i")] < F.col("upto")) & (F.array(*[F.lit(r) for r in ranks])[F.col("i")] >= F.col("upto") - F.col("n")), F.col("x")))
        got = counts.withColumn("upto", upto).groupBy("i").agg(holds([math.floor(r) for r in at]).alias("lo"), holds([math.ceil(r) for r in at]).alias("hi")).collect()
        for r in got:
            if r["lo"] is not None and r["hi"] is not None:
                found[missing[r["i"]]] = r["lo"] if r["lo"] == r["hi"] else r["lo"] + (r["hi"] - r["lo"]) * (at[r["i"]] % 1)
        wide = set(columns)
    return {c: [found[c, k] for k in range(len(shares))] if first[f"n_{c}"] else None for c in columns}


def capacity_bands(df: DataFrame, key: str, ties: tuple[str, ...], shares: tuple[float, ...] = (0.05, 0.10, 0.20), names: tuple[str, ...] = ("PRIORITY", "HIGH", "MEDIUM", "LOW")) -> DataFrame:
    """Bands by exact rank: the first ceil(share * N) rows of the descending key, and so on."""
    ranked = with_position(df, key, ties, descending=True, name="rank")
    n = df.agg(F.count("*").alias("_n"))
    out = ranked.join(F.broadcast(n))  # a single row
    band = F.lit(names[-1])
    for share, label in reversed(list(zip(shares, names))):
        band = F.when(F.col("rank") <= F.ceil(F.col("_n") * share), label).otherwise(band)
    return out.withColumn("band", band).drop("_n")
