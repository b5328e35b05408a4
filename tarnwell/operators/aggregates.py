"""Grouped statistics: deterministic modes, shrinkage, intervals, cells, profiles of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exact_quantiles
from .quantiles import grouped_quantiles


def mode(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value of each group; the smallest one on ties."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best["v"].alias(name), (-best["n"]).alias(f"{name}_count"))


def first_mode(df: DataFrame, by: list[str], value: str, *order: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value of each group; on ties the one that comes first in the order, then the smallest."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("at"), F.col(value).alias("v")))
    return counts.groupBy(*by).agg(best["v"].alias(name), (-best["n"]).alias(f"{name}_count"))


def rate(condition: Column) -> Column:
    """Share of rows for which a condition holds; nulls count as no."""
    return F.avg(F.coalesce(condition.cast("double"), F.lit(0.0)))


def any_of(condition: Column) -> Column:
    return F.bool_or(F.coalesce(condition, F.lit(False)))


def shrunk_rate(hits: Column, n: Column, prior: Column | float, strength: float = 20.0) -> Column:
    """Empirical-Bayes rate: (k + m p) / (n + m)."""
    p = prior if isinstance(prior, Column) else F.lit(float(prior))
    return (hits + F.lit(strength) * p) / (n + F.lit(strength))


def wilson(hits: Column, n: Column, z: float = 1.96, clip: bool = False) -> tuple[Column, Column]:
    """Lower and upper Wilson bounds; null for no rows."""
    p = F.try_divide(hits.cast("double"), n)
    base = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / base
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / base
    lo, hi = centre - half, centre + half
    return (F.greatest(F.lit(0.0), lo), F.least(F.lit(1.0), hi)) if clip else (lo, hi)


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Adjusted p-values: least p m / i over this and all larger p. For tables of tests, one row each."""
    m = F.count(p).over(Window.partitionBy())
    i = F.rank().over(Window.orderBy(F.col(p).asc_nulls_last())) + F.count(p).over(Window.partitionBy(p)) - 1
    ranked = df.withColumn("_raw", F.col(p) * m / i)
    back = Window.orderBy(F.col(p).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(back))).drop("_raw")


def cells(df: DataFrame, dims: list[str], hit: Column, sizes: tuple[int, ...] = (2, 3), least: int = 50, strength: float = 20.0) -> DataFrame:
    """All 2- and 3-way cells with at least `least` rows: n, hits, shrunk rate, lift and Wilson bounds."""
    sets = [c for k in sizes for c in combinations(dims, k)]
    flagged = df.withColumn("_hit", F.coalesce(hit.cast("int"), F.lit(0)))
    grouped = flagged.groupingSets([[F.col(x) for x in c] for c in sets], *dims).agg(F.count("*").alias("n"), F.sum("_hit").alias("hits"), F.grouping_id().alias("_set"))
    overall = flagged.agg(F.avg("_hit").alias("_p"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    kept = grouped.filter(F.col("n") >= least).join(F.broadcast(overall))  # a single row
    label = F.concat_ws(" x ", *[F.when(F.bitwise_not(F.col("_set")).bitwiseAND(1 << (len(dims) - 1 - k)) != 0, F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit("nan")))) for k, d in enumerate(dims)])
    return kept.select(label.alias("cell"), "n", "hits", shrunk_rate(F.col("hits"), F.col("n"), F.col("_p"), strength).alias("rate"), F.try_divide(F.col("hits") / F.col("n"), F.col("_p")).alias("lift"), lo.alias("low"), hi.alias("high"))


def crosstab(df: DataFrame, row: str, column: str, values: list, share: bool = True) -> DataFrame:
    """Counts, or shares of the row, of each value; a row's nulls are in its total."""
    out = df.groupBy(row).agg(F.count("*").alias("n"), *[F.count_if(F.col(column) == v).alias(f"v_{v}") for v in values])
    return out.select(row, "n", *[(F.col(f"v_{v}") / F.col("n")).alias(f"share_{v}") for v in values]) if share else out


def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of a cube; margins carry the label All."""
    cube = df.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(column).alias("_c"))
    return cube.select(F.when(F.col("_r") == 1, "All").otherwise(F.col(row)).alias(row), F.when(F.col("_c") == 1, "All").otherwise(F.col(column)).alias(column), "n")


def rollup_total(df: DataFrame, by: str, aggregates: list[Column], total: str = "TOTAL") -> DataFrame:
    """Groups and one row for all."""
    out = df.rollup(by).agg(*aggregates, F.grouping(by).alias("_g"))
    return out.withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by).cast("string"))).drop("_g")


def quantile_nearest(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The value, as a double, at the index nearest to q (n - 1) of a group's sorted values; halves round up."""
    return grouped_quantiles(df, by, value, {name: q}, rule="nearest").drop("n")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_missing, mean, quartiles and 1.5-IQR outliers, over all columns at once."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    unknown = [None] * 3
    quartiles = {c: q or unknown for c, q in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).items()}
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v).cast("double") for v in x]) for c, q in quartiles.items() for x in (c, q)])
    q = [known[F.col("column")][k] for k in range(3)]
    iqr = q[2] - q[0]
    outlier = (F.col("value") < q[0] - 1.5 * iqr) | (F.col("value") > q[2] + 1.5 * iqr)
    stats = long.groupBy("column").agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.avg("value").alias("mean"), F.count_if(outlier).alias("n_outliers"))
    return stats.select("column", "n", "n_missing", "mean", q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), "n_outliers")


def missingness(df: DataFrame) -> DataFrame:
    """column, n_missing, n_distinct of every column, in one pass."""
    flat = df.agg(*[x for c in df.columns for x in (F.count_if(F.col(c).isNull()).alias(f"m_{c}"), F.count_distinct(F.col(c)).alias(f"d_{c}"))])
    return flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("n_missing"), F.col(f"d_{c}").alias("n_distinct")) for c in df.columns])).alias("x")).select("x.*")


def share_entropy(shares: list[str]) -> tuple[Column, Column]:
    """Normalised entropy of share columns, and the name of the largest (the first on ties)."""
    values = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in shares])
    entropy = F.aggregate(values, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    top = F.element_at(F.array(*[F.lit(c) for c in shares]), F.array_position(values, F.array_max(values)).cast("int"))
    return entropy / F.log(F.lit(float(max(2, len(shares))))), top


def balanced_weights(df: DataFrame, stage: str, entity: str) -> DataFrame:
    """1/n of the rows of an entity in a stage, scaled so that stages weigh alike and the mean is 1."""
    raw = 1.0 / F.count("*").over(Window.partitionBy(stage, entity))
    out = df.withColumn("_w", raw).withColumn("_w", F.col("_w") / F.sum("_w").over(Window.partitionBy(stage)))
    mean = df.sparkSession.range(1).join(out.agg(F.avg("_w").alias("_m")))
    return out.join(F.broadcast(mean.select("_m"))).withColumn("weight", F.col("_w") / F.col("_m")).drop("_w", "_m")  # a single row


def ordered_list(df: DataFrame, by: list[str], value: str, order: str, name: str, most: int) -> DataFrame:
    """The first `most` values of each group in order, as one array."""
    top = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(order, value))).filter(F.col("_n") <= most)
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias(name))


def banded_rate(df: DataFrame, value: str, edges: list[float], hit: Column) -> DataFrame:
    """n and rate by right-closed bands (-inf, e1], (e1, e2], ...; nulls make the band "missing"."""
    band = F.when(F.col(value).isNull(), "missing")
    for k, e in enumerate(edges):
        band = band.when(F.col(value) <= e, f"{k}:<={e:g}")
    return df.groupBy(band.otherwise(f"{len(edges)}:>{edges[-1]:g}").alias("band")).agg(F.count("*").alias("n"), rate(hit).alias("rate"))


def profile_signals(df: DataFrame, group: str, categorical: list[str], numeric: list[str], most: int = 5) -> DataFrame:
    """Per group its strongest signals: modal share against overall (points) and median shift (in IQRs); no signal of a column without a value in the group."""
    long_c = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("value")) for c in categorical])).alias("x")).select(group, "x.*")
    in_group = long_c.groupBy(group, "column", "value").agg(F.count("*").alias("n"))
    totals = in_group.groupBy(group, "column").agg(F.sum("n").alias("t"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("m"))
    overall = in_group.groupBy("column", F.col("value").alias("v")).agg(F.sum("n").alias("on"))
    whole = overall.groupBy(F.col("column").alias("oc")).agg(F.sum("on").alias("ot"))
    modal = totals.select(group, "column", F.col("m.value").alias("v"), (-F.col("m.n") / F.col("t")).alias("share")).join(overall, ["column", "v"]).join(whole, F.col("column") == F.col("oc"))
    cats = modal.select(group, F.concat_ws("=", "column", "v").alias("signal"), (F.col("share") - F.col("on") / F.col("ot")).alias("strength"))
    long_n = df.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric])).alias("y")).select(group, "y.*")
    quartiles = exact_quantiles(df, numeric, [0.25, 0.5, 0.75])
    base = df.sparkSession.createDataFrame([(c, q) for c, q in quartiles.items()], "bc string, q array<double>")
    nums = grouped_quantiles(long_n, [group, "column"], "x", {"med": 0.5}).join(F.broadcast(base), F.col("column") == F.col("bc"))  # one row a column
    nums = nums.select(group, F.col("column").alias("signal"), F.try_divide(F.col("med") - F.col("q")[1], F.col("q")[2] - F.col("q")[0]).alias("strength"))
    ranked = cats.unionByName(nums).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.abs("strength").desc_nulls_last(), "signal")))
    return ranked.filter(F.col("rank") <= most)


def residual_synergy(df: DataFrame, by: list[str], target: str, p: str, prior: float = 20.0, z: float = 1.96) -> DataFrame:
    """Per group: rate, rate shrunk to the overall one, lift, mean model probability, their difference, and Wilson bounds of the rate."""
    overall = df.agg(F.avg(F.col(target).cast("double")).alias("_base"))
    per = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("k"), F.avg(p).alias("expected"))
    per = per.join(F.broadcast(overall))  # a single row
    n, rate = F.col("n").cast("double"), F.col("k") / F.col("n")
    smooth = (F.col("k") + prior * F.col("_base")) / (n + prior)
    centre, half, scale = rate + z * z / (2 * n), z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)), 1 + z * z / n
    return per.select(*by, "n", rate.alias("rate"), smooth.alias("smoothed"), (smooth / F.col("_base")).alias("lift"), "expected", (smooth - F.col("expected")).alias("synergy"), ((centre - half) / scale).alias("wilson_low"), ((centre + half) / scale).alias("wilson_high"))


def tier_shares(df: DataFrame, stage: str, tier: str, target: str, signals: str) -> DataFrame:
    """Per tier within its stage: rows, share of the stage, positive rate and mean number of signals; a null tier is one of its own."""
    per = df.groupBy(stage, tier).agg(F.count("*").alias("n"), F.avg(F.col(target).cast("double")).alias("positive_rate"), F.avg(F.col(signals).cast("double")).alias("mean_signals"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(stage)))  # over one row a tier


def min_rank(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Rank from the largest value down; equal values share the least rank. Without groups this is for small tables, one row a feature, say."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*(by or [])).orderBy(F.col(value).desc())))
