"""Evaluation of scores against 0/1 targets, grouped and tie-aware, as plain aggregations.

Everything starts from one row a distinct score (and group) with its counts, so rows are
aggregated before anything is ordered, and no metric depends on the order of tied rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .ordering import exact_quantiles, running


def score_table(df: DataFrame, target: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """_s, pos, n: one row a distinct score, rows without score or target left out."""
    return df.filter(F.col(target).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.sum(target).cast("double").alias("pos"), F.count("*").cast("double").alias("n"))


def ranking_metrics(df: DataFrame, target: str, score: str, by: tuple[str, ...] = (), shares: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """n, positives, roc_auc, average_precision, and precision, recall and lift at shares of capacity.

    Rows tied at the capacity share what is left of it, so no order among them matters.
    """
    return ranking_of_table(settled(score_table(df, target, score, by), "scores"), by, shares)


def ranking_of_table(table: DataFrame, by: tuple[str, ...] = (), shares: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """The ranking metrics of a score table (by..., _s, pos, n), whose counts may be weights. The table is read several times."""
    both = running(table, "_s", ["pos", "n"], by, descending=True).withColumnsRenamed({"all_pos": "_P", "all_n": "_N"})
    neg = F.col("n") - F.col("pos")
    neg_below = F.col("_N") - F.col("_P") - (F.col("before_n") - F.col("before_pos")) - neg
    precision = F.try_divide(F.col("before_pos") + F.col("pos"), F.col("before_n") + F.col("n"))
    out = [
        F.max("_N").cast("long").alias("n_rows"),
        F.max("_P").cast("long").alias("positives"),
        F.try_divide(F.sum(F.col("pos") * (neg_below + neg / 2)), F.max(F.col("_P") * (F.col("_N") - F.col("_P")))).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.max("_P")).alias("average_precision"),
    ]
    for s in shares:
        k = F.greatest(F.lit(1.0), F.ceil(F.round(F.col("_N") * s, 9)).cast("double"))
        taken = F.greatest(F.lit(0.0), F.least(F.col("n"), k - F.col("before_n")))
        hits = F.sum(F.try_divide(F.col("pos") * taken, F.col("n")))
        name = f"{round(s * 100)}"
        out += [
            (hits / F.max(k)).alias(f"precision_{name}"),
            F.try_divide(hits, F.max("_P")).alias(f"recall_{name}"),
            F.try_divide(hits / F.max(k), F.max(F.col("_P") / F.col("_N"))).alias(f"lift_{name}"),
        ]
    return both.groupBy(*by).agg(*out)


def error_metrics(df: DataFrame, target: str, p: str, by: tuple[str, ...] = (), least: float = 1e-8) -> DataFrame:
    """Brier score and clipped log-loss."""
    y, q = F.col(target).cast("double"), F.least(F.greatest(F.col(p), F.lit(least)), F.lit(1 - least))
    return df.groupBy(*by).agg(F.avg((F.col(p) - y) * (F.col(p) - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"))


def pr_auc_trapezoid(df: DataFrame, target: str, score: str) -> DataFrame:
    """Area under precision over recall by trapezoids; null for a constant score."""
    down = running(score_table(df, target, score), "_s", ["pos", "n"], (), descending=True)
    total = down.agg(F.sum("pos").alias("_P"), F.count("*").alias("_K"))
    at = down.join(F.broadcast(total)).select("_s", "_K", ((F.col("before_pos") + F.col("pos")) / F.col("_P")).alias("r"), ((F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n"))).alias("p"), (F.col("before_pos") / F.col("_P")).alias("r0"), F.when(F.col("before_n") > 0, F.col("before_pos") / F.col("before_n")).alias("p0"))
    return at.agg(F.when(F.max("_K") > 1, F.sum((F.col("r") - F.col("r0")) * (F.col("p") + F.coalesce("p0", F.lit(1.0))) / 2)).alias("pr_auc"))


def gains_table(df: DataFrame, target: str, score: str, steps: int = 20) -> DataFrame:
    """step, share, recall and lift for capacities 1/steps, 2/steps, ..., tie-aware."""
    down = running(score_table(df, target, score), "_s", ["pos", "n"], (), descending=True)
    total = down.agg(F.sum("pos").alias("_P"), F.sum("n").alias("_N"))
    dealt = down.join(F.broadcast(total)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    k = F.greatest(F.lit(1.0), F.ceil(F.round(F.col("_N") * F.col("step") / steps, 9)).cast("double"))
    taken = F.greatest(F.lit(0.0), F.least(F.col("n"), k - F.col("before_n")))
    sums = dealt.groupBy("step").agg(F.sum(F.col("pos") * taken / F.col("n")).alias("hits"), F.max(k).alias("k"), F.max("_P").alias("_P"), F.max("_N").alias("_N"))
    return sums.select("step", (F.col("step") / steps).alias("share"), F.try_divide("hits", "_P").alias("recall"), F.try_divide(F.col("hits") / F.col("k"), F.col("_P") / F.col("_N")).alias("lift"))


def edges_of(df: DataFrame, value: str, bins: int) -> list[float]:
    """Distinct exact quantiles 0, 1/bins, ..., 1 of a column: at most bins + 1 numbers."""
    return sorted(set(exact_quantiles(df, [value], [k / bins for k in range(bins + 1)])[value] or []))


def calibration_table(df: DataFrame, target: str, p: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, rate over right-closed quantile bins, the first one closed on both sides."""
    edges = edges_of(df.filter(F.col(p).isNotNull()), p, bins)
    band = F.lit(len(edges) - 1)
    for k in range(len(edges) - 2, 0, -1):
        band = F.when(F.col(p) <= edges[k], k).otherwise(band)
    return df.filter(F.col(p).isNotNull()).groupBy(band.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_score"), F.avg(F.col(target).cast("double")).alias("rate"))


def calibration_line(df: DataFrame, target: str, p: str, steps: int = 25) -> DataFrame:
    """Intercept and slope of a logistic fit on the logit, by Newton steps over sufficient sums; slope null for a constant score."""
    z = F.log(F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))))
    small = df.select(F.round(z, 12).alias("z"), F.col(target).cast("double").alias("y")).groupBy("z").agg(F.count("*").alias("n"), F.sum("y").alias("y")).persist()
    kinds, total, hits = small.count(), *small.agg(F.sum("n"), F.sum("y")).first()
    mean = min(max(hits / total, 1e-6), 1 - 1e-6)
    a, b = math.log(mean / (1 - mean)), 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("z"))))
        w = F.col("n") * q * (1 - q)
        r = small.agg(F.sum(F.col("y") - F.col("n") * q), F.sum((F.col("y") - F.col("n") * q) * F.col("z")), F.sum(w), F.sum(w * F.col("z")), F.sum(w * F.col("z") * F.col("z"))).first()
        if kinds < 2:
            a, step = a + r[0] / max(r[2], 1e-12), abs(r[0])
            if step < 1e-9:
                break
            continue
        det = max(r[2] * r[4] - r[3] * r[3], 1e-12)
        da, db = (r[4] * r[0] - r[3] * r[1]) / det, (r[2] * r[1] - r[3] * r[0]) / det
        longest = max(abs(da), abs(db), 2.0) / 2.0  # no step longer than 2
        da, db = da / longest, db / longest
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-10:
            break
    small.unpersist()
    return df.sparkSession.range(1).select(F.lit(a).alias("intercept"), F.lit(b if kinds > 1 else None).cast("double").alias("slope"))


def segment_metrics(df: DataFrame, target: str, score: str, segments: list[str], least: int = 100) -> DataFrame:
    """Ranking metrics of each value of each segment column, for those with enough rows and both classes, in one job."""
    long = df.select(target, score, F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.coalesce(F.col(s).cast("string"), F.lit("<missing>")).alias("value")) for s in segments])).alias("x")).select(target, score, "x.*")
    return ranking_metrics(long, target, score, ("segment", "value")).filter((F.col("n_rows") >= least) & (F.col("positives") > 0) & (F.col("positives") < F.col("n_rows")))


def macro_mean(per_group: DataFrame, columns: list[str]) -> DataFrame:
    """Unweighted means over groups, and their number."""
    return per_group.agg(F.count("*").alias("n_groups"), *[F.avg(c).alias(f"macro_{c}") for c in columns])


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Population stability index over reference quantiles; values outside them are dropped, shares are at least 1e-6."""
    edges = edges_of(reference, value, bins)
    if len(edges) < 3:
        return reference.sparkSession.range(1).select(F.lit(0.0).alias("psi"))
    band = F.when((F.col(value) < edges[0]) | (F.col(value) > edges[-1]) | F.col(value).isNull(), F.lit(None).cast("int"))
    for k in range(1, len(edges) - 1):
        band = band.when(F.col(value) < edges[k], k)
    band = band.otherwise(len(edges) - 1)
    count = lambda df, name: df.select(band.alias("_b")).filter("_b is not null").groupBy("_b").agg(F.count("*").alias(name))
    slots = reference.sparkSession.range(1, len(edges)).select(F.col("id").cast("int").alias("_b"))
    both = slots.join(count(reference, "r"), "_b", "left").join(count(current, "c"), "_b", "left")
    whole = Window.partitionBy()  # over at most `bins` rows
    share = lambda c: F.greatest(F.lit(1e-6), F.coalesce(F.col(c), F.lit(0)) / F.sum(c).over(whole))
    return both.select(share("r").alias("r"), share("c").alias("c")).agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def categorical_js(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Jensen-Shannon divergence, base 2, of the shares of categories; nulls are a category."""
    share = lambda df, name: df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("<missing>")).alias("v")).agg(F.count("*").alias(name))
    both = share(reference, "r").join(share(current, "c"), "v", "full").fillna(0, ["r", "c"])
    total = both.agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    p = both.join(F.broadcast(total)).select((F.col("r") / F.col("_r")).alias("p"), (F.col("c") / F.col("_c")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    return p.agg((F.sum(half("p")) / 2 + F.sum(half("q")) / 2).alias("js"))


def numeric_drift(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """Wasserstein distance in reference IQRs, and difference of missing shares."""
    missing = lambda df: df.agg(F.avg(F.col(value).isNull().cast("double")))
    delta = missing(current).first()[0] - missing(reference).first()[0]
    q = exact_quantiles(reference, [value], [0.25, 0.75])[value]
    r = reference.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("r"), F.lit(0.0).alias("c"))
    c = current.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.lit(0.0).alias("r"), F.count("*").cast("double").alias("c"))
    merged = r.unionByName(c).groupBy("x").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    up = running(merged, "x", ["r", "c"])
    total = merged.agg(F.sum("r").alias("_r"), F.sum("c").alias("_c"))
    prior = running(up.select("x", F.lit(1.0).alias("one"), "r", "c", "before_r", "before_c"), "x", ["one"])
    # the step between a value and the next one down carries the difference of the two distributions below it
    lagged = prior.join(F.broadcast(total)).select("x", F.col("before_one").alias("k"), F.abs(F.col("before_r") / F.col("_r") - F.col("before_c") / F.col("_c")).alias("gap"))
    nxt = lagged.select((F.col("k") + 1).alias("k"), F.col("x").alias("x0"))
    dist = lagged.join(nxt, "k").agg(F.coalesce(F.sum((F.col("x") - F.col("x0")) * F.col("gap")), F.lit(0.0)).alias("w"))
    return dist.select((F.col("w") / F.lit(max(q[1] - q[0], 1e-9) if q else None)).alias("wasserstein_iqr"), F.lit(delta).alias("missing_delta"))


def confusion(df: DataFrame, target: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1; divisions by zero give 0."""
    y, p = F.col(target) == 1, F.col(predicted) == 1
    c = df.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns({"precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)})


def error_types(df: DataFrame, target: str, score: str, reference: Column, q: float = 0.9) -> DataFrame:
    """TP, FP, FN, TN at the quantile of the reference rows' scores."""
    cut = exact_quantiles(df.filter(reference), [score], [q])[score]
    high, y = F.col(score) >= F.lit(cut[0] if cut else None).cast("double"), F.col(target) == 1
    return df.withColumn("error_type", F.when(high & y, "TP").when(high, "FP").when(y, "FN").otherwise("TN"))


def collapse_guard(base: DataFrame, challenger: DataFrame, keys: list[str], ap_drop: float = 0.02, brier_rise: float = 0.02, least_folds: int = 2, least_rows: int = 100) -> DataFrame:
    """Segments in which the challenger loses too much average precision, or gains too much Brier score, in enough folds.

    Both sides have one row a fold and segment with n_rows, average_precision and brier. Compared are folds in which both models have the same
    number of rows, enough of them; the others are counted in n_skipped, so a segment that one model lacks is not forgotten. Null keys are a segment.
    """
    side = lambda df, name: df.select("fold", *keys, F.lit(name).alias("_side"), "n_rows", "average_precision", "brier")
    of = lambda name, c: F.max(F.when(F.col("_side") == name, F.col(c))).alias(f"_{name}_{c}")
    pairs = side(base, "b").unionByName(side(challenger, "c")).groupBy("fold", *keys).agg(*[of(s, c) for s in "bc" for c in ("n_rows", "average_precision", "brier")])
    compared = F.coalesce((F.col("_b_n_rows") == F.col("_c_n_rows")) & (F.col("_b_n_rows") >= least_rows), F.lit(False))
    worse = (F.col("_c_average_precision") - F.col("_b_average_precision") < -ap_drop) | (F.col("_c_brier") - F.col("_b_brier") > brier_rise)
    out = pairs.groupBy(*keys).agg(F.count_if(compared & F.coalesce(worse, F.lit(False))).alias("n_worse"), F.count_if(compared).alias("n_folds"), F.count_if(~compared).alias("n_skipped"))
    return out.withColumn("collapsed", F.col("n_worse") >= least_folds)


def permuted(df: DataFrame, column: str, seed: int = 3, buckets: int = 64) -> DataFrame:
    """The column's values dealt to other rows of the table: positions in two hash orders are matched."""
    from .ordering import with_position

    keyed = df.withColumn("_u", F.monotonically_increasing_id())
    a = with_position(keyed.withColumn("_h", F.xxhash64("_u", F.lit(seed)).cast("double")), "_h", ("_u",), name="_p", buckets=buckets).drop("_h")
    b = with_position(keyed.withColumn("_h", F.xxhash64("_u", F.lit(seed + 1)).cast("double")), "_h", ("_u",), name="_p", buckets=buckets).select("_p", F.col(column).alias("_v"))
    return a.drop(column).join(b, "_p").withColumn(column, F.col("_v")).select(df.columns)
