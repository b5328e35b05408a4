"""Recalibration of scores by stage: isotonic and Platt fits of many groups at once, and their choice by cross-fitting.

Rows are first one row a group and distinct score. Pool-adjacent-violators is a mergeable aggregation: scores are cut
into ranges, each range pools its own violators, and neighbouring ranges whose ends still violate are
pooled together until none do. Pools of pools are the pools of all, so the result is that of one pass over
the sorted scores, and ranges that hold no violation are never brought together.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .ordering import _bucketed

METHODS = ("raw", "platt", "isotonic")


def pooled(positives: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where the pools of a sequence begin: neighbours whose rates do not rise are one pool."""
    start, pos, size = [], [], []
    for k, (p, m) in enumerate(zip(positives.tolist(), n.tolist())):
        start.append(k)
        pos.append(p)
        size.append(m)
        while len(start) > 1 and pos[-2] * size[-1] >= pos[-1] * size[-2]:
            p, m = pos.pop(), size.pop()
            start.pop()
            pos[-1] += p
            size[-1] += m
    return np.array(start, dtype=np.int64)


def _pool(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("lo", kind="stable")
    at = pooled(part["pos"].to_numpy(), part["n"].to_numpy())
    if not len(at):
        return part
    last = np.append(at[1:], len(part)) - 1
    return pd.DataFrame({"_g": part["_g"].iloc[0], "chunk": part["chunk"].iloc[0], "lo": part["lo"].to_numpy()[at], "hi": part["hi"].to_numpy()[last], "pos": np.add.reduceat(part["pos"].to_numpy(), at), "n": np.add.reduceat(part["n"].to_numpy(), at)})


def isotonic_pools(table: DataFrame, buckets: int = 16) -> DataFrame:
    """The pools (_g, lo, hi, pos, n) of each group of a score table (_g, _s, pos, n), rates rising with the score."""
    schema = "_g string, chunk long, lo double, hi double, pos double, n double"
    start = _bucketed(table, F.col("_s"), buckets).select(F.col("_g").cast("string").alias("_g"), F.col("_bucket").cast("long").alias("chunk"), F.col("_s").cast("double").alias("lo"), F.col("_s").cast("double").alias("hi"), F.col("pos").cast("double").alias("pos"), F.col("n").cast("double").alias("n"))
    pools = settled(start.groupBy("_g", "chunk").applyInPandas(_pool, schema), "pools")
    rate = F.col("pos") / F.col("n")
    while True:
        ends = pools.groupBy("_g", "chunk").agg(F.min_by(rate, "lo").alias("first"), F.max_by(rate, "lo").alias("last"))
        order = Window.partitionBy("_g").orderBy("chunk")  # over one row a range
        apart = F.coalesce(F.lag("last").over(order) < F.col("first"), F.lit(True))
        runs = settled(ends.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order)).select("_g", "chunk", "run", "apart"), "runs")
        if runs.filter("apart = 0").isEmpty():
            return pools.drop("chunk")
        moved = pools.join(runs, ["_g", "chunk"]).select("_g", F.col("run").alias("chunk"), "lo", "hi", "pos", "n")
        pools = settled(moved.groupBy("_g", "chunk").applyInPandas(_pool, schema), "pools")


def apply_isotonic(df: DataFrame, pools: DataFrame, group: Column, score: str, name: str, most_knots: int = 100_000) -> DataFrame:
    """The frame with the score's isotonic value: constant inside a pool, linear between two, that of the ends beyond them; null without pools.

    While there are at most `most_knots` ends of pools they are looked up; more are found by one union and a window.
    """
    value = F.col("pos") / F.col("n")
    knots = pools.select("_g", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), value.alias("y"))
    keyed = df.withColumns({"_k": group, "_x": F.col(f"`{score}`").cast("double")})
    if knots.count() <= most_knots:
        arrays = knots.groupBy(F.col("_g").alias("_kg")).agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("_knots"))  # at most most_knots in all
        both = keyed.join(F.broadcast(arrays), F.col("_k") == F.col("_kg"), "left")
        below = F.size(F.filter("_knots", lambda k: k["x"] <= F.col("_x")))
        both = both.withColumns({"_b": F.when(below > 0, F.get("_knots", below - 1)), "_a": F.get("_knots", below)})
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        left = keyed.select("_k", "_x", F.lit(1).alias("_kind"), row.alias("_row"), F.lit(None).cast("struct<x:double,y:double>").alias("_knot"))
        right = knots.select(F.col("_g").alias("_k"), F.col("x").alias("_x"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct("x", "y").alias("_knot"))
        order = Window.partitionBy("_k").orderBy("_x", "_kind")
        before = F.last("_knot", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        after = F.first("_knot", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        both = left.unionByName(right).withColumns({"_b": before, "_a": after}).filter("_row is not null").select("_row.*", "_x", "_b", "_a")
    b, a = F.col("_b"), F.col("_a")
    share = F.try_divide(F.col("_x") - b["x"], a["x"] - b["x"])
    got = F.when(F.col("_x").isNull(), None).when(b.isNull(), a["y"]).when(a.isNull(), b["y"]).otherwise(b["y"] + (a["y"] - b["y"]) * share)
    return both.withColumn("_got", got).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_got").alias(name))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def platt_fits(table: DataFrame, least: int = 40, steps: int = 50, most_groups: int = 10_000) -> DataFrame:
    """_g, intercept, slope and status of a logistic fit on the logits of each group of a score table (_g, _s, pos, n).

    Groups of fewer than `least` rows, of one class or of one score keep their scores (0, 1, identity). All groups take their Newton step in one aggregation;
    one row a group reaches the driver, of at most `most_groups` groups (stages and folds, not entities).
    """
    spark = table.sparkSession
    z = settled(table.select(F.col("_g").cast("string").alias("_g"), F.round(_logit(F.col("_s").cast("double")), 12).alias("z"), F.col("pos").cast("double").alias("pos"), F.col("n").cast("double").alias("n")), "logits")
    totals = z.groupBy("_g").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), (F.max("z") - F.min("z")).alias("width")).limit(most_groups + 1).collect()
    if len(totals) > most_groups:
        raise ValueError(f"more than {most_groups} groups")
    fit, open_, out = {}, set(), {}
    for r in totals:
        if r["n"] < least or not 0 < r["pos"] < r["n"] or r["width"] <= 0:
            out[r["_g"]] = (0.0, 1.0, "identity")
        else:
            fit[r["_g"]] = (math.log(r["pos"] / (r["n"] - r["pos"])), 0.0)
            open_.add(r["_g"])
    for _ in range(steps):
        if not open_:
            break
        state = spark.createDataFrame([(g, *fit[g]) for g in sorted(open_)], "_k string, a double, b double")
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("z"))))
        w, e = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
        sums = z.join(F.broadcast(state), F.col("_g") == F.col("_k")).groupBy("_g").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate([e, e * F.col("z"), w, w * F.col("z"), w * F.col("z") * F.col("z")])])
        for r in sums.collect():
            det = max(r["s2"] * r["s4"] - r["s3"] * r["s3"], 1e-12)
            da, db = (r["s4"] * r["s0"] - r["s3"] * r["s1"]) / det, (r["s2"] * r["s1"] - r["s3"] * r["s0"]) / det
            longest = max(abs(da), abs(db), 2.0) / 2.0  # no step longer than 2
            a, b = fit[r["_g"]]
            fit[r["_g"]] = (a + da / longest, b + db / longest)
            if abs(da) + abs(db) < 1e-10:
                open_.discard(r["_g"])
    rows = [(g, *x) for g, x in out.items()] + [(g, *x, "platt") for g, x in fit.items()]
    return spark.createDataFrame(sorted(rows), "_g string, intercept double, slope double, status string")


def apply_platt(df: DataFrame, fits: DataFrame, group: Column, score: str, name: str) -> DataFrame:
    """The frame with the score's recalibrated value; groups without a fit keep their scores. `fits` has one row a stage and fold."""
    named = F.broadcast(fits.select(F.col("_g").alias("_f"), "intercept", "slope", "status"))
    s = F.col(f"`{score}`").cast("double")
    got = F.when(F.coalesce(F.col("status") == "platt", F.lit(False)), 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * _logit(s))))).otherwise(s)
    both = df.withColumn("_k", group).join(named, F.col("_k") == F.col("_f"), "left")
    return both.withColumn("_got", got).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_got").alias(name))


def fold_of(unit: str, folds: int = 5, seed: int = 42) -> Column:
    """A fold from 0 to folds - 1, by the MD5 of seed and unit."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int")


def stage_cells(df: DataFrame, target: str, score: str, stage: str, fold: Column) -> DataFrame:
    """_g (the stage as text), fold, _s, pos, n: one row a stage, fold and distinct score of rows with score and target."""
    known = df.filter(F.col(target).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.coalesce(F.col(stage).cast("string"), F.lit("<missing>")).alias("_g"), fold.alias("fold"), F.col(score).cast("double").alias("_s")).agg(F.sum(F.col(target).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))


def _fit_key(fit: Column) -> Column:
    return F.concat_ws("#", "_g", fit.cast("string"))


def cross_fitted(cells: DataFrame, folds: int = 5, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """The cells of stage_cells with the value of each method, learned on the other folds of the stage."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    train = cells.withColumn("fit", F.explode(others)).groupBy(_fit_key(F.col("fit")).alias("_g"), "_s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    train, out = settled(train, "folds"), cells.withColumn("raw", F.col("_s"))
    if "platt" in methods:
        out = apply_platt(out, platt_fits(train), _fit_key(F.col("fold")), "_s", "platt")
    if "isotonic" in methods:
        out = apply_isotonic(out, isotonic_pools(train), _fit_key(F.col("fold")), "_s", "isotonic").withColumn("isotonic", F.coalesce("isotonic", "_s"))
    return out


def calibration_choice(values: DataFrame, methods: tuple[str, ...] = METHODS, material: float = 0.001, tolerance: float = 0.005) -> DataFrame:
    """_g, method, n, brier, log_loss, their gains over raw, whether it qualifies, and the chosen one.

    A method qualifies if its larger gain is material and its smaller one no loss beyond the tolerance. Of those the one of the largest sum of gains
    is taken, Platt if the two sums are within `material`, raw if none qualifies.
    """
    long = values.select("_g", "pos", "n", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("q")) for m in methods])).alias("x")).select("_g", "pos", "n", "x.*")
    c = F.least(F.greatest(F.col("q"), F.lit(1e-8)), F.lit(1 - 1e-8))
    neg = F.col("n") - F.col("pos")
    errors = long.groupBy("_g", "method").agg(
        F.sum("n").cast("long").alias("n"), (F.sum(F.col("pos") * (1 - F.col("q")) * (1 - F.col("q")) + neg * F.col("q") * F.col("q")) / F.sum("n")).alias("brier"), (F.sum(-(F.col("pos") * F.log(c) + neg * F.log(1 - c))) / F.sum("n")).alias("log_loss"),
    )
    raw = lambda m: F.max(F.when(F.col("method") == "raw", F.col(m))).over(Window.partitionBy("_g"))  # noqa: E731  # over one row a method
    gains = errors.withColumns({"brier_gain": raw("brier") - F.col("brier"), "log_loss_gain": raw("log_loss") - F.col("log_loss")})
    passes = (F.col("method") != "raw") & (F.greatest("brier_gain", "log_loss_gain") >= material) & (F.least("brier_gain", "log_loss_gain") >= -tolerance)
    judged = gains.withColumn("qualifies", passes).withColumn("_sum", F.when(passes, F.col("brier_gain") + F.col("log_loss_gain")))
    best, platt = (F.max(x).over(Window.partitionBy("_g")) for x in ("_sum", F.when(F.col("method") == "platt", F.col("_sum"))))
    judged = judged.withColumns({"_best": best, "_platt": platt})
    chosen = F.when(F.col("_best").isNull(), F.col("method") == "raw").when(F.col("_best") - F.col("_platt") < material, F.col("method") == "platt").otherwise(F.coalesce(F.col("_sum") == F.col("_best"), F.lit(False)))
    return judged.withColumn("chosen", chosen).drop("_sum", "_best", "_platt")


def calibrate_by_stage(validation: DataFrame, df: DataFrame, target: str, score: str, stage: str, unit: str, name: str = "calibrated", folds: int = 5, seed: int = 42) -> DataFrame:
    """The frame with scores recalibrated by the method that is chosen for its stage on the validation rows, fitted on all of them."""
    cells = settled(stage_cells(validation, target, score, stage, fold_of(unit, folds, seed)), "cells")
    choice = calibration_choice(cross_fitted(cells, folds)).filter("chosen").select(F.col("_g").alias("_c"), F.col("method").alias("_method"))
    whole = settled(cells.groupBy("_g", "_s").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")), "stages")
    group = F.coalesce(F.col(stage).cast("string"), F.lit("<missing>"))
    both = apply_isotonic(apply_platt(df, platt_fits(whole), group, score, "_platt"), isotonic_pools(whole), group, score, "_isotonic")
    both = both.withColumn("_stage", group).join(F.broadcast(choice), F.col("_stage") == F.col("_c"), "left")  # one row a stage
    got = F.when(F.col("_method") == "platt", F.col("_platt")).when(F.col("_method") == "isotonic", F.col("_isotonic")).otherwise(F.col(score).cast("double"))
    return both.withColumn("_got", got).select(*[F.col(f"`{c}`") for c in df.columns], F.col("_got").alias(name))
