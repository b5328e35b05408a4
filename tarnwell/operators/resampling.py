"""Bootstrap intervals of metrics, resampled at the level of the score table.

Rows with the same scores and target are one cell; a draw gives a cell of n rows Poisson(n) of them, which is what n rows
of a Poisson(1) weight each sum to. So work is draws times distinct cells, not draws times rows. n is
cut into powers of two, each a Poisson draw of its own by inverting the distribution function at a number hashed
from the cell, the part and the draw: reruns agree, and SQL can draw the same. Draws by cluster weigh whole clusters, so there cells are
those of a cluster. Metrics of all draws are then tie-aware aggregates of weighted score tables, bucketed so that no draw's table is one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .metrics import ranking_of_table

#: Counts are drawn in powers of two up to 2^LARGEST, larger ones in several of these.
LARGEST = 8

#: Parts of [0, 1) for which the number of a distribution's steps below is looked up.
GUIDE = 256

METRICS = ("roc_auc", "average_precision", "brier", "log_loss", "lift_5", "lift_10", "recall_10", "recall_20")


def poisson_steps(mean: float, least: float = 1e-17) -> tuple[int, list[float]]:
    """(first, cumulative probabilities of first, first + 1, ...): those below the first and beyond the last are under `least`."""
    log_p = lambda k: k * math.log(mean) - mean - math.lgamma(k + 1)
    first = next(k for k in range(int(mean) + 1) if log_p(k) > math.log(least))
    total, k, out = 0.0, first, []
    while k <= mean or log_p(k) > math.log(least):
        total += math.exp(log_p(k))
        out.append(total)
        k += 1
    return first, out


def _drawn(part: Column | None, u: Column) -> Column:
    """The Poisson number of mean 2^part (1 without a part) at the distribution's value u."""
    tables = [poisson_steps(float(1 << e)) for e in range(LARGEST + 1)]
    single = sum(((u >= x).cast("long") for x in tables[0][1]), F.lit(0).cast("long"))
    if part is None:
        return single
    # how many steps are at most j / GUIDE for every j: a value is compared with the few steps between its two neighbours alone
    guides = [[sum(x <= j / GUIDE for x in t) for j in range(GUIDE + 1)] for _, t in tables]
    steps = F.array(*[F.array(*[F.lit(x) for x in t]) for _, t in tables])[part]
    guide = F.array(*[F.array(*[F.lit(x) for x in g]) for g in guides])[part]
    j = F.floor(u * GUIDE).cast("int")
    inside = F.slice(steps, guide[j] + 1, guide[j + 1] - guide[j])
    return F.when(part == 0, single).otherwise((F.array(*[F.lit(f) for f, _ in tables])[part] + guide[j] + F.size(F.filter(inside, lambda x: x <= u))).cast("long"))


def _uniform(*names: Column | str) -> Column:
    """A number in [0, 1) from the first 13 digits of the MD5 of the names, joined by bars."""
    text = F.concat_ws("|", *[x.cast("string") if isinstance(x, Column) else F.col(x).cast("string") for x in names])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _parts(n: Column) -> Column:
    """Powers of two that sum to n, each with its number among them: structs (e, i)."""
    top = 1 << LARGEST
    bits = F.filter(F.sequence(F.lit(0), F.lit(LARGEST - 1)), lambda e: F.floor(n / F.pow(F.lit(2.0), e)) % 2 == 1)
    small = F.transform(bits, lambda e: F.struct(e.alias("e"), F.lit(0).cast("long").alias("i")))
    full = F.floor(n / top)
    large = F.when(full > 0, F.transform(F.sequence(F.lit(1).cast("long"), full), lambda i: F.struct(F.lit(LARGEST).alias("e"), i.alias("i"))))
    return F.concat(small, F.coalesce(large, F.filter(small, lambda _: F.lit(False))))


def _weighed(long: DataFrame, u: Column, part: Column | None) -> DataFrame:
    """The rows that are drawn, with their number `_w`.

    By a generator, not a filter: a filter on the number would be pushed below the hash, which would then be taken once a comparison.
    """
    return long.withColumn("_u", u).select("*", F.explode(F.filter(F.array(_drawn(part, F.col("_u"))), lambda w: w > 0)).alias("_w")).drop("_u")


def drawn_cells(cells: DataFrame, draws: int, seed: int) -> DataFrame:
    """Cells (cell, pos, neg, ...) once a draw, with drawn `pos` and `neg`; those of nothing are left out."""
    rest = [c for c in cells.columns if c not in ("pos", "neg")]
    sides = F.array(*[F.struct(F.lit(y).alias("y"), F.col(c).cast("long").alias("n")) for y, c in ((1, "pos"), (0, "neg"))])
    long = cells.select(*rest, F.explode(sides).alias("_side")).filter("_side.n > 0").select(*rest, F.col("_side.y").alias("_y"), F.explode(_parts(F.col("_side.n"))).alias("_part"))
    long = long.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    long = _weighed(long, _uniform(F.lit(seed), "cell", "_y", "_part.e", "_part.i", "draw"), F.col("_part.e"))
    return long.groupBy(*rest, "draw").agg(F.sum(F.when(F.col("_y") == 1, F.col("_w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("_y") == 0, F.col("_w")).otherwise(0)).alias("neg"))


def _packs(cells: DataFrame, most: int) -> DataFrame:
    """cell, _pack and `_cells`, up to `most` cells (pos, neg, ...) of the cluster `cell`."""
    held = [c for c in cells.columns if c != "cell"]
    packed = cells.withColumn("_pack", F.pmod(F.xxhash64(*held), F.lit(1 << 30))).withColumn("_n", F.row_number().over(Window.partitionBy("cell").orderBy("_pack")))
    return packed.groupBy("cell", F.floor(F.col("_n") / most).alias("_pack")).agg(F.collect_list(F.struct(*held)).alias("_cells"))


def drawn_clusters(cells: DataFrame, draws: int, seed: int, most: int = 64) -> DataFrame:
    """Cells (cell, pos, neg, ...) once a draw, those of one cluster `cell` with one number: a draw is hashed once for up to `most` cells of a cluster."""
    packs = settled(_packs(cells, most), "packs")
    drawn = _weighed(packs.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))), _uniform(F.lit(seed), "cell", "draw"), None)
    rows = drawn.select("cell", "draw", "_w", F.explode("_cells").alias("_x")).select("cell", "draw", "_w", "_x.*")
    return rows.withColumns({"pos": F.col("pos") * F.col("_w"), "neg": F.col("neg") * F.col("_w")})


def _drawn_by_digits(md5: Column) -> Column:
    """`_drawn(None, u)` where u is the number that `_uniform` makes of an MD5: its digits are compared with those of the steps."""
    # u >= x where the first 13 digits, as a number, are at least x * 2^52; a longer text of the same start is not less
    least = [d for d in (math.ceil(x * (1 << 52)) for x in poisson_steps(1.0)[1]) if d < 1 << 52]
    out = F.when(md5 < F.lit(f"{least[0]:013x}"), 0)
    for k, d in enumerate(least[1:], 1):
        out = out.when(md5 < F.lit(f"{d:013x}"), k)
    return out.otherwise(len(least)).cast("long")


def cluster_tables(cells: DataFrame, scores: list[str], by: list[str], draws: int, seed: int, most: int = 64, at_once: int = 10, tasks: int = 96) -> DataFrame:
    """Score tables (by..., draw, score_name, _s, pos, n) of the cells that `drawn_clusters` gives, without a row a cell and draw.

    A cell has a row for `at_once` draws, whose sums are columns: work is still draws times cells, but most of it is additions. Packs are dealt to `tasks`: they are small, and
    few tasks would get all of them.
    """
    packs = _packs(cells, most).repartition(tasks, "cell", "_pack").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(draws / at_once) - 1))))
    draw = [F.col("_block") * at_once + k + 1 for k in range(at_once)]
    hashed = packs.select("_block", "_cells", *[F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("cell").cast("string"), t.cast("string"))).alias(f"_h{k}") for k, t in enumerate(draw)])
    # by a generator, so that a hash is taken once a pack and not once a cell
    weighed = hashed.select("_block", "_cells", F.inline(F.array(F.struct(*[_drawn_by_digits(F.col(f"_h{k}")).alias(f"_w{k}") for k in range(at_once)]))))
    rows = weighed.select("_block", *[f"_w{k}" for k in range(at_once)], F.inline("_cells"))
    named = F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_s")) for i, c in enumerate(scores)]))
    long = rows.select(*by, "_block", "pos", (F.col("pos") + F.col("neg")).alias("n"), *[f"_w{k}" for k in range(at_once)], named)
    sums = long.groupBy(*by, "_i", "_s", "_block").agg(*[F.sum(F.col(c) * F.col(f"_w{k}")).alias(f"_{c}{k}") for k in range(at_once) for c in ("pos", "n")])
    each = F.inline(F.array(*[F.struct(t.cast("int").alias("draw"), F.col(f"_pos{k}").cast("double").alias("pos"), F.col(f"_n{k}").cast("double").alias("n")) for k, t in enumerate(draw)]))
    name = F.get(F.array(*[F.lit(c) for c in scores]), F.col("_i")).alias("score_name")
    return sums.select(*by, name, "_s", each).filter((F.col("draw") <= draws) & (F.col("n") > 0))


def _cells(df: DataFrame, target: str, scores: list[str], unit: str, by: list[str]) -> DataFrame:
    """One row a combination of scores (and `by`): its rows by target, named by the smallest unit among them."""
    known = df.filter(F.col(target).isNotNull()).select(F.col(unit).alias("cell"), F.col(target).cast("int").alias("_y"), *scores, *by)
    for s in scores:
        known = known.filter(F.col(s).isNotNull())
    return known.groupBy(*scores, *by).agg(F.min("cell").alias("cell"), F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") != 1).alias("neg"))


def _measured(drawn: DataFrame, scores: list[str], by: list[str]) -> DataFrame:
    """Metrics of each score and group `by` (draw among them), as rows (by..., score_name, metrics)."""
    long = drawn.select(*by, "pos", "neg", F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).cast("double").alias("_s")) for s in scores])).alias("x")).select(*by, "x.*", "pos", "neg")
    keys = [*by, "score_name"]
    return _metrics_of(long.groupBy(*keys, "_s").agg(F.sum("pos").cast("double").alias("pos"), F.sum(F.col("pos") + F.col("neg")).cast("double").alias("n")), keys)


def _metrics_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of the score tables (keys..., _s, pos, n), as rows (keys..., metrics)."""
    table = settled(table, "draws")
    p = F.least(F.greatest(F.col("_s"), F.lit(1e-8)), F.lit(1 - 1e-8))
    neg = F.col("n") - F.col("pos")
    errors = table.groupBy(*keys).agg(
        (F.sum(F.col("pos") * (1 - F.col("_s")) * (1 - F.col("_s")) + neg * F.col("_s") * F.col("_s")) / F.sum("n")).alias("brier"),
        (F.sum(-(F.col("pos") * F.log(p) + neg * F.log(1 - p))) / F.sum("n")).alias("log_loss"),
    )
    return ranking_of_table(table, tuple(keys)).filter((F.col("positives") > 0) & (F.col("positives") < F.col("n_rows"))).join(errors, keys).select(*keys, *METRICS)


def _long(per: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    return per.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("x")).select(*keys, "x.*")


def _macro(per: DataFrame, keys: list[str]) -> DataFrame:
    """Means over folds."""
    return per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS])


def metric_intervals(df: DataFrame, target: str, scores: list[str], unit: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """score_name, metric, estimate, ci_low, ci_high and draws: percentile intervals of each score's metrics over row bootstraps.

    `unit` is a column of whole numbers that names rows. Each score is resampled by its own distinct values. Draws of one class are left out.
    """
    cells = None
    for s in scores:
        one = _cells(df, target, [s], unit, []).select("cell", "pos", "neg", F.lit(s).alias("score_name"), F.col(s).cast("double").alias("_s"))
        cells = one if cells is None else cells.unionByName(one)
    cells = settled(cells, "cells")
    measured = lambda d, by: _measured(d.withColumnRenamed("score_name", "_name"), ["_s"], [*by, "_name"]).drop("score_name").withColumnRenamed("_name", "score_name")
    per = _long(measured(drawn_cells(cells, draws, seed), ["draw"]), ["draw", "score_name"])
    spread = per.groupBy("score_name", "metric").agg(F.percentile("value", F.lit(0.025)).alias("ci_low"), F.percentile("value", F.lit(0.975)).alias("ci_high"), F.count("value").alias("draws"))
    return _long(measured(cells, []), ["score_name"]).withColumnRenamed("value", "estimate").join(spread, ["score_name", "metric"])


def paired_delta(df: DataFrame, target: str, reference: str, challenger: str, unit: str, draws: int = 1000, seed: int = 42, cluster: str | None = None, fold: str | None = None) -> DataFrame:
    """metric, estimates of both scores, delta (challenger less reference), its mean, interval and share of positive draws, and the number of draws.

    Both scores see the same draws. With `cluster` whole clusters are drawn, and `unit` is not used; with `fold` the metrics are means over the
    folds that hold both classes in a draw.
    """
    by, scores = [fold] if fold else [], [reference, challenger]
    if cluster:
        cells = settled(_cells(df, target, scores, cluster, [cluster, *by]).drop(cluster), "cells")
        per = _metrics_of(cluster_tables(cells, scores, by, draws, seed), ["draw", *by, "score_name"])
    else:
        cells = settled(_cells(df, target, scores, unit, by), "cells")
        per = _measured(drawn_cells(cells, draws, seed), scores, ["draw", *by])
    whole = _measured(cells, scores, by)
    if fold:
        per, whole = _macro(per, ["draw", "score_name"]), _macro(whole, ["score_name"])
    named = lambda d, score, name, keys: _long(d.filter(F.col("score_name") == score), keys).withColumnRenamed("value", name)
    deltas = named(per, challenger, "c", ["draw"]).join(named(per, reference, "r", ["draw"]), ["draw", "metric"]).withColumn("d", F.col("c") - F.col("r"))
    spread = deltas.groupBy("metric").agg(F.avg("d").alias("delta_mean"), F.percentile("d", F.lit(0.025)).alias("delta_low"), F.percentile("d", F.lit(0.975)).alias("delta_high"), F.avg((F.col("d") > 0).cast("double")).alias("positive_share"), F.count("d").alias("draws"))
    both = named(whole, reference, "reference", []).join(named(whole, challenger, "challenger", []), "metric")
    return both.withColumn("delta", F.col("challenger") - F.col("reference")).join(spread, "metric")
