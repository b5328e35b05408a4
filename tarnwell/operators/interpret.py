"""What a score depends on: grouped permutation importance, directions, counterfactuals, and the splits of fitted trees.

A score is given as a function from a frame to the same frame with a column of that name, so that frozen expressions and
fitted models serve alike.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

from .metrics import ranking_of_table
from .ordering import with_position
from .quantiles import grouped_quantiles

Score = Callable[[DataFrame], DataFrame]


def scored_by(expression: Column, name: str) -> Score:
    return lambda df: df.withColumn(name, expression)


def shuffle_order(unit: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(unit).cast("string")))


def _step(group: str, repeat: int, seed: int, n: int) -> tuple[int, int]:
    """(factor, shift) of a permutation k -> (factor k + shift) mod n: the factor is the first one from a hash that has no divisor in common with n."""
    digest = hashlib.sha256(f"{seed}|{group}|{repeat}".encode()).hexdigest()
    factor = 1 + int(digest[:8], 16) % max(1, min(n - 1, 1 << 20))
    while math.gcd(factor, n) != 1:
        factor += 1
    return factor, int(digest[8:16], 16) % n


def permutation_importance(df: DataFrame, target: str, score: Score, name: str, groups: dict[str, list[str]], unit: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """feature, columns, and mean and deviation of the drop in average precision and AUC where a group's columns are dealt to other rows.

    Rows stand in an order by hash. A repeat deals the values of all columns of a group by one permutation of places, so columns
    of a group stay together, and all groups and repeats are one join on places and one set of score tables. `unit` names rows.
    """
    columns = sorted({c for g in groups.values() for c in g})
    rows = df.filter(F.col(target).isNotNull())
    base = settled(with_position(rows.withColumn("_order", shuffle_order(unit, seed)), "_order", (unit,), name="_place").withColumn("_place", F.col("_place") - 1).drop("_order"), "places")
    n = base.count()
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, columns string, ap_drop_mean double, ap_drop_sd double, auc_drop_mean double, auc_drop_sd double")
    tasks = [F.struct(F.lit(g).alias("group"), F.lit(r).alias("repeat"), *[F.lit(x).cast("long").alias(y) for x, y in zip(_step(g, r, seed, n), ("factor", "shift"))]) for g in groups for r in range(repeats)]
    dealt = base.withColumn("_task", F.explode(F.array(*tasks))).withColumn("_from", F.pmod(F.col("_task.factor") * F.col("_place") + F.col("_task.shift"), F.lit(n)))
    donors = base.select(F.col("_place").alias("_from"), *[F.col(f"`{c}`").alias(f"_d{i}") for i, c in enumerate(columns)])
    both = dealt.join(donors.hint("merge"), "_from")  # as many rows as the table: its files may look small enough to broadcast
    for i, c in enumerate(columns):
        takes = F.col("_task.group").isin([g for g, cols in groups.items() if c in cols])
        both = both.withColumn(c, F.when(takes, F.col(f"_d{i}")).otherwise(F.col(f"`{c}`")))
    table = lambda frame, by: settled(score(frame).filter(F.col(name).isNotNull()).groupBy(*by, F.col(name).cast("double").alias("_s")).agg(F.sum(target).cast("double").alias("pos"), F.count("*").cast("double").alias("n")), "scores")
    keyed = both.withColumns({"feature": F.col("_task.group"), "repeat": F.col("_task.repeat")}).drop("_task", "_from", "_place", *[f"_d{i}" for i in range(len(columns))])
    moved = ranking_of_table(table(keyed, ["feature", "repeat"]), ("feature", "repeat"))
    whole = ranking_of_table(table(base, [])).select(F.col("average_precision").alias("_ap"), F.col("roc_auc").alias("_auc"))
    drops = moved.join(F.broadcast(whole)).withColumns({"ap": F.col("_ap") - F.col("average_precision"), "auc": F.col("_auc") - F.col("roc_auc")})  # a single row
    sd = lambda c: F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(0.0)
    named = F.create_map(*[F.lit(x) for g, cols in groups.items() for x in (g, "|".join(cols))])
    out = drops.groupBy("feature").agg(F.avg("ap").alias("ap_drop_mean"), sd("ap").alias("ap_drop_sd"), F.avg("auc").alias("auc_drop_mean"), sd("auc").alias("auc_drop_sd"))
    return out.select("feature", named[F.col("feature")].alias("columns"), "ap_drop_mean", "ap_drop_sd", "auc_drop_mean", "auc_drop_sd")


def directionality(df: DataFrame, measure: str, numeric: list[str], categorical: list[str], least_rows: int = 60, least_kinds: int = 4, least_group: int = 30) -> DataFrame:
    """feature, kind, low_group, low_edge, low_n, low_rate, the same of high, and delta_pp: the measure (a target or a score) at both ends of each feature.

    Ends of a number are its values up to the first and from the third quartile; those of a category, or of a number of few
    values, are its groups of least and largest mean among those of `least_group` rows. Features with fewer than `least_rows` known values are left out.
    """
    kinds = [(c, True) for c in numeric] + [(c, False) for c in categorical]
    entry = lambda c, num: F.struct(F.lit(c).alias("feature"), F.lit(num).alias("num"), (F.col(f"`{c}`").cast("double") if num else F.lit(None).cast("double")).alias("x"), F.col(f"`{c}`").cast("string").alias("v"))
    long = df.select(F.col(measure).cast("double").alias("y"), F.explode(F.array(*[entry(c, num) for c, num in kinds])).alias("e")).select("y", "e.*").filter("v is not null and (x is not null or not num)")
    cells = settled(long.groupBy("feature", "num", "x", "v").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.count("y").alias("known")), "values")
    size = cells.groupBy("feature").agg(F.sum("n").alias("rows"), F.count("*").alias("values"), F.max("num").alias("num")).filter(F.col("rows") >= least_rows)
    wide = size.withColumn("wide", F.col("num") & (F.col("values") >= least_kinds)).select("feature", "wide")
    edges = grouped_quantiles(long.filter("num"), ["feature"], "x", {"q25": 0.25, "q75": 0.75}).drop("n")
    marked = cells.join(F.broadcast(wide), "feature").join(F.broadcast(edges), "feature", "left")  # one row a feature
    side = lambda c, m: F.sum(F.when(c, F.col(m)))
    low, high = F.col("x") <= F.col("q25"), F.col("x") >= F.col("q75")
    quart = marked.filter("wide").groupBy("feature").agg(F.first("q25").alias("q25"), F.first("q75").alias("q75"), *[side(c, m).alias(f"{s}_{m}") for s, c in (("low", low), ("high", high)) for m in ("n", "y", "known")])
    rate = lambda s: F.try_divide(F.col(f"{s}_y"), F.col(f"{s}_known"))
    ends = [F.lit("quartiles").alias("kind"), F.lit("<=Q25").alias("low_group"), F.col("q25").alias("low_edge"), "low_n", rate("low").alias("low_rate"), F.lit(">=Q75").alias("high_group"), F.col("q75").alias("high_edge"), "high_n", rate("high").alias("high_rate")]
    first = quart.select("feature", *ends)
    groups = marked.filter("not wide").groupBy("feature", "v").agg(F.sum("n").alias("n"), (F.sum("y") / F.sum("known")).alias("r")).filter(F.col("n") >= least_group)
    pick = groups.groupBy("feature").agg(F.count("*").alias("k"), F.min(F.struct("r", "v", "n")).alias("a"), F.max(F.struct("r", "v", "n")).alias("b")).filter("k >= 2")
    second = pick.select("feature", F.lit("groups").alias("kind"), F.col("a.v").alias("low_group"), F.lit(None).cast("double").alias("low_edge"), F.col("a.n").alias("low_n"), F.col("a.r").alias("low_rate"), F.col("b.v").alias("high_group"), F.lit(None).cast("double").alias("high_edge"), F.col("b.n").alias("high_n"), F.col("b.r").alias("high_rate"))
    return first.unionByName(second).withColumn("delta_pp", 100 * (F.col("high_rate") - F.col("low_rate")))


def counterfactual_scores(df: DataFrame, score: Score, name: str, column: str, values: list, segments: list[str] | None = None) -> DataFrame:
    """segment, value, n, mean_<k> of each counterfactual value of a column, and `delta_pp`, the first one's mean less the last one's.

    The grid is exploded against the rows and scored in one pass. Without segments all rows are the segment "ALL".
    """
    kind = df.schema[column].dataType
    grid = F.posexplode(F.array(*[F.lit(v).cast(kind) for v in values])).alias("_k", "_cf")
    rows = score(df.select("*", grid).withColumn(column, F.col("_cf")))
    named = [F.struct(F.lit(s).alias("segment"), F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("<missing>")).alias("value")) for s in segments or []] or [F.struct(F.lit("ALL").alias("segment"), F.lit("ALL").alias("value"))]
    long = rows.select("_k", F.col(name).cast("double").alias("_p"), F.explode(F.array(*named)).alias("x")).select("_k", "_p", "x.*")
    means = [F.avg(F.when(F.col("_k") == k, F.col("_p"))).alias(f"mean_{k}") for k in range(len(values))]
    out = long.groupBy("segment", "value").agg((F.count("*") / len(values)).cast("long").alias("n"), *means)
    return out.withColumn("delta_pp", 100 * (F.col("mean_0") - F.col(f"mean_{len(values) - 1}")))


def tree_nodes(model: PipelineModel, path: str) -> DataFrame:
    """The nodes of a fitted forest or boosted model as a table, from its saved data: tree, node, left, right, feature, threshold, samples.

    Leaves have no feature and no children. `path` is a folder that the driver and all executors share; the model is written there.
    """
    from pyspark.sql import SparkSession

    model.stages[-1].write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    data = spark.read.parquet(f"{path}/data")
    node = data.select(F.col("treeID").alias("tree"), "nodeData.*") if "nodeData" in data.columns else data.select(F.lit(0).alias("tree"), "*")
    split = F.col("split")
    feature = F.when(split["featureIndex"] >= 0, split["featureIndex"])
    threshold = F.when(feature.isNotNull() & (split["numCategories"] == -1), split["leftCategoriesOrThreshold"][0])
    child = lambda c: F.when(feature.isNotNull(), F.col(c))
    return node.select("tree", F.col("id").alias("node"), child("leftChild").alias("left"), child("rightChild").alias("right"), feature.alias("feature"), threshold.alias("threshold"), F.col("rawCount").alias("samples"))


def tree_splits(nodes: DataFrame, names: dict[int, str], only: str | None = None, most_depth: int = 30) -> DataFrame:
    """tree, node, depth, feature, threshold, samples, and the features of the last three nodes above (parent_1 the nearest; empty where there is none).

    One join from parents to children a level; `names` gives feature names by index.
    """
    named = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    inner = settled(nodes.filter("feature is not null").withColumn("feature", F.coalesce(named[F.col("feature")], F.col("feature").cast("string"))), "splits")
    up = inner.select("tree", F.col("feature").alias("_f"), F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("_up"))
    roots = inner.join(up.select("tree", "node"), ["tree", "node"], "left_anti")
    level = settled(roots.select("tree", "node", F.lit(0).alias("depth"), *[F.lit("").alias(f"parent_{k}") for k in (1, 2, 3)]), "level")
    found = level
    for _ in range(most_depth):
        above = level.withColumnRenamed("node", "_up")
        down = up.join(above, ["tree", "_up"]).select("tree", "node", (F.col("depth") + 1).alias("depth"), F.col("_f").alias("parent_1"), F.col("parent_1").alias("parent_2"), F.col("parent_2").alias("parent_3"))
        level = settled(down.join(inner.select("tree", "node"), ["tree", "node"]), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    out = inner.join(found, ["tree", "node"]).select("tree", "node", "depth", "feature", "threshold", "samples", "parent_1", "parent_2", "parent_3")
    return out.filter(F.col("feature") == only) if only else out
