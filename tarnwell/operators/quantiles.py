"""Exact quantiles of many groups at once, by narrowing.

Sketches give each group and share an interval in which its quantile must lie; counting passes tell how many values are below
the interval and inside it. An interval that misses is moved to the side where the rank is, one that still holds too many distinct values is
sketched again, inside itself. Only distinct values inside the last intervals are ordered, so neither a group that
holds most rows nor a value that does is ever one task's work. State is one row a group and share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.tables import settled

#: At most so many groups are looked up in a broadcast table: those with at least this part of all rows, or all if they are fewer.
_LOOKED_UP = 10_000


def _group(by: list[str]) -> Column:
    """The group as one value in which nulls are equal."""
    return F.to_json(F.struct(*[F.col(f"`{b}`").cast("string").alias(f"k{i}") for i, b in enumerate(by)])) if by else F.lit("")


def _with_state(rows: DataFrame, state: DataFrame, sizes: DataFrame) -> DataFrame:
    """Each row with `spots`, its group's intervals; groups of many rows are looked up, the others joined.

    A group that holds a ten-thousandth of all rows is hot, so there are at most that many hot ones.
    """
    per_group = state.groupBy("_g").agg(F.collect_list(F.struct(*[c for c in state.columns if c != "_g"])).alias("spots"))  # one entry a share
    total, groups = sizes.agg(F.sum("n"), F.count("*")).first()
    if not total or groups <= _LOOKED_UP:
        return rows.join(F.broadcast(per_group), "_g")
    hot = F.broadcast(per_group.join(sizes.filter(F.col("n") * _LOOKED_UP >= total).select("_g"), "_g"))
    cold = per_group.join(sizes.filter(F.col("n") * _LOOKED_UP < total).select("_g"), "_g")
    return rows.join(hot, "_g").unionByName(rows.join(hot.select("_g"), "_g", "left_anti").join(cold, "_g"))


def _sketched(rows: DataFrame, state: DataFrame, sizes: DataFrame, accuracy: int) -> DataFrame:
    """The state with `near`: values around each rank, sketched among the values inside its interval."""
    spots = _with_state(rows, state.select("_g", "k", "rank", "a", "b", "below", "size"), sizes).select("_g", "_v", F.explode("spots").alias("s"))
    inside = spots.filter(F.col("_v").between(F.col("s.a"), F.col("s.b")))
    sketch = inside.groupBy("_g", F.col("s.k").alias("k")).agg(F.percentile_approx("_v", [j / accuracy for j in range(accuracy + 1)], 4 * accuracy).alias("grid"))
    at = (F.col("rank") - F.col("below")) / F.greatest(F.col("size") - 1, F.lit(1)) * accuracy
    cut = lambda x: F.element_at("grid", (F.greatest(F.lit(0), F.least(F.lit(accuracy), x)) + 1).cast("int"))
    return state.join(sketch, ["_g", "k"]).withColumns({"na": cut(F.floor(at) - 1), "nb": cut(F.ceil(at) + 2)}).drop("grid")


def _moved(rows: DataFrame, state: DataFrame, sizes: DataFrame) -> DataFrame:
    """The state with the sketched intervals, or what is left or right of those that miss."""
    spots = _with_state(rows, state.select("_g", "k", "a", "b", "na", "nb"), sizes).select("_g", "_v", F.explode("spots").alias("s"))
    inside = spots.filter(F.col("_v").between(F.col("s.a"), F.col("s.b")))
    side = F.when(F.col("_v") < F.col("s.na"), 0).when(F.col("_v") <= F.col("s.nb"), 1).otherwise(2)
    counts = inside.groupBy("_g", F.col("s.k").alias("k")).agg(
        *[F.count_if(side == i).alias(f"n{i}") for i in range(3)],
        *[F.approx_count_distinct(F.when(c, F.col("_v"))).alias(f"d{i}") for i, c in enumerate([F.col("_v") <= F.col("s.na"), side == 1, F.col("_v") >= F.col("s.nb")])],
        F.count_if(F.col("_v") == F.col("s.na")).alias("at_na"), F.count_if(F.col("_v") == F.col("s.nb")).alias("at_nb"),
    )
    from_, to = F.col("below") + F.col("n0"), F.col("below") + F.col("n0") + F.col("n1")
    left, right = F.col("rank") < from_, F.col("next") >= to
    pick = lambda l, m, r: F.when(left, l).when(right, r).otherwise(m)
    moved = state.join(counts, ["_g", "k"])
    return moved.select(
        "_g", "k", "rank", "next",
        pick(F.col("a"), F.col("na"), F.when(F.col("rank") < to, F.col("na")).otherwise(F.col("nb"))).alias("a"),
        pick(F.when(F.col("next") < from_, F.col("na")).otherwise(F.col("nb")), F.col("nb"), F.col("b")).alias("b"),
        pick(F.col("below"), from_, F.when(F.col("rank") < to, from_).otherwise(to - F.col("at_nb"))).alias("below"),
        pick(F.col("n0") + F.when(F.col("next") < from_, F.col("at_na")).otherwise(F.col("n1")), F.col("n1"), F.when(F.col("rank") < to, F.col("n1")).otherwise(F.col("at_nb")) + F.col("n2")).alias("size"),
        pick(F.col("d0") + F.when(F.col("next") < from_, 0).otherwise(F.col("d1")), F.col("d1"), F.when(F.col("rank") < to, F.col("d1")).otherwise(0) + F.col("d2")).alias("kinds"),
    )


def grouped_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], rule: str = "linear", accuracy: int = 500, most: int = 20_000, passes: int = 12) -> DataFrame:
    """The groups (columns `by`) with `n` (values) and the quantile of each named share, as doubles.

    `rule` is "linear" (between the two neighbours of q (n - 1)) or "nearest" (the value at the index nearest to it, halves up). Null values
    are left out and nulls in `by` are a group; groups without a value are not there. Groups of up to `most` distinct values are ordered as they are,
    of others at most about that many around each rank.
    """
    if rule not in ("linear", "nearest"):
        raise ValueError(f"unknown rule {rule!r}")
    rows = df.select(_group(by).alias("_g"), *[F.col(f"`{b}`").alias(f"_by{i}") for i, b in enumerate(by)], F.col(f"`{value}`").cast("double").alias("_v")).filter("_v is not null")
    named = rows.groupBy("_g").agg(*[F.first(f"_by{i}").alias(f"_by{i}") for i in range(len(by))], F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"), F.approx_count_distinct("_v").alias("kinds"))
    named = settled(named, "groups")
    rows, sizes = rows.select("_g", "_v"), named.select("_g", "n")
    q = F.array(*[F.lit(float(s)) for s in shares.values()])
    at = F.round(q[F.col("k")] * (F.col("n") - 1), 9)
    rank = F.floor(at) if rule == "linear" else F.floor(at + 0.5)
    follows = F.ceil(at) if rule == "linear" else rank
    spot = F.explode(F.sequence(F.lit(0), F.lit(len(shares) - 1)))
    state = named.select("_g", "n", "a", "b", "kinds", spot.alias("k")).select("_g", "k", rank.alias("rank"), follows.alias("next"), "a", "b", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), "kinds")
    many = (F.col("kinds") > most) & (F.col("a") < F.col("b"))
    done, open_ = state.filter(~many), settled(state.filter(many), "open")
    passed = 0
    while passed < passes and not open_.isEmpty():
        passed += 1
        after = settled(_moved(rows, _sketched(rows, open_, sizes, accuracy), sizes), "moved")
        done, open_ = done.unionByName(after.filter(~many)), after.filter(many)
    state = settled(done.unionByName(open_), "intervals") if passed else done
    spots = _with_state(rows, state.select("_g", "k", "a", "b"), sizes).select("_g", "_v", F.explode("spots").alias("s"))
    members = spots.filter(F.col("_v").between(F.col("s.a"), F.col("s.b"))).groupBy("_g", F.col("s.k").alias("k"), "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_g", "k").orderBy("_v"))
    ends = members.withColumn("upto", upto).join(state.select("_g", "k", "rank", "next", "below"), ["_g", "k"]).withColumn("upto", F.col("upto") + F.col("below"))
    holds = lambda r: F.max(F.when((F.col(r) < F.col("upto")) & (F.col(r) >= F.col("upto") - F.col("c")), F.col("_v")))
    both = ends.groupBy("_g", "k").agg(holds("rank").alias("lo"), holds("next").alias("hi"))
    both = both.join(sizes, "_g").withColumn("at", at)
    found = both.withColumn("q", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("at") - F.floor("at"))))
    wide = found.groupBy("_g").agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(shares)])
    return named.select("_g", *[F.col(f"_by{i}").alias(b) for i, b in enumerate(by)], "n").join(wide, "_g").drop("_g")
