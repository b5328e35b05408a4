"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is the one nearest to 1 (in relative entropy, documents weighing alike, no rate over
`most`) that makes each source's expected words meet its target. The dual has one multiplier
a source; the rates are exponential tilts min(most, exp(multiplier * size / mean size)). Newton
steps on the logarithm of the expected words, kept inside a bracket, solve all sources at
once over the histogram of sizes; each step is one job over a table far smaller than the documents.

Rates become copies: everyone gets the whole part, and the fractions are filled in the order
of a stable hash divided by the fraction, up to the target; what is then left is filled with
free copies, the largest sizes that fit first, as many of each as fit, so that a source misses its target only by less than its
smallest document with a free copy, or the share `near` of the target. Orders are summed by slots and blocks of slots, so no task holds a
whole source, or all documents of one size.

Edge cases: null texts and texts without a word have size 0, rate 1 and take nothing; very long texts count whole; the null
source is a source of its own and comes last; a source without words has target 0; null ids
and repeated rows are documents of their own; ties in the order of fractions are broken by id and row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, forget, hash_fraction, materialize, table
from ._shards import join_per_key

#: Slots of the order in which fractions are filled, and how many of them are summed as one block first.
_SLOTS, _BLOCK = 1 << 14, 1 << 7


def sizes_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_row, id, source, size (words) of every document, written out."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return materialize(rows, "sizes")


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with `place`, their number in code-point order, null last: a range sort, then the number of rows before each part."""
    sorted_ = materialize(sources.sort(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = {r["part"]: r["n"] for r in sorted_.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a part of the sort
    before, total = [], 0
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    offsets = sources.sparkSession.createDataFrame(before or [(0, 0)], "part bigint, before bigint")
    return sorted_.join(F.broadcast(offsets), part == F.col("part")).withColumn("place", F.col("before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "part", "before")


def targets_of(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, n, source_size, target: words by cycling weights over the sources in code-point order, none above `most` times its size.

    The excess over the caps is shared again by weight until none is above: a source takes the lesser of
    weight * level and its cap, and each round raises the level by what the capped ones can't take. A round is one aggregate of two numbers.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)
    rated = _numbered(totals).select("source", "n", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap"))
    rated = materialize(rated, "weights")
    sums = rated.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    whole, level, capped = float(share) * float(sums["words"] or 0), 0.0, -1
    if whole:
        level = whole / sums["weight"]
        while True:
            over = F.col("weight") * level >= F.col("cap")
            now = rated.agg(F.sum(over.cast("long")).alias("n"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
            if now["n"] == capped or not now["weight"]:
                break
            capped, level = now["n"], max(level, (whole - now["cap"]) / now["weight"])
    return rated.select("source", "n", "source_size", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def _rate(size: Column, multiplier: Column, mean: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.lit(50.0), multiplier * size / mean)))


def balance(sizes: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-6, steps: int = 60) -> DataFrame:
    """source, n, source_size, target, mean, multiplier: the dual solution, one row a source."""
    histogram = materialize(sizes.filter("size > 0").groupBy("source", "size").count(), "histogram")
    start = targets.withColumns(
        {
            "mean": F.greatest(F.col("source_size") / F.greatest(F.col("n"), F.lit(1)), F.lit(1.0)),
            "full": F.col("target") >= F.col("source_size") * float(most) * (1 - 1e-12),
            "multiplier": F.when(F.col("target") > F.col("source_size"), F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0)),
            "lo": F.lit(None).cast("double"),
            "hi": F.lit(None).cast("double"),
        }
    )
    state = materialize(start, "multipliers")
    for _ in range(steps):
        open_ = state.filter("not full and source_size > 0")
        joined = histogram.join(open_.select("source", "multiplier", "mean"), histogram["source"].eqNullSafe(open_["source"])).drop(open_["source"])
        tilt = F.exp(F.least(F.lit(50.0), F.col("multiplier") * F.col("size") / F.col("mean")))
        words = F.col("count") * F.col("size")
        sums = joined.groupBy("source").agg(
            F.sum(words * F.least(F.lit(float(most)), tilt)).alias("words"),
            F.sum(F.when(tilt < most, words * F.col("size") / F.col("mean") * tilt)).alias("slope"),
        )
        s, g = state.alias("s"), sums.alias("g")
        both = s.join(g, F.col("s.source").eqNullSafe(F.col("g.source")), "left").select("s.*", "g.words", "g.slope")
        below = F.col("words") < F.col("target")
        lo, hi = F.when(below, F.col("multiplier")).otherwise(F.col("lo")), F.when(below, F.col("hi")).otherwise(F.col("multiplier"))
        newton = F.col("multiplier") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        inside = (newton > F.coalesce(lo, F.lit(-1e300))) & (newton < F.coalesce(hi, F.lit(1e300)))
        halved = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(hi.isNotNull(), hi * 2 - 1).otherwise(lo * 2 + 1)
        off = F.abs(F.col("words") / F.col("target") - 1)
        moved = both.withColumn("off", off).select(
            "source", "n", "source_size", "target", "mean", "full",
            F.when(F.coalesce(off, F.lit(0.0)) <= tolerance, F.col("multiplier")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(halved).alias("multiplier"),
            lo.alias("lo"), hi.alias("hi"), "off",
        )
        after = materialize(moved, "multipliers")
        worst = after.agg(F.max("off")).first()[0]
        forget(state)
        state = after
        if worst is None or worst <= tolerance:
            break
    # rounded, so that the order of additions never shows
    return state.select("source", "source_size", "target", "mean", F.when(F.col("full"), F.lit(1e6)).otherwise(F.round("multiplier", 9)).alias("multiplier"))


def _edge(slots: DataFrame, room: DataFrame) -> DataFrame:
    """_k, room, filled and edge of each key: the slot at which its words pass the room, and the words before it.

    `slots` holds _k, slot (0 to _SLOTS - 1) and words; `room` holds _k, room and filled. Words are summed
    by blocks of slots first and by slot inside one block then, so a key's rows of either window are at most 128.
    """
    per = materialize(slots.groupBy("_k", "slot").agg(F.sum("words").alias("words")), "slots")
    state = room.withColumn("block", F.lit(None).cast("long"))
    for width in (_BLOCK, 1):
        inside = per.join(state, "_k").filter(F.col("block").isNull() | (F.floor(F.col("slot") / _BLOCK) == F.col("block")))
        sums = inside.groupBy("_k", F.floor(F.col("slot") / width).alias("at")).agg(F.sum("words").alias("words"), F.max("room").alias("room"), F.max("filled").alias("filled"))
        upto = F.col("filled") + F.sum("words").over(Window.partitionBy("_k").orderBy("at"))
        found = sums.withColumn("upto", upto).groupBy("_k").agg(
            F.max("room").alias("room"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))), F.max("filled")).alias("filled"),
            F.coalesce(F.min(F.when(F.col("upto") > F.col("room"), F.col("at"))), F.lit(_SLOTS)).alias("block"),
        )
        state = materialize(found, "edges")
    return state.withColumnRenamed("block", "edge")


def _fill(rows: DataFrame, room: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with `extra`: 1 for those that come, in the order of their slots, before their key's room is full.

    `rows` holds _k, slot (null: never), inner, words and what `order` needs; `room` holds _k, room, filled and _n, the number of the key's rows.
    The slot at which a key's room ends is cut once more by `inner`, and only one slot of that is ordered row by row.
    """
    edge = _edge(rows.filter("slot is not null").select("_k", "slot", "words"), room.drop("_n"))
    edge = materialize(edge.join(room.select("_k", "_n"), "_k"), "edge")
    dealt = join_per_key(rows, edge, "_k")
    at_edge = materialize(dealt.filter("slot = edge"), "edge-rows")
    fine = _edge(at_edge.select("_k", F.col("inner").alias("slot"), "words"), edge.select("_k", "room", "filled"))
    last = materialize(at_edge.drop("room", "filled", "edge").join(fine, "_k"), "last-rows")
    line = F.sum("words").over(Window.partitionBy("_k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ordered = last.filter("inner = edge").withColumn("extra", (F.col("filled") + line <= F.col("room")).cast("int"))
    placed_ = last.filter("inner <> edge").withColumn("extra", (F.col("inner") < F.col("edge")).cast("int"))
    others = dealt.filter("slot is null or slot <> edge or edge is null").withColumn("extra", F.coalesce((F.col("slot") < F.col("edge")).cast("int"), F.lit(0)))
    named = [*rows.columns, "extra"]
    return others.select(*named).unionByName(placed_.select(*named)).unionByName(ordered.select(*named))


def _by_size(spare: DataFrame, left: DataFrame) -> DataFrame:
    """_k, size, copies, taken: how many of the free copies of each size fill what is left, the largest sizes first.

    `spare` holds _k, size and copies (free ones); `left` holds _k, left and near. A round takes whole sizes from the largest that fits until one
    does not fit whole, and as many of that as fit. What is then left is less than that size, so a round or two
    halve it: rounds are as many as its digits in base two, however many sizes there are.
    """
    state, taken = left, spare.withColumn("taken", F.lit(0).cast("long")).filter("false")
    down = Window.partitionBy("_k").orderBy(F.desc("size"))
    while True:
        fits = spare.join(state, "_k").filter((F.col("left") > F.col("near")) & (F.col("size") <= F.col("left")))
        before = F.coalesce(F.sum(F.col("size") * F.col("copies")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        room = F.col("left") - before
        whole = F.col("size") * F.col("copies") <= room
        # sizes up to the first that does not fit whole; those after it wait for the next round
        tried = fits.withColumn("_whole", whole).withColumn("_room", room).withColumn("_open", F.coalesce(F.min(F.col("_whole").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
        took = tried.filter("_open = 1").select("_k", "size", "copies", F.when(F.col("_whole"), F.col("copies")).otherwise(F.floor(F.col("_room") / F.col("size"))).cast("long").alias("taken")).filter("taken > 0")
        took = materialize(took, "taken-sizes")
        if took.isEmpty():
            return taken
        taken = taken.unionByName(took)
        spent = took.groupBy("_k").agg(F.sum(F.col("size") * F.col("taken")).alias("spent"))
        state = materialize(state.join(spent, "_k", "left").select("_k", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"), "near"), "left")
        spare = spare.join(took.select("_k", "size"), ["_k", "size"], "left_anti")


def _key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def copies_of(sizes: DataFrame, solved: DataFrame, most: float = 2.0, near: float = 1e-4) -> DataFrame:
    """_row, id, source, size, source_size, target, rate, copies: whole copies whose words meet the targets.

    Free copies are added, the largest sizes first, until none fits or the rest is under the share `near` of the target.
    """
    keyed = sizes.withColumn("_k", _key(F.col("source")))
    count = keyed.groupBy("_k").agg(F.count("*").alias("_n"))
    per = materialize(solved.withColumn("_k", _key(F.col("source"))).drop("source").join(count, "_k"), "per-source")
    # a source's rows are not dealt out by it: the largest sources are looked up
    rated = join_per_key(keyed, per, "_k")
    rated = rated.withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("size"), F.col("multiplier"), F.col("mean"), most)).otherwise(F.lit(1.0)))
    rated = rated.withColumns({"base": F.floor("rate"), "part": F.col("rate") - F.floor("rate")})
    draw = F.when(F.col("id").isNull(), hash_fraction("_row")).otherwise(hash_fraction("id"))
    rated = rated.withColumn("turn", F.when((F.col("part") > 0) & (F.col("size") > 0), draw / F.col("part")))
    # turns have no upper bound, their slots have; rows of a slot are dealt to slots of their own by another hash
    rated = rated.withColumns(
        {
            "slot": F.floor(F.col("turn") / (1 + F.col("turn")) * _SLOTS),
            "inner": F.when(F.col("turn").isNotNull(), F.floor(hash_fraction(F.lit("inner"), "id", "_row") * _SLOTS)),
            "words": F.col("size"),
        }
    )
    rated = materialize(rated.drop("multiplier", "mean"), "rated")
    room = rated.groupBy("_k").agg(F.greatest(F.max("target") - F.sum(F.col("size") * F.col("base")), F.lit(0.0)).alias("room"), F.lit(0).cast("long").alias("filled"), F.count("*").alias("_n"))
    filled = _fill(rated, room, [F.col("turn"), F.col("id").asc_nulls_last(), F.col("_row")])
    filled = materialize(filled.select("_k", "_row", "id", "source", "size", "source_size", "target", "rate", (F.col("base") + F.col("extra")).alias("copies")), "filled")
    # what is left of each source's target, by sizes of free copies
    left = filled.groupBy("_k").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("left"), (F.max("target") * near).alias("near"))
    spare = filled.filter((F.col("size") > 0) & (F.col("copies") < int(most))).groupBy("_k", "size").agg(F.sum(int(most) - F.col("copies")).alias("copies"), F.count("*").alias("_n"))
    spare = materialize(spare, "spare")
    sized = lambda df: F.concat_ws("|", df["size"].cast("string"), df["_k"])
    took = _by_size(spare.drop("_n"), materialize(left, "left")).join(spare.select("_k", "size", "_n"), ["_k", "size"])
    took = materialize(took.select(sized(took).alias("_z"), "copies", "taken", "_n"), "taken-sizes")
    if took.isEmpty():
        return filled.drop("_k")
    # a size of which all free copies are taken is full; of the others single copies are dealt out by hash
    free = filled.withColumn("_z", sized(filled))
    free = join_per_key(free, took.select("_z", F.col("copies").alias("_free"), F.col("taken").alias("_taken"), "_n"), "_z")
    gets = (F.col("size") > 0) & (F.col("copies") < int(most)) & F.col("_taken").isNotNull()
    free = materialize(free.withColumn("copies", F.when(gets & (F.col("_taken") == F.col("_free")), F.lit(int(most)).cast("long")).otherwise(F.col("copies"))), "free")
    units = free.filter(gets & (F.col("_taken") < F.col("_free"))).select(F.col("_z").alias("_k"), "_row", "_taken", "_free", F.explode(F.sequence(F.lit(1), (int(most) - F.col("copies")).cast("int"))).alias("unit"))
    units = units.select("_k", "_row", "unit", "_taken", "_free", F.lit(1).cast("long").alias("words"), *[F.floor(hash_fraction(F.lit(x), "_row", "unit") * _SLOTS).alias(x) for x in ("slot", "inner")])
    units = materialize(units, "units")
    if units.isEmpty():
        return free.drop("_k", "_z", "_free", "_taken")
    dealt = _fill(units.drop("_taken", "_free"), units.groupBy("_k").agg(F.max("_taken").cast("double").alias("room"), F.lit(0).cast("long").alias("filled"), F.count("*").alias("_n")), [F.col("_row"), F.col("unit")])
    more = dealt.filter("extra = 1").groupBy("_row").agg(F.count("*").alias("_more"))
    return free.join(more, "_row", "left").withColumn("copies", F.col("copies") + F.coalesce("_more", F.lit(0))).drop("_k", "_z", "_free", "_taken", "_more")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """id, source, size, source_size, target, rate, copies and taken (words) of every document."""
    sizes = sizes_of(docs, id_col, text_col, source_col)
    targets = materialize(targets_of(sizes, weights, share, most), "targets")
    found = copies_of(sizes, balance(sizes, targets, most), most)
    return found.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("source_size"), F.col("target"), F.col("rate"), F.col("copies").cast("long").alias("copies"), (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the rate and copies behind them."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
