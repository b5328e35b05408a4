"""Where queries are registered, and the stand-in tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.sources.tables import load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def orders(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "orders")


def events(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "events")


SCORED = """SELECT o_orderkey AS id, o_custkey AS lead, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS p, CAST((o_orderkey * 104729) % 97 AS DOUBLE) / 97 AS p2,
 CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_orderpriority AS segment, o_orderstatus AS st, o_orderdate AS seen, o_totalprice AS price FROM orders"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a scored population: id, lead, two scores, a 0/1 target and segments."""
    o, k = orders(spark, d), F.col("o_orderkey")
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("lead"), ((k * 7919) % 1000 / F.lit(1000.0)).alias("p"), ((k * 104729) % 97 / F.lit(97.0)).alias("p2"),
        (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.col("o_orderpriority").alias("segment"), F.col("o_orderstatus").alias("st"), F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("price"),
    )


SNAPSHOTS = """SELECT part_id, seen, arg_max(available, (snap_id, available, until)) AS available, arg_max(until, (snap_id, available, until)) AS until, max(snap_id) AS snap_id FROM (
 SELECT l_partkey AS part_id, l_shipdate AS seen, l_orderkey * 10 + l_linenumber AS snap_id, l_returnflag = 'N' AS available, CAST(l_quantity AS BIGINT) AS until FROM lineitem) GROUP BY part_id, seen"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Line items as states of parts, one a part and day: of several the last id."""
    li = load_table(spark, d, "lineitem").select(F.col("l_partkey").alias("part_id"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("snap_id"), (F.col("l_returnflag") == "N").alias("available"), F.col("l_quantity").cast("long").alias("until"))
    last = F.max(F.struct("snap_id", "available", "until"))
    return li.groupBy("part_id", "at").agg(last.alias("x")).select("part_id", "at", "x.snap_id", "x.available", "x.until")


ASKS = "SELECT o_orderkey AS ask_id, o_custkey AS lead, arg_min(l_partkey, (l_linenumber, l_partkey)) AS part_id, any_value(o_orderdate) AS asked_at, any_value(o_orderstatus) AS st FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey"


def asks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as enquiries about the part of their first line."""
    li = load_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("part_id"))
    return orders(spark, d).join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("ask_id"), F.col("o_custkey").alias("lead"), "part_id", F.col("o_orderdate").alias("asked_at"), F.col("o_orderstatus").alias("st"))


#: Customers and suppliers as demand and supply over the hierarchy nation within region.
DEMAND = "SELECT c_custkey AS lead, c_mktsegment AS seg, CAST(n_regionkey AS BIGINT) AS region, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS budget, c_custkey % 4 AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey"
SUPPLY = "SELECT p_partkey AS spot, CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) AS nation, p_retailprice AS price, CAST(p_size AS DOUBLE) AS area, p_partkey % 4 AS kind, p_brand AS brand FROM part JOIN nation ON n_nationkey = p_partkey % 25"


def demand(spark: SparkSession, d: str) -> DataFrame:
    c, n = load_table(spark, d, "customer"), load_table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("lead"), F.col("c_mktsegment").alias("seg"), F.col("n_regionkey").cast("long").alias("region"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("budget"), (F.col("c_custkey") % 4).alias("kind"))


def supply(spark: SparkSession, d: str) -> DataFrame:
    p, n = load_table(spark, d, "part"), load_table(spark, d, "nation")
    return p.join(n, F.col("n_nationkey") == F.col("p_partkey") % 25).select(F.col("p_partkey").alias("spot"), F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("area"), (F.col("p_partkey") % 4).alias("kind"), F.col("p_brand").alias("brand"))


def r6(*names: str):
    """Columns rounded for comparison with SQL."""
    return [F.round(n, 6).alias(n) for n in names]
