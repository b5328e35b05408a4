"""Queries on profiles: mixtures, clustering-feature trees and components of customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators import clusters as K
from tarnwell.operators.learned import adjusted_rand
from tarnwell.plans.registry import orders, query, r6
from tarnwell.sources.tables import load_table


def _order_features(spark: SparkSession, d: str) -> DataFrame:
    """Orders with two features: their price in units of 100 000, and days since 1992 in units of 1 000."""
    days = F.datediff("o_orderdate", F.lit("1992-01-01"))
    return orders(spark, d).select("o_orderkey", "o_orderstatus", F.array(F.col("o_totalprice") / 100000.0, days / F.lit(1000.0)).alias("features"))


@query()
def mixture_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the components of a diagonal mixture: size, mean price and mean probability of the component."""
    rows = _order_features(spark, d)
    model = K.fit_mixture(rows, "features", [[1.0, 0.5], [2.0, 1.0], [3.0, 2.0]])
    named = K.named_by_size(K.with_component(rows, "features", model, "_label", "p"), "_label")
    return named.groupBy("profile").agg(F.count("*").alias("n"), F.avg(F.get("features", F.lit(0))).alias("price"), F.avg("p").alias("p")).select("profile", "n", *r6("price", "p"))


@query()
def tree_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Orders clustered through a clustering-feature tree, and how far the clusters agree with the orders' states."""
    named = K.tree_profiles(_order_features(spark, d), "features", 2, 3)
    return adjusted_rand(named, "profile", "o_orderstatus").select(*r6("ari"))


@query()
def customer_components(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of the customers' balances, segments and nations."""
    rows, names = K.coded(load_table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"], ["c_acctbal"])
    found = K.fit_components(rows, names, 1, 8)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(found.singular)], "component int, singular double").select("component", F.round("singular", 4).alias("singular"))
