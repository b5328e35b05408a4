"""Consistency rules over listing text and structured attributes, sampling, sentence statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.scalars import fold_text, json_list, mentions, scrambled

#: Phrases that make a claim, accents folded.
CLAIMS = {
    "natural_light": ["iluminacion natural", "luz natural"],
    "security": ["seguridad 24/7", "control de acceso", "vigilancia", "circuito cerrado"],
    "parking": ["estacionamiento", "cajon de estacionamiento", "cajones de estacionamiento", "parking"],
    "readiness": ["listo para ocupar", "recien remodelado", "acabados modernos", "acabados de primera"],
}
#: Phrases of the semantic rules.
BUILDING_COPY = ["buena iluminacion natural", "recien remodelado", "acabados modernos", "listo para ocupar", "acabados de primera"]
ALTERNATE_USE_COPY = ["ideal para oficinas corporativas o centro de distribucion"]
STRONG_SECURITY_COPY = ["seguridad 24/7", "control de acceso"]
MARKETING_COPY = {
    "NV_near_shopping_centers": ["ubicacion estrategica cerca de centros comerciales"],
    "NV_road_access": ["excelente ubicacion con acceso a vias principales"],
    "NV_transit_access": ["facil acceso a transporte publico y avenidas principales"],
    "NV_market_demand": ["zona de alta plusvalia y demanda comercial"],
    "NV_all_services": ["cuenta con todos los servicios"],
}


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=\.)\s+"), lambda s: s != "")


def evidence(description: Column, phrases: list[str]) -> Column:
    """The first sentence that makes the claim, else the whole description."""
    found = F.filter(sentences(description), lambda s: mentions(s, phrases))
    return F.coalesce(F.trim(F.get(found, 0)), F.trim(description))


def contradictions(df: DataFrame, item: str) -> DataFrame:
    """One row an issue: R001 light, R002 security, R003 parking, R004 readiness, each with its evidence."""
    text = F.concat_ws(" ", "title", "description")
    none = lambda c: F.coalesce(fold_text(F.trim(F.col(c))), F.lit("")).isin("", "none")
    listed = F.exists(json_list(F.col("amenities")), lambda x: fold_text(x) == "parking")
    no_parking = F.coalesce(F.col("parking_spaces").cast("double"), F.lit(0.0)) == 0
    rules = [
        ("R001", "natural_light", "high", F.col("natural_light") == False),  # noqa: E712
        ("R002", "security", "high", none("security_type")),
        ("R003", "parking", "medium", no_parking & ~listed),
        ("R004", "readiness", "medium", fold_text(F.col("building_status")) == "needs_renovation"),
    ]
    found = F.array(*[F.when(mentions(text, CLAIMS[claim]) & F.coalesce(cond, F.lit(False)), F.struct(F.lit(rid).alias("rule_id"), F.lit(claim).alias("claim"), F.lit(level).alias("severity"), evidence(F.col("description"), CLAIMS[claim]).alias("evidence"))) for rid, claim, level, cond in rules])
    return df.select(item, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(item, "x.*")


def observations(df: DataFrame, item: str) -> DataFrame:
    """One row an observation: S001-S003 mismatches between fields and text, NV_* claims nobody can verify."""
    d = F.col("description")
    rules = [
        ("S001", True, "medium", (F.col("sector_name") == "Land") & mentions(d, BUILDING_COPY)),
        ("S002", False, "low", (F.col("sector_name") == "Retail") & mentions(d, ALTERNATE_USE_COPY)),
        ("S003", True, "medium", mentions(d, STRONG_SECURITY_COPY) & F.coalesce(fold_text(F.col("security_type")), F.lit("")).isin("", "none")),
        *[(rid, False, "info", mentions(d, phrases)) for rid, phrases in MARKETING_COPY.items()],
    ]
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rid).alias("pattern_id"), F.lit(act).alias("actionable"), F.lit(level).alias("severity"))) for rid, act, level, cond in rules])
    return df.select(item, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(item, "x.*")


def sentence_frequency(df: DataFrame, text: str, least: int = 2) -> DataFrame:
    """Sentences that occur in several rows, with their number of rows and occurrences."""
    # the number comes before the sentences are exploded, so that it is one a row of the table
    long = df.select(F.monotonically_increasing_id().alias("_row"), sentences(F.col(text)).alias("_all")).select("_row", F.explode("_all").alias("sentence"))
    per = long.groupBy("sentence", "_row").agg(F.count("*").alias("k"))
    return per.groupBy("sentence").agg(F.count("*").alias("n_rows"), F.sum("k").alias("n_occurrences")).filter(F.col("n_rows") >= least)


def exact_duplication(df: DataFrame, text: str) -> DataFrame:
    """n, rows whose text occurs more than once, and their share; counts per text, no pairs."""
    per = df.groupBy(F.sha2(F.col(text), 256).alias("h")).agg(F.count("*").alias("k"))
    return per.agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_duplicated")).withColumn("share", F.try_divide(F.col("n_duplicated").cast("double"), "n"))


def stratified_sample(df: DataFrame, item: str, stratum: str, per_stratum: int, a: int = 1103515245, c: int = 15015, m: int = 2147483647) -> DataFrame:
    """The first rows of each stratum in the order of a congruential step of the id: the same at every call."""
    scored = df.withColumn("_s", scrambled(F.col(item), a, c, m))
    w = Window.partitionBy(stratum).orderBy("_s", item)
    return scored.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= per_stratum).drop("_s")
