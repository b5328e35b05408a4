"""Text rules, sentence statistics and deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions import scalars as X
from tarnwell.operators import textrules as R
from tarnwell.plans.registry import query
from tarnwell.sources.tables import load_table

_FOLD = "translate(lower(text), 'áéíóúüñ', 'aeiouun')"


@query(f"""SELECT doc_id, {_FOLD} LIKE '%license%' AS licensed, {_FOLD} LIKE '%cion%' AS folded, length(text) AS n FROM documents""")
def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load_table(spark, d, "documents").select("doc_id", X.mentions(t, ["license"]).alias("licensed"), X.mentions(t, ["cion"]).alias("folded"), F.length(t).cast("long").alias("n"))


def _listings(spark: SparkSession, d: str) -> DataFrame:
    """Parts dressed as listings: text that claims, attributes that may deny it."""
    p = load_table(spark, d, "part")
    k = F.col("p_partkey")
    copy = F.element_at(F.array(F.lit("Oficina con buena iluminación natural. Lista."), F.lit("Bodega con seguridad 24/7 y control de acceso. Amplia."), F.lit("Local con estacionamiento propio."), F.lit("Recién remodelado. Cuenta con todos los servicios."), F.lit("Espacio amplio.")), (k % 5 + 1).cast("int"))
    return p.select(
        k.alias("spot_id"), F.lit("Espacio").alias("title"), copy.alias("description"), (k % 3 == 0).alias("natural_light"), F.when(k % 4 == 0, "none").when(k % 4 == 1, "guard").alias("security_type"),
        F.when(k % 2 == 0, 0).otherwise(2).alias("parking_spaces"), F.when(k % 3 == 1, "needs_renovation").otherwise("good").alias("building_status"), F.when(k % 7 == 0, '["Parking","gym"]').otherwise("[]").alias("amenities"),
        F.element_at(F.array(F.lit("Land"), F.lit("Retail"), F.lit("Office")), (k % 3 + 1).cast("int")).alias("sector_name"),
    )


@query("""SELECT rule_id, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 5 = 0 AND p_partkey % 3 <> 0 THEN 'R001' WHEN p_partkey % 5 = 1 AND p_partkey % 4 <> 1 THEN 'R002' WHEN p_partkey % 5 = 2 AND p_partkey % 2 = 0 AND p_partkey % 7 <> 0 THEN 'R003' WHEN p_partkey % 5 = 3 AND p_partkey % 3 = 1 THEN 'R004' END AS rule_id FROM part) WHERE rule_id IS NOT NULL GROUP BY 1""")
def text_contradictions(spark: SparkSession, d: str) -> DataFrame:
    return R.contradictions(_listings(spark, d), "spot_id").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""SELECT pattern_id, count(*) AS n FROM (SELECT 'S001' AS pattern_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 IN (0, 3) UNION ALL SELECT 'S003' FROM part WHERE p_partkey % 5 = 1 AND p_partkey % 4 <> 1 UNION ALL SELECT 'NV_all_services' FROM part WHERE p_partkey % 5 = 3) GROUP BY 1""")
def text_observations(spark: SparkSession, d: str) -> DataFrame:
    return R.observations(_listings(spark, d), "spot_id").groupBy("pattern_id").agg(F.count("*").alias("n"))


@query("""SELECT CAST(sum(k) AS BIGINT) AS n, CAST(coalesce(sum(k) FILTER (WHERE k > 1), 0) AS BIGINT) AS n_duplicated, round(coalesce(sum(k) FILTER (WHERE k > 1), 0) / CAST(sum(k) AS DOUBLE), 6) AS share FROM (SELECT count(*) AS k FROM documents GROUP BY text)""")
def exact_duplication(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_duplication(load_table(spark, d, "documents"), "text").select("n", "n_duplicated", F.round("share", 6).alias("share"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(trim(text), '\.[ \t\n\x0B\f\r]+', '.' || chr(1), 'g'), chr(1))) AS sentence FROM documents), p AS (SELECT sentence, doc_id, count(*) AS k FROM s WHERE sentence <> '' GROUP BY ALL)
SELECT sentence, count(*) AS n_rows, CAST(sum(k) AS BIGINT) AS n_occurrences FROM p GROUP BY 1 HAVING count(*) >= 2""")
def repeated_sentences(spark: SparkSession, d: str) -> DataFrame:
    return R.sentence_frequency(load_table(spark, d, "documents"), "text")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (CAST(o_orderkey AS HUGEINT) * 1103515245 + 15015) % 2147483647, o_orderkey) AS sample_rank FROM orders) SELECT o_orderkey, o_orderpriority, CAST(sample_rank AS INT) AS sample_rank FROM r WHERE sample_rank <= 25""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """25 rows a stratum in the order of a congruential step of the id; the limit is the feature."""
    return R.stratified_sample(load_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 25)


@query("""WITH c AS (SELECT role, count(*) AS n, count(DISTINCT conv_id) AS convs, round(avg(length(text)), 4) AS mean_chars FROM conversations GROUP BY 1) SELECT * FROM c""")
def conversation_mix(spark: SparkSession, d: str) -> DataFrame:
    return load_table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("convs"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"))


@query("""SELECT doc_id, sha256(strip_accents(lower(text))) AS folded_sha256, CAST(length(strip_accents(lower(text))) AS BIGINT) AS n FROM documents""")
def folded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts in lower case without accents, as digests."""
    t = X.fold_text(F.col("text"))
    return load_table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("folded_sha256"), F.length(t).cast("long").alias("n"))
