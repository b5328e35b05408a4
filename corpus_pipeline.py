"""The corpus pipeline: each stage takes all that its predecessor kept.

Quality classifier, SimHash near-dedup, benchmark decontamination, secret scans, mixing
sources to target weights. Every stage but the last returns the columns of documents, extra ones too.

Edge cases, in every stage: an empty table stays empty; whole texts are read, however long. Null, empty and
very short texts: the classifier gives them about the share of good documents as score, so they stay; all texts without a word are near-duplicates of
each other in no case but exactly equal ones, of which one stays; they hold no benchmark window and no secret, and take no words in the mix.
Repeated rows: each is judged alike; near-dedup keeps one of them, the one with the smallest id (nulls last). Null ids are rows like others; a null
source is a source of its own. Names of internal columns never clash with those of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm._common import id_remainder, materialize, table
from tarnwell.llm.decontaminate import drop_contaminated
from tarnwell.llm.mixing import mix
from tarnwell.llm.quality import drop_low_quality, fit_quality, training_labels
from tarnwell.llm.secrets import drop_secrets
from tarnwell.llm.simhash import keep_one

MARK = "[secret]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels outside the held-out fold."""
    model = fit_quality(docs.filter(id_remainder("doc_id", 5) != 0), training_labels(table(spark, sf_dir, "labels")))
    return drop_low_quality(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    changed = F.contains("text", F.lit(MARK))
    return drop_secrets(docs, mark=MARK).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, rate, copies, taken."""
    return mix(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
]

#: The classifier stage is learned, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one written out before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
