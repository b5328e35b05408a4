"""Typed readers, format parity, fingerprints, manifests and sinks."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: under spark.checkpoint.dir, or of this machine where Spark runs on it alone."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarnwell-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_settled: list[tuple[SparkSession, str]] = []


def settled(df: DataFrame, name: str) -> DataFrame:
    """The table written to a scratch folder and read again, for tables that several jobs read: lineage is cut and survives lost executors. Removed when the driver ends."""
    spark, path = df.sparkSession, scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    _settled.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _settled:
        try:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # the JVM may have ended first
            return


def normalise(df: DataFrame) -> DataFrame:
    """Ingest policy: timestamps without zone are read as session-zone timestamps, NaN becomes null."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            out[f.name] = F.col(f"`{f.name}`").cast("timestamp")
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            out[f.name] = F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType))
    return df.withColumns(out) if out else df


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A known table from Parquet; an unknown name is an error before anything is read."""
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}")
    return normalise(spark.read.parquet(f"{root}/{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; empty fields are null and nothing is parsed as a date unless the schema says so."""
    reader = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_raw(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet if the table is there in that format, else CSV; never both."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return normalise(spark.read.parquet(f"{root}/{name}.parquet"))
    return normalise(read_csv(spark, f"{root}/{name}.csv", schema))


def cast_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns in the order and types of a schema; text that does not parse becomes null."""
    if df.columns != schema.names:
        raise ValueError(f"columns {df.columns} are not {schema.names}")
    return df.select([F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields])


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of either side, and rows that only one side has (repeats count). Both sides are brought together once, each distinct row with its repeats."""
    if left.columns != right.columns:
        raise ValueError(f"columns {left.columns} are not {right.columns}")
    side = lambda df, l, r: df.select("*", F.lit(l).cast("long").alias("_l"), F.lit(r).cast("long").alias("_r"))  # noqa: E731, E741
    rows = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*[f"`{c}`" for c in left.columns]).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    more = lambda a, b: F.greatest(F.col(a) - F.col(b), F.lit(0))
    sums = {"left_rows": F.col("_l"), "right_rows": F.col("_r"), "only_left": more("_l", "_r"), "only_right": more("_r", "_l")}
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])


def row_digest(df: DataFrame) -> F.Column:
    """SHA-256 of a row as JSON with sorted columns; nulls are written."""
    named = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def unordered_fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint) that does not depend on the order of rows: a sum, which tasks combine."""
    part = F.conv(F.substring("_d", 1, 15), 16, 10).cast("decimal(38,0)")
    return df.select(row_digest(df).alias("_d")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def ordered_fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """(n_rows, fingerprint) of the rows in the order of unique keys: each row's digest is taken with its predecessor's key."""
    from tarnwell.operators.ordering import with_position

    numbered = with_position(df, keys[0], ties=keys[1:], name="_at")
    mixed = F.sha2(F.concat_ws(":", F.col("_at").cast("string"), row_digest(df)), 256)
    part = F.conv(F.substring(mixed, 1, 15), 16, 10).cast("decimal(38,0)")
    return numbered.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("fingerprint"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of the files of a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_drift(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and status (same, changed, missing, unexpected) of files against a manifest (name, sha256)."""
    m = manifest.select("name", F.col("sha256").alias("expected"))
    status = F.when(F.col("expected").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").when(F.col("sha256") == F.col("expected"), "same").otherwise("changed")
    return found.join(m, "name", "full").select("name", status.alias("status"))


def write_table(df: DataFrame, path: str, kind: str = "parquet", once: bool = False) -> None:
    """Parquet, CSV or JSON; `once` refuses to touch what exists."""
    df.write.mode("errorifexists" if once else "overwrite").option("header", True).format(kind).save(path)


def request_key(*columns: str) -> F.Column:
    """Content address of a request: SHA-256 of its canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def uncached(requests: DataFrame, cache: DataFrame, *columns: str) -> DataFrame:
    """Requests whose content address the cache (column key) does not hold; equal requests once."""
    return requests.withColumn("key", request_key(*columns)).join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


@dataclass(frozen=True)
class Settings:
    """Choices that the operators take; every field has the canonical value as default."""

    horizon: str | None = None
    maturity_days: int = 7
    event_window_days: int = 30
    freshness_days: int = 30
    recommend: int = 5
    bands: tuple[float, ...] = (0.3, 0.7, 0.9)
    capacity: tuple[float, ...] = (0.05, 0.10, 0.20)
    geo_fit: tuple[float, ...] = (1.0, 0.85, 0.65)
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        """Settings from JSON; unknown names are an error."""
        given = json.loads(text)
        if unknown := set(given) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
