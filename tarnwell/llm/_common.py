"""Helpers that the corpus operators share: scratch tables, byte access, stable sampling."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the corpus contracts: maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on this machine only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            return own.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        root = "file://" + tempfile.mkdtemp(prefix="tarnwell-", dir="/tmp/checkpoints")
        spark.sparkContext.setCheckpointDir(root)
        _scratch.append((spark, root))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have ended first
            return


#: Spark's setting that drops the shuffle files of a query as soon as it has ended.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors.

    The shuffle files behind it are dropped once it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_DROP_SHUFFLES) if before is None else spark.conf.set(_DROP_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    drop_path(df.sparkSession, df._scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame, name: str) -> DataFrame:
    """The rows written out with a number of their own in column `name`, which stays the same however often they are read."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.large_binary()).to_pylist()


def id_remainder(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % modulus


def hash_fraction(*columns: str | Column) -> Column:
    """A stable number in [0, 1) for a row, from XXH64 of its columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / float(1 << 53)


def slices(lengths: list[int], most: int):
    """(first, last) ranges over consecutive items whose lengths sum to about `most` at most; one long item stands alone."""
    first, total = 0, 0
    for k, n in enumerate(lengths):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def lower_table() -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold
