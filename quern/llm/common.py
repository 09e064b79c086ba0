"""Shared pieces: table access, shared-folder materialisation, worker set-up."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; the path may be of any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's own 64 MB let a whole task's texts travel as one batch, held by the JVM and by Python at once.
BATCH_BYTES = 1 << 22


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where PYTHONPATH was not set for them; Arrow batches of at most about 4 MB.

    A session that sets smaller batches itself keeps them.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def release_memory() -> None:
    """Give what this worker has freed back to the system: workers are kept for later stages, and numpy and Arrow keep what they freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage like checkpoint(), survives lost executors, and stores
    columns compressed. Goes with the driver, like all of the scratch folder.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows (one map-side aggregate)."""
    row = docs.select(F.sum(F.octet_length(F.col(text_col)).cast("long")).alias("n")).first()
    return int(row["n"] or 0)


def null_free(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text column with null as the empty string."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def row_salted(df: DataFrame, *columns) -> DataFrame:
    """``columns`` and ``salt``, a long that differs between rows, equal ones too, and is the same when a task runs again."""
    try:
        # the place of the row in its file, where the table comes straight from Parquet files
        place = df.select("_metadata.file_path", "_metadata.row_index").schema
    except AnalysisException:
        place = None
    if place is not None and "_metadata" not in df.columns:
        return df.select(*columns, F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("salt"))
    return materialize(df.select(*columns, F.xxhash64(F.monotonically_increasing_id()).alias("salt")), "salted")
