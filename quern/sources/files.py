"""File sources and sinks, and access by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "json", "csv", "avro", "text")
#: Parquet codecs; the counterpart of compressed logs.
CODECS = ("snappy", "zstd", "lz4", "gzip", "none")


def read(spark: SparkSession, path: str, form: str = "parquet", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """A table of files. CSV and JSON need a schema, so that no pass over the data is spent on guessing one."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form}")
    if form in ("csv", "json") and schema is None:
        raise ValueError(f"{form} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(form).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", *, mode: str = "append", partition_by: tuple[str, ...] = (), codec: str = "zstd", **options) -> None:
    writer = df.write.mode(mode).options(**options)
    if form in ("parquet", "orc"):
        writer = writer.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(form).save(path)


def get(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def batch_get(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.filter(F.col(key).isin(values))


def key_range(df: DataFrame, key: str, start, end) -> DataFrame:
    """Rows with start <= key <= end."""
    return df.filter(F.col(key).between(start, end))


def write_time_partitions(df: DataFrame, path: str, ts: str, unit: str = "day", **how) -> None:
    """Files in one folder for each day (or hour, month) of the time column."""
    write(df.withColumn("time_part", F.date_format(F.date_trunc(unit, ts), {"hour": "yyyy-MM-dd-HH", "day": "yyyy-MM-dd", "month": "yyyy-MM"}[unit])), path, partition_by=("time_part",), **how)


def read_time_range(spark: SparkSession, path: str, ts: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """Records with start <= ts <= end; only the folders of that range are listed for reading."""
    size = {"hour": 13, "day": 10, "month": 7}[unit]
    name = lambda t: str(t).replace("T", " ").replace(" ", "-")[:size]
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path)
    part = F.date_format(F.col("time_part"), "yyyy-MM-dd") if unit == "day" and isinstance(rows.schema["time_part"].dataType, T.DateType) else F.col("time_part")
    kind = rows.schema[ts].dataType
    low, high = F.lit(name(start)), F.lit(name(end))
    bound = F.col("time_part").between(low.cast("date"), high.cast("date")) if isinstance(rows.schema["time_part"].dataType, T.DateType) else part.between(low, high)
    return rows.filter(bound & F.col(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind))).drop("time_part")


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement a row, made where the rows lie."""

    def literal(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType | T.BooleanType):
            shown = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            shown = F.concat(F.lit("["), F.concat_ws(", ", F.transform(c, lambda x: x.cast("string"))), F.lit("]"))
        else:
            shown = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(shown, F.lit("NULL"))

    head = f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *(literal(f) for f in df.schema.fields)), F.lit(");")).alias("statement"))


def export(df: DataFrame, table: str, path: str) -> None:
    insert_statements(df, table).write.mode("overwrite").text(path)


# ---- retention: whole folders go -----------------------------------------------


def time_partitions(spark: SparkSession, path: str) -> list[str]:
    """Names of the time partitions, oldest first; one listing of the folder, no data is read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return sorted(n.removeprefix("time_part=") for n in names if n.startswith("time_part="))


def _drop_partitions(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/time_part={name}"), True)
    return names


def drop_expired(spark: SparkSession, path: str, keep: str, now: str, unit: str = "day") -> list[str]:
    """Drop the partitions that end at or before ``now - keep``; their names."""
    from datetime import datetime, timedelta

    from ..functions.temporal import interval_micros

    bound = datetime.fromisoformat(now) - timedelta(microseconds=interval_micros(keep))

    def end(name: str) -> datetime:
        parts = [int(x) for x in name.split("-")]
        if unit == "month":
            return datetime(parts[0] + parts[1] // 12, parts[1] % 12 + 1, 1)
        return datetime(*parts) + (timedelta(hours=1) if unit == "hour" else timedelta(days=1))

    return _drop_partitions(spark, path, [n for n in time_partitions(spark, path) if end(n) <= bound])


def evict_oldest(spark: SparkSession, path: str, most: int) -> list[str]:
    """Drop the oldest partitions beyond ``most``; their names."""
    names = time_partitions(spark, path)
    return _drop_partitions(spark, path, names[: max(0, len(names) - most)])
