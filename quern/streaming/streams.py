"""Streams over files of records or changes; sinks are any of Spark's.

Sources are folders that writers append Parquet parts to. Offsets, retries and
exactly-once bookkeeping are the checkpoint's; event time and watermarks bound
all state.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import CHANGE_SCHEMA, Database
from ..functions.temporal import interval_micros, sql_interval

ALL_TOPICS = 0xFFFF
MESSAGE_SCHEMA = "topic int, seq long, published timestamp, payload binary"


def records(spark: SparkSession, path: str, schema, **options) -> DataFrame:
    """New records of a folder, or the records of one file, as a stream."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place) and files.getFileStatus(place).isFile():
        path, options = place.getParent().toString(), options | {"pathGlobFilter": place.getName()}
    return spark.readStream.options(**options).schema(schema).parquet(path)


def changes(db: Database, table: str | None = None) -> DataFrame:
    """The change feed of a database, or of one table: (seq, op, table_name, data)."""
    feed = db.spark.readStream.schema(CHANGE_SCHEMA).parquet(db.feed_path)
    return feed if table is None else feed.filter(F.col("table_name") == table.lower())


def publish(df: DataFrame, path: str, topic: int, seq: str, payload: Column) -> None:
    """Append messages of one topic; ``seq`` numbers them within the topic."""
    out = df.select(F.lit(topic).alias("topic"), F.col(seq).cast("long").alias("seq"), F.current_timestamp().alias("published"), payload.cast("binary").alias("payload"))
    out.write.mode("append").parquet(path)


def subscribe(spark: SparkSession, path: str, topic: int = ALL_TOPICS) -> DataFrame:
    """Messages of a topic, or of all."""
    rows = records(spark, path, MESSAGE_SCHEMA)
    return rows if topic == ALL_TOPICS else rows.filter(F.col("topic") == topic)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Calls ``handle`` with every micro-batch; with ``once`` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_files(stream: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def without_duplicates(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """First record of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(ts, sql_interval(interval_micros(late))).dropDuplicatesWithinWatermark(list(keys))


def sequence_gaps(messages: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """(keys, expected, got) wherever a topic's numbers skip (batch side: what to ask for again)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("seq")
    seen = messages.dropDuplicates([*keys, "seq"]).withColumn("expected", F.lag("seq").over(w) + 1)
    return seen.filter("seq > expected").select(*keys, "expected", F.col("seq").alias("got"))


def resend(log: DataFrame, received: DataFrame, keys: Sequence[str] = ("topic",)) -> DataFrame:
    """What a follower asks for again: published messages that lie in its gaps. Duplicates do not matter."""
    gaps = sequence_gaps(received, keys)
    wanted = gaps.select(*keys, F.explode(F.sequence(F.col("expected"), F.col("got") - 1)).alias("seq"))
    return log.join(wanted, [*keys, "seq"], "left_semi")


def rollup(stream: DataFrame, ts: str, value: str, interval: str, *, keys: Sequence[str] = (), late: str = "10m", slide: str | None = None) -> DataFrame:
    """Running sum, count, min, max and true average of each window and key."""
    sizes = [sql_interval(interval_micros(x)) for x in ([interval, slide] if slide else [interval])]
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, sql_interval(interval_micros(late)))
    x = F.col(value)
    found = timed.groupBy(*keys, F.window(ts, *sizes).alias("w")).agg(F.sum(x).alias("sum"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"))
    return found.select(*keys, F.col("w.start").alias("bucket"), "sum", "count", "min", "max", "avg")


def sessions(stream: DataFrame, ts: str, gap: str, *, keys: Sequence[str] = (), late: str = "10m") -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, sql_interval(interval_micros(late)))
    found = timed.groupBy(*keys, F.session_window(ts, sql_interval(interval_micros(gap))).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def latest_by_key(stream: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], *, ttl: str) -> DataFrame:
    """Newest values of each key within windows of ``ttl``; state older than that expires with the watermark."""
    span = sql_interval(interval_micros(ttl))
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, span)
    newest = F.max(F.struct(F.col(ts), *(F.col(v) for v in values))).alias("x")
    return timed.groupBy(*keys, F.window(ts, span).alias("w")).agg(newest).select(*keys, "x.*")


def unexpired(df: DataFrame, written: str, ttl_seconds: str, now: Column | None = None) -> DataFrame:
    """Entries whose time to live has not run out."""
    at = F.current_timestamp() if now is None else now
    return df.filter(F.unix_micros(F.col(written).cast("timestamp")) + F.col(ttl_seconds) * 1_000_000 > F.unix_micros(at.cast("timestamp")))


def ring(df: DataFrame, slots: int, written: str, ttl_seconds: str, now: Column | None = None) -> DataFrame:
    """What a buffer of ``slots`` keeps: unexpired entries, those with the longest time left first."""
    left = F.unix_micros(F.col(written).cast("timestamp")) + F.col(ttl_seconds) * 1_000_000
    return unexpired(df, written, ttl_seconds, now).orderBy(left.desc()).limit(slots)


def upsert_into(db: Database, table: str) -> Callable[[DataFrame, int], None]:
    """A batch handler that adds the batch's rows to a table and skips keys it holds."""

    def handle(batch: DataFrame, _: int) -> None:
        db.insert(table, batch, ignore=True)

    return handle
