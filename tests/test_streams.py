"""Streams end with what a batch over the same records gives."""

import datetime as dt

from pyspark.sql import functions as F

from quern.catalog import Database, column
from quern.streaming import streams
from quern.types import TableDef

SCHEMA = "id long, k string, ts timestamp, v double"
START = dt.datetime(2024, 1, 1)


def rows(n):
    return [(i % 30, "ab"[i % 2], START + dt.timedelta(seconds=20 * i), float(i)) for i in range(n)]


def test_rollup_equals_batch(spark, tmp_path):
    spark.createDataFrame(rows(60), SCHEMA).write.parquet(f"{tmp_path}/in")
    out = streams.rollup(streams.records(spark, f"{tmp_path}/in", SCHEMA), "ts", "v", "5m", keys=["k"])
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(f"{tmp_path}/in").groupBy("k", F.window("ts", "5 minutes").start.alias("bucket")).agg(F.avg("v").alias("avg"))
    got = {(r.k, r.bucket): r.avg for r in spark.table("rolled").collect()}
    assert got == {(r.k, r.bucket): r.avg for r in batch.collect()} and len(got) > 2


def test_duplicates_topics_and_gaps(spark, tmp_path):
    df = spark.createDataFrame(rows(60), SCHEMA)
    df.write.parquet(f"{tmp_path}/in")
    once = streams.without_duplicates(streams.records(spark, f"{tmp_path}/in", SCHEMA), ["id"], "ts", "1d")
    streams.to_files(once, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 30
    streams.publish(df.filter("v in (1, 2, 5)"), f"{tmp_path}/topics", 7, "v", F.col("k"))
    streams.publish(df.limit(2), f"{tmp_path}/topics", 8, "v", F.col("k"))
    seen = []
    streams.each_batch(streams.subscribe(spark, f"{tmp_path}/topics", 7), lambda b, _: seen.extend(r.seq for r in b.collect()), f"{tmp_path}/c2").awaitTermination()
    assert sorted(seen) == [1, 2, 5]
    gaps = streams.sequence_gaps(spark.read.parquet(f"{tmp_path}/topics").filter("topic = 7"))
    assert [tuple(r) for r in gaps.collect()] == [(7, 3, 5)]


def test_change_feed(spark, tmp_path):
    db = Database(spark, "feed", str(tmp_path))
    db.create_table(TableDef("t", (column("id", "INT", primary_key=True), column("x", "TEXT"))))
    db.insert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"))
    db.update("t", {"x": F.lit("c")}, F.col("id") == 1)
    db.delete("t", F.col("id") == 2)
    seen = []
    streams.each_batch(streams.changes(db, "t"), lambda b, _: seen.extend((r.seq, r.op, r.data) for r in b.collect()), f"{tmp_path}/c").awaitTermination()
    assert sorted(seen) == [(1, "INSERT", '{"id":1,"x":"a"}'), (1, "INSERT", '{"id":2,"x":"b"}'), (2, "UPDATE", '{"id":1,"x":"c"}'), (3, "DELETE", '{"id":2,"x":"b"}')]
    spark.createDataFrame([(1, "z"), (5, "e")], "id int, x string").write.parquet(f"{tmp_path}/in")
    streams.each_batch(streams.records(spark, f"{tmp_path}/in", "id int, x string"), streams.upsert_into(db, "t"), f"{tmp_path}/c3").awaitTermination()
    assert sorted((r.id, r.x) for r in db.df("t").collect()) == [(1, "c"), (5, "e")]


def test_expiry(spark):
    df = spark.createDataFrame([(1, START, 10), (2, START, 100), (3, START, 1000)], "id int, w timestamp, ttl long")
    now = F.lit(START + dt.timedelta(seconds=60))
    assert sorted(r.id for r in streams.unexpired(df, "w", "ttl", now).collect()) == [2, 3]
    assert [r.id for r in streams.ring(df, 1, "w", "ttl", now).collect()] == [3]
