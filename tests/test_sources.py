"""Files, exports and operators that the registered queries do not reach."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.operators import timeseries as TS
from quern.operators import vector_index as VI
from quern.operators import vector_search as VS
from quern.sources import files

START = dt.datetime(2024, 1, 1)
ROWS = [(i, "ab"[i % 2], START + dt.timedelta(hours=5 * i), float(i)) for i in range(40)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id int, k string, ts timestamp_ntz, v double")


def test_formats(spark, df, tmp_path):
    for form in ("parquet", "orc", "json", "csv"):
        files.write(df, f"{tmp_path}/{form}", form)
        schema = df.schema if form in ("csv", "json") else None
        assert files.read(spark, f"{tmp_path}/{form}", form, schema).orderBy("id").collect() == df.collect()
    with pytest.raises(ValueError, match="schema"):
        files.read(spark, f"{tmp_path}/csv", "csv")
    assert [r.id for r in files.batch_get(df, "id", [3, 99]).collect()] == [3]
    assert files.key_range(df, "id", 3, 5).count() == 3 and files.get(df, "id", 7).count() == 1


def test_time_partitions(spark, df, tmp_path):
    files.write_time_partitions(df, f"{tmp_path}/t", "ts")
    found = files.read_time_range(spark, f"{tmp_path}/t", "ts", "2024-01-02 00:00:00", "2024-01-03 23:00:00")
    assert sorted(r.id for r in found.collect()) == [i for i, _, t, _ in ROWS if dt.datetime(2024, 1, 2) <= t <= dt.datetime(2024, 1, 3, 23)]
    assert "PartitionFilters: [isnotnull(time_part" in found._jdf.queryExecution().toString()


def test_insert_statements(spark):
    rows = spark.createDataFrame([(1, "it's", None, [1.0, 2.0])], "a int, b string, c double, d array<double>")
    assert files.insert_statements(rows, "t").first()[0] == "INSERT INTO t (a, b, c, d) VALUES (1, 'it''s', NULL, [1.0, 2.0]);"


def test_codecs_round_trip(df):
    coded = TS.delta(df, "id", ["ts"], ["k"])
    assert TS.undelta(coded, "delta", ["ts"], ["k"], "back").filter("back <> id").isEmpty()
    runs = TS.run_lengths(df.withColumn("v", F.floor(F.col("id") / 7)), "v", ["ts"])
    assert [(r.v, r.length) for r in runs.orderBy("run").collect()] == [(0, 7), (1, 7), (2, 7), (3, 7), (4, 7), (5, 5)]
    assert TS.expand_runs(runs, "v").count() == 40


def test_fill_across_cuts(spark, monkeypatch):
    """A series longer than one cut is filled as if it were whole."""
    monkeypatch.setattr(TS, "CUT", 4)
    rows = [(START + dt.timedelta(minutes=m), float(m)) for m in (0, 1, 15, 16, 33)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    out = {(r.ts - START).seconds // 60: r.v for r in TS.sample_by(df, "ts", ["v"], "1m", fill="linear").collect()}
    assert out == pytest.approx({m: float(m) for m in range(34)})
    out = {(r.ts - START).seconds // 60: r.v for r in TS.sample_by(df, "ts", ["v"], "1m", fill="prev").collect()}
    assert [out[m] for m in (0, 14, 15, 32, 33)] == [0, 1, 15, 16, 33]


def test_asof_tolerance_and_salt(spark, df):
    right = df.filter("id % 4 = 0").select("k", "ts", F.col("v").alias("w"))
    out = {r.id: r.w for r in R.asof_join(df, right, "ts", ["k"], ["w"], tolerance="11 HOURS").collect()}
    assert out[4] == 4.0 and out[6] == 4.0 and out[1] is None
    assert R.salted_join(df, right.drop("ts"), ["k"], 4).count() == df.join(right.drop("ts"), "k").count()


def test_insert_duplicate(df):
    with pytest.raises(R.DuplicateKey):
        R.insert(df, df.limit(1), ["id"])
    assert R.insert(df, df.withColumn("id", F.col("id") + 100), ["id"]).count() == 80


def test_quantizers(spark):
    vectors = spark.createDataFrame([(i, [((i * 37 + j * 11) % 19 - 9) / 9.0 for j in range(8)]) for i in range(200)], "id int, v array<double>")
    query = [0.5, -0.5] * 4
    exact = [r.id for r in VS.knn(vectors, "v", query, 5, ties=("id",)).collect()]
    assert [r.id for r in VS.binary_knn(vectors, "v", query, 5, shortlist=150, ties=("id",)).collect()] == exact
    index = VI.IvfIndex(vectors, "v", lists=4)
    assert [r.id for r in index.search(query, 5, probes=4, ties=("id",)).collect()] == exact
    back = vectors.select(F.transform(F.arrays_zip("v", VS.scalar_restore(VS.scalar_quantize(F.col("v"), -1, 1), -1, 1).alias("w")), lambda p: F.abs(p["v"] - p["w"])).alias("d"))
    assert back.filter(F.array_max("d") > 0.005).isEmpty()


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_windows_in_blocks(spark, monkeypatch, keys):
    """Numbers, moving averages, deltas, sums and runs over many small blocks equal those of one window."""
    monkeypatch.setattr(TS, "BLOCK", 16)
    rows = [(k, None if k % 11 == 0 else k * k % 97, f"n{k % 300:03d}", k // 5 % 3, None if k % 4 == 0 else k % 2) for k in range(300)] + [(None, 5, "a", 1, 1)]
    df = spark.createDataFrame(rows, "id int, x int, name string, v int, g int").repartition(7)
    whole = Window.partitionBy(*keys).orderBy("id")
    same = lambda a, b: sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    for order in ("id", "name"):
        want = df.withColumn("__row", (F.row_number().over(Window.partitionBy(*keys).orderBy(order, "id")) - 1).cast("long"))
        assert same(TS.numbered(df, [order, "id"], keys), want)
    for n in (1, 4, 40):
        assert same(TS.moving(df, "x", n, ["id"], keys=keys, name="m", bounded=True), df.withColumn("m", F.avg("x").over(whole.rowsBetween(1 - n, 0))))
    assert same(TS.delta(df, "x", ["id"], keys, bounded=True), df.withColumn("delta", F.col("x") - F.coalesce(F.lag("x").over(whole), F.lit(0))))
    assert same(TS.undelta(df, "x", ["id"], keys, name="s", bounded=True), df.withColumn("s", F.sum("x").over(whole.rowsBetween(Window.unboundedPreceding, 0))))
    assert same(TS.run_lengths(df, "v", ["id"], keys, bounded=True), TS.run_lengths(df, "v", ["id"], keys, bounded=False))


def test_keyed_series_are_cut_too(spark, monkeypatch):
    """Gaps of keyed series, across cuts that hold nothing, and for a null key."""
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(k, at(m), v) for k in ("a", None) for m, v in ((0, 1.0), (1, None), (2, 3.0), (40, None), (41, 10.0))] + [("b", at(7), 2.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    want = None
    for cut in (1 << 16, 4):
        monkeypatch.setattr(TS, "CUT", cut)
        out = {fill: sorted(map(tuple, TS.fill_gaps(df, "ts", ["v"], 60_000_000, keys=["k"], fill=fill).collect()), key=repr) for fill in ("prev", "next", "linear", "null")}
        assert want is None or out == want
        want = out
    assert len(want["prev"]) == 42 * 2 + 1 and ("a", at(30), 3.0) in want["prev"] and (None, at(30), 10.0) in want["next"]
