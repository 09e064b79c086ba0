"""Operators that Spark has no single call for, on odd rows."""

import random

import pyspark.sql.functions as F

from quern.operators import relational as R
from quern.plans import catalogue


def test_exact_percentile(spark):
    rng = random.Random(3)
    rows = [("one", 7.0), ("nulls", None), (None, 2.0), (None, 5.0), ("same", -3.0), ("same", -3.0), ("nan", float("nan")), ("nan", 1.0), ("gap", 1.0), ("gap", 100.0)]
    rows += [("many", rng.choice([round(rng.gauss(0, 50), 2), 4.5, None])) for _ in range(5000)] + [("wide", rng.uniform(-1e9, 1e9)) for _ in range(3001)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for p in (0.0, 0.25, 0.5, 0.999, 1.0):
        want = {r.k: str(r.e) for r in df.filter("v IS NOT NULL").groupBy("k").agg(F.percentile("v", p).alias("e")).collect()}
        for margin in (0.001, 0.0, 1.0):  # with poor cuts too
            assert {r.k: str(r.exact) for r in R.exact_percentile(df, "k", "v", p, margin=margin).collect()} == want
    assert not R.exact_percentile(df.limit(0), "k", "v").collect()


def test_approximations_are_not_kept_for_every_order(spark, tmp_path):
    rows = [(None, 1, 5.0), (None, 2, 5.0), ("E", None, None), ("E", None, None), *(("A", i, 100.0 + i % 3) for i in range(50))]
    spark.createDataFrame(rows, "l_returnflag string, l_orderkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalogue.QUERIES["agg_approx_distinct"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {(None, True, True), ("E", True, True), ("A", True, True)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    sketches = [line for line in plan.splitlines() if "approx" in line and "Aggregate" in line]
    assert sketches and not any("l_orderkey" in line.split("functions=")[0] for line in sketches)
