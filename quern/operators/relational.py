"""Verbs that Spark has no single call for. Mutations return the new table; nothing changes in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class DuplicateKey(ValueError):
    """A row of the same key exists."""


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus those new rows whose key it lacks; of equal new keys one stays."""
    new = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti").select(*target.columns)
    return target.unionByName(new)


def insert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the new rows; DuplicateKey if a key would repeat."""
    if keys:
        twice = rows.groupBy(*keys).count().filter("count > 1").select(*keys)
        if not twice.union(rows.join(target, keys, "left_semi").select(*keys)).isEmpty():
            raise DuplicateKey(", ".join(keys))
    return target.unionByName(rows.select(*target.columns))


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace rows of the same key, or are added."""
    return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def update(target: DataFrame, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """SET on rows where the condition is true; all right sides see the old row."""
    hit = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    kinds = dict(target.dtypes)
    return target.select(*(F.when(hit, changes[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in target.columns))


def delete(target: DataFrame, condition: Column | None = None) -> DataFrame:
    """Without the rows where the condition is true."""
    return target.limit(0) if condition is None else target.filter(~F.coalesce(condition, F.lit(False)))


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], *, suffix: str = "", tolerance: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it.

    Both sides meet in one sorted window by key, so the cost is one shuffle and
    a sort, never a range join.
    """
    pad = F.struct(F.col(on).alias("at"), *(F.col(v) for v in values))
    kind = right.select(pad.alias("r")).schema["r"].dataType
    one = left.select(*(F.col(k).alias(f"__{k}") for k in by), F.col(on).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(kind).alias("__r"))
    two = right.select(*(F.col(k).alias(f"__{k}") for k in by), F.col(on).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(one.schema["__left"].dataType).alias("__left"), pad.alias("__r"))
    order = Window.partitionBy(*(f"__{k}" for k in by)).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = one.unionByName(two).withColumn("__r", F.last("__r", ignorenulls=True).over(order)).filter("__side = 1")
    near = F.lit(True) if tolerance is None else F.col("__at") - F.col("__r.at") <= F.expr(f"INTERVAL {tolerance}")
    return seen.select("__left.*", *(F.when(near, F.col(f"__r.{v}")).alias(f"{v}{suffix}") for v in values))


def interval_join(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= point < end, by an equi-join on cells of ``width``.

    A range is repeated for each cell it meets, so choose a width near the usual
    range length.
    """
    cell = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    left = points.withColumn("__cell", cell(F.col(point).cast("double")))
    right = ranges.withColumn("__cell", F.explode(F.sequence(cell(F.col(start).cast("double")), cell(F.col(end).cast("double")))))
    return left.join(right, "__cell").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__cell")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows; plans as TakeOrderedAndProject, not as a full sort."""
    return df.orderBy(*order).limit(k)


def top_k_by(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """First k rows of each key; Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def exact_percentile(df: DataFrame, key: str, value: str, p: float = 0.5, *, margin: float = 0.001) -> DataFrame:
    """(key, exact): the interpolated percentile of each key's values, as Spark's ``percentile`` gives it; nulls aside.

    Approximate percentiles beside ``p`` cut a key's values in three parts. Counts of the
    parts tell which of them hold the wanted ranks, and only those, about 2 * ``margin`` of
    the rows, are counted by value and summed in order. Poor cuts make a part larger, never
    the result wrong. The few rows a key of the cuts and of the parts are broadcast.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    cuts = rows.groupBy("k").agg(F.percentile_approx("v", [max(p - margin, 0.0), min(p + margin, 1.0)]).alias("cut")).select(F.col("k").alias("cut_k"), "cut")
    part = F.when(F.col("v") < F.col("cut")[0], 0).when(F.col("v") <= F.col("cut")[1], 1).otherwise(2)
    parted = rows.join(F.broadcast(cuts), F.col("k").eqNullSafe(F.col("cut_k"))).select("k", "v", part.alias("part"))
    of_key = Window.partitionBy("k")
    counts = parted.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("after", F.sum("n").over(of_key.orderBy("part"))).withColumn("place", (F.sum("n").over(of_key) - 1) * F.lit(p))
    low, high = F.floor("place"), F.ceil("place")
    holds = lambda at, n: (at >= F.col("after") - F.col(n)) & (at < F.col("after"))
    wanted = counts.filter(holds(low, "n") | holds(high, "n")).select(F.col("k").alias("part_k"), F.col("part").alias("of"), (F.col("after") - F.col("n")).alias("before"), "place")
    chosen = parted.join(F.broadcast(wanted), F.col("k").eqNullSafe(F.col("part_k")) & (F.col("part") == F.col("of")))
    values = chosen.groupBy("k", "part", "before", "place", "v").agg(F.count(F.lit(1)).alias("m"))
    values = values.withColumn("after", F.col("before") + F.sum("m").over(Window.partitionBy("k", "part").orderBy("v")))
    ends = values.groupBy("k").agg(F.first("place").alias("place"), F.max(F.when(holds(low, "m"), F.col("v"))).alias("a"), F.max(F.when(holds(high, "m"), F.col("v"))).alias("b"))
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    return ends.select(F.col("k").alias(key), F.when(low == high, F.col("a")).otherwise(between).alias("exact"))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Inner equi-join that spreads each key of a skewed left side over ``salts`` tasks."""
    one = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    two = right.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return one.join(two, [*keys, "__salt"]).drop("__salt")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
