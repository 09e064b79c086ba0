"""Time-series operators: sampling, gap filling, moving aggregates, retention, rollups, codecs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import interval_micros, sql_interval, time_bucket
from ..session import scratch_dir

#: Buckets of one series that one task fills; longer series are cut and get what the cuts around hold.
CUT = 1 << 16


def sample_by(df: DataFrame, ts: str, values: Sequence[str], interval: str, *, keys: Sequence[str] = (), fill: str | float | None = None, align: str | None = None, how: Callable[[Column], Column] = F.avg) -> DataFrame:
    """(keys, ts, values): one aggregate a bucket, and empty buckets filled.

    fill: None leaves empty buckets out; 'null', 'prev', 'next', 'linear' or a
    number fills those between a series' first and last bucket.
    """
    micros = interval_micros(interval, bare="s")
    sampled = df.filter(F.col(ts).isNotNull()).groupBy(*keys, time_bucket(f"{micros}us", F.col(ts), align).alias(ts)).agg(*(how(F.col(v)).alias(v) for v in values))
    return sampled if fill is None else fill_gaps(sampled, ts, values, micros, keys=keys, fill=fill)


def fill_gaps(sampled: DataFrame, ts: str, values: Sequence[str], micros: int, *, keys: Sequence[str] = (), fill: str | float) -> DataFrame:
    """Every bucket between the first and last of each series.

    Each bucket that is there learns the next one and the nearest known values,
    and then unfolds into itself and the gap after it: no grid is joined, and
    only buckets with data are ever sorted.
    """
    kind = fill.lower() if isinstance(fill, str) else None
    if kind not in (None, "null", "prev", "next", "linear"):
        raise ValueError(f"unknown fill {fill!r}")
    wanted = list(values) if kind in ("prev", "next", "linear") else []
    near = _neighbours(sampled.select(*keys, ts, *values), ts, wanted, keys, micros)
    step = F.expr(f"INTERVAL {sql_interval(micros)}")
    unfolded = near.withColumn("__at", F.explode(F.sequence(F.col(ts), F.coalesce(F.col("__next") - step, F.col(ts)), step)))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")).cast("double")
    out = []
    for v in values:
        own = F.when(F.col("__at") == F.col(ts), F.col(v))
        before, after = F.col(f"__before_{v}"), F.col(f"__after_{v}")
        if kind is None:
            new = F.lit(float(fill))
        elif kind == "null":
            new = F.lit(None)
        elif kind == "prev":
            new = before["v"]
        elif kind == "next":
            new = after["v"]
        else:
            new = before["v"] + (after["v"] - before["v"]) * (seconds(F.col("__at")) - seconds(before["t"])) / (seconds(after["t"]) - seconds(before["t"]))
        out.append(F.coalesce(own, new).alias(v))
    return unfolded.select(*keys, F.col("__at").alias(ts), *out)


def _neighbours(df: DataFrame, ts: str, values: list[str], keys: Sequence[str], micros: int) -> DataFrame:
    """Adds ``__next``, the time of the next row, and for each value its last known (t, v) up to a row and first known after it.

    Every series is cut by time into tasks of ``CUT`` buckets; what the cuts
    around hold is carried over on the table of cuts.
    """
    known = {v: F.when(F.col(v).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(v).alias("v"))) for v in values}
    df = df.select("*", *(c.alias(f"__k_{v}") for v, c in known.items()))
    df = df.withColumn("__cut", F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(micros * CUT)).cast("bigint"))
    # what follows is read backwards: a frame that grows costs one step a row, one that shrinks a pass over it
    w = Window.partitionBy(*keys, "__cut").orderBy(ts)
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys, "__cut").orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1)
    near = {"__next": F.lead(ts).over(w)}
    for v in values:
        near |= {f"__before_{v}": F.last(f"__k_{v}", True).over(up), f"__after_{v}": F.last(f"__k_{v}", True).over(down)}
    out = df.select("*", *(c.alias(n) for n, c in near.items()))
    ends = df.groupBy(*keys, "__cut").agg(F.min(ts).alias("c__next"), *(f(f"__k_{v}").alias(f"c__{n}_{v}") for v in values for f, n in ((F.max, "before"), (F.min, "after"))))
    series = Window.partitionBy(*keys).orderBy("__cut")  # one row a cut of a series
    earlier, later = series.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("__cut")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(k).alias(f"c__key{i}") for i, k in enumerate(keys)), F.col("__cut").alias("c__cut"), F.last("c__next").over(later).alias("c__next"), *(F.last(f"c__before_{v}", True).over(earlier).alias(f"c__before_{v}") for v in values), *(F.last(f"c__after_{v}", True).over(later).alias(f"c__after_{v}") for v in values))
    same = F.col("__cut") == F.col("c__cut")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"c__key{i}"))
    return out.join(carried, same).withColumns({n: F.coalesce(n, f"c{n}") for n in near})


# ---- windows over long series, in bounded tasks -----------------------------

#: Rows of one task.
BLOCK = 1 << 16


def _equal(keys: Sequence[str]) -> Column:
    """Join condition with the renamed keys of a table of starts; null keys are equal."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return out


def _renamed(keys: Sequence[str]) -> list[Column]:
    return [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]


def numbered(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "__row") -> DataFrame:
    """Adds each row's number from 0 in ascending order, within its keys if there are any; ties in any order.

    Rows are stored once, dealt by ranges of keys and order, so that a series
    spreads over as many tasks as it needs. They are numbered within their
    range, and ranges start where a series' ranges before them end.
    """
    path = f"{scratch_dir(df.sparkSession)}/ranges-{uuid.uuid4().hex}"
    df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    stored = df.sparkSession.read.parquet(path)
    sizes = stored.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a series
    starts = sizes.select(*_renamed(keys), F.col("__part").alias("__own"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = stored.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
    joined = within.join(starts, _equal(keys) & (F.col("__part") == F.col("__own")))
    return joined.select(*df.columns, (F.col("__start") + F.col("__n") - 1).alias(name))


def _blocks(df: DataFrame, order: Sequence[str], keys: Sequence[str], before: int) -> tuple[DataFrame, Window]:
    """Rows by blocks, each with ``before`` rows of the block before it (where ``__own`` is false), and a block's window."""
    size = max(BLOCK, before)
    rows = numbered(df, order, keys)
    own = F.floor(F.col("__row") / size)
    last = F.pmod(F.col("__row"), F.lit(size)) >= size - before
    to = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    out = rows.withColumn("__block", F.explode(to)).withColumn("__own", F.col("__block") == own)
    return out, Window.partitionBy(*keys, "__block").orderBy("__row")


def _only_own(df: DataFrame) -> DataFrame:
    return df.filter("__own").drop("__own", "__block", "__row")


def _carried(df: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """Adds ``__before``, the sum of ``value`` over all earlier blocks of the series."""
    sums = df.groupBy(*keys, "__block").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = sums.select(*_renamed(keys), F.col("__block").alias("__at"), F.sum("__sum").over(earlier).alias("__before"))
    return df.join(starts, _equal(keys) & (F.col("__block") == F.col("__at"))).drop("__at", *(f"__key{i}" for i in range(len(keys))))


def moving(df: DataFrame, value: str, n: int, order: Sequence[str], *, keys: Sequence[str] = (), how: Callable[[Column], Column] = F.avg, name: str | None = None, bounded: bool | None = None) -> DataFrame:
    """Aggregate of each row and the n - 1 before it.

    bounded: in blocks of at most ``BLOCK`` rows a task. That is the way of
    windows without keys; with keys it is for series of very many rows.
    """
    name = name or f"moving_{value}"
    if keys if bounded is None else not bounded:
        return df.withColumn(name, how(F.col(value)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)))
    df, w = _blocks(df, order, keys, n - 1)
    return _only_own(df.withColumn(name, how(F.col(value)).over(w.rowsBetween(1 - n, 0))))


def between(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows in the closed time range; the filter reaches the scan."""
    return df.filter(F.col(ts).between(F.lit(start).cast(df.schema[ts].dataType), F.lit(end).cast(df.schema[ts].dataType)))


def records_in_window(df: DataFrame, ts: str, start, end, most: int) -> DataFrame:
    """The first ``most`` records of a time range, oldest first."""
    return between(df, ts, start, end).orderBy(ts).limit(most)


def latest(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(ts), *(F.desc(t) for t in ties)).limit(n)


def window_aggregates(df: DataFrame, ts: str, value: str, start, end, interval: str) -> DataFrame:
    """(window_start, sum, avg, min, max, count) of each tumbling window in the range, in order."""
    x = F.col(value)
    found = between(df, ts, start, end).groupBy(time_bucket(interval, F.col(ts)).alias("window_start"))
    return found.agg(F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"), F.count(x).alias("count")).orderBy("window_start")


def range_aggregate(df: DataFrame, ts: str, value: str, start, end) -> DataFrame:
    x = F.col(value)
    return between(df, ts, start, end).agg(F.count(x).alias("count"), F.sum(x).alias("sum"), F.avg(x).alias("avg"), F.min(x).alias("min"), F.max(x).alias("max"))


def sliding(df: DataFrame, ts: str, size: str, slide: str, *aggs: Column, keys: Sequence[str] = ()) -> DataFrame:
    w = F.window(ts, sql_interval(interval_micros(size)), sql_interval(interval_micros(slide)))
    return df.groupBy(*keys, w.alias("w")).agg(*aggs).withColumn("window_start", F.col("w.start")).withColumn("window_end", F.col("w.end")).drop("w")


def sessions(df: DataFrame, ts: str, gap: str, *aggs: Column, keys: Sequence[str] = ()) -> DataFrame:
    w = F.session_window(ts, sql_interval(interval_micros(gap)))
    return df.groupBy(*keys, w.alias("w")).agg(*aggs).withColumn("session_start", F.col("w.start")).withColumn("session_end", F.col("w.end")).drop("w")


# ---- retention -------------------------------------------------------------


def retain_time(df: DataFrame, ts: str, keep: str, now) -> DataFrame:
    """Records younger than ``keep`` at ``now``."""
    return df.filter(F.col(ts) > F.lit(now).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {sql_interval(interval_micros(keep))}"))


def retain_count(df: DataFrame, ts: str, n: int, *, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """The newest n records, of each key if keys are given."""
    order = [F.desc(ts), *(F.desc(t) for t in ties)]
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def retain(df: DataFrame, ts: str, *, keep: str | None = None, now=None, n: int | None = None, keys: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """By time, by count, or both."""
    out = df if keep is None else retain_time(df, ts, keep, now)
    return out if n is None else retain_count(out, ts, n, keys=keys, ties=ties)


# ---- rollups: sums and counts merge, so averages stay true ------------------


def rollup(df: DataFrame, ts: str, value: str, interval: str, keys: Sequence[str] = ()) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*keys, time_bucket(interval, F.col(ts)).alias("bucket")).agg(F.sum(x).alias("sum"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"))


def merge_rollups(*parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One rollup of the union of what the parts were made from."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys, "bucket").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"))


def coarsen(rolled: DataFrame, interval: str, keys: Sequence[str] = ()) -> DataFrame:
    """A rollup of wider buckets from a finer one, without the records."""
    wide = rolled.withColumn("bucket", time_bucket(interval, F.col("bucket")))
    return merge_rollups(wide, keys=keys)


def with_average(rolled: DataFrame) -> DataFrame:
    return rolled.withColumn("avg", F.try_divide("sum", "count"))


# ---- codecs ----------------------------------------------------------------


def delta(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "delta", *, bounded: bool | None = None) -> DataFrame:
    """Difference to the row before; the first row keeps its value. ``bounded`` as in ``moving``."""
    step = lambda w: F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0).cast(df.schema[value].dataType))
    if keys if bounded is None else not bounded:
        return df.withColumn(name, step(Window.partitionBy(*keys).orderBy(*order)))
    rows, w = _blocks(df, order, keys, 1)
    return _only_own(rows.withColumn(name, step(w)))


def undelta(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "value", *, bounded: bool | None = None) -> DataFrame:
    """Running sums, which undo ``delta``. ``bounded`` as in ``moving``."""
    if keys if bounded is None else not bounded:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows, w = _blocks(df, order, keys, 0)
    own = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.when(F.col("__before").isNull(), F.col("__run")).otherwise(F.col("__before") + F.coalesce("__run", F.lit(0)))
    return _only_own(_carried(rows.withColumn("__run", own), F.col(value), keys).withColumn(name, total).drop("__run", "__before"))


def delta_of_delta(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), name: str = "delta2") -> DataFrame:
    return delta(delta(df, value, order, keys, "__d"), "__d", order, keys, name).drop("__d")


def run_lengths(df: DataFrame, value: str, order: Sequence[str], keys: Sequence[str] = (), *, bounded: bool | None = None) -> DataFrame:
    """(keys, run, value, length, first): runs of equal neighbours, first by order. ``bounded`` as in ``moving``."""
    new = lambda w: (~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)).cast("bigint")
    if keys if bounded is None else not bounded:
        w = Window.partitionBy(*keys).orderBy(*order)
        marked = df.withColumn("run", F.sum(new(w)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows, w = _blocks(df, order, keys, 1)
        running = rows.withColumn("__new", new(w)).filter("__own").withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        marked = _carried(running, F.col("__new"), keys).withColumn("run", F.col("__run") + F.coalesce("__before", F.lit(0)))
    return marked.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"), F.min(order[0]).alias("first"))


def expand_runs(runs: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, run, nth, value) of every element of the runs."""
    return runs.select(*keys, "run", F.explode(F.sequence(F.lit(1).cast("bigint"), "length")).alias("nth"), value)
