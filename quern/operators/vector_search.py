"""Vector search: exact top-k, range and hybrid filters, and optional approximate indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

MEASURES = {"l2": V.l2, "ip": V.inner_product, "cosine": V.cosine}


def knn(df: DataFrame, column: str, query: list[float], k: int, *, metric: str = "l2", where: Column | None = None, ties: tuple[str, ...] = (), name: str = "distance") -> DataFrame:
    """The k nearest rows, nearest first: smallest L2, largest inner product or cosine.

    A scalar filter is applied before any distance is computed; the plan is
    one scan with TakeOrderedAndProject.
    """
    rows = df if where is None else df.filter(where)
    scored = rows.withColumn(name, MEASURES[metric](F.col(column), V.literal(query)))
    return scored.orderBy(F.asc(name) if metric == "l2" else F.desc(name), *ties).limit(k)


def within(df: DataFrame, column: str, query: list[float], bound: float, *, metric: str = "l2", where: Column | None = None, name: str = "distance") -> DataFrame:
    """Rows within an L2 distance, or of at least a similarity."""
    rows = df if where is None else df.filter(where)
    scored = rows.withColumn(name, MEASURES[metric](F.col(column), V.literal(query)))
    return scored.filter(F.col(name) < bound if metric == "l2" else F.col(name) >= bound)


def _reach(near: DataFrame, k: int) -> Column:
    """Distance of the last of k found rows, with room for rounding; null where fewer have one."""
    return near.agg(F.when(F.count("distance") == k, F.max("distance") * (1 + 1e-9) + 1e-9).alias("reach")).scalar()


def binary_code(v: Column) -> Column:
    """Signs of up to 64 components as bits of a bigint."""
    bits = F.transform(v.cast("array<double>"), lambda x, i: F.when(x > 0, F.expr("shiftleft(1L, 0)")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def binary_knn(df: DataFrame, column: str, query: list[float], k: int, *, shortlist: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
    """Exact L2 of every row that the sign codes cannot exclude; the result is that of ``knn``.

    A shortlist by Hamming distance gives k near rows. A component whose sign
    differs from the query's adds at least the square of the query's own, which
    bounds every row's distance by its code; rows bounded beyond those k are left out.
    """
    code = F.lit(0).cast("bigint")
    for x in query:
        code = F.shiftleft(code, 1).bitwiseOR(F.lit(1 if x > 0 else 0).cast("bigint"))
    short = df.withColumn("__h", hamming(binary_code(F.col(column)), code)).orderBy("__h", *ties).limit(shortlist).drop("__h")
    reach = _reach(knn(short, column, query, k, ties=ties), k)
    # the last component is the lowest bit; a code holds the last 64
    squares = F.array(*(F.lit(float(x) * float(x)) for x in query[:-65:-1]))
    differs = binary_code(F.col(column)).bitwiseXOR(code)
    least = F.aggregate(squares, F.struct(F.lit(0.0).alias("s"), differs.alias("d")), lambda a, x: F.struct((a["s"] + F.when(a["d"].bitwiseAND(F.lit(1).cast("bigint")) == 1, x).otherwise(0.0)).alias("s"), F.shiftrightunsigned(a["d"], 1).alias("d")), lambda a: F.sqrt(a["s"]))
    return knn(df, column, query, k, where=F.coalesce((least <= reach) | differs.isNull(), F.lit(True)), ties=ties)


def scalar_quantize(v: Column, low: float, high: float, levels: int = 255) -> Column:
    """Components as whole steps between low and high."""
    return F.transform(v.cast("array<double>"), lambda x: F.round((F.greatest(F.least(x, F.lit(high)), F.lit(low)) - low) * levels / (high - low)).cast("int"))


def scalar_restore(v: Column, low: float, high: float, levels: int = 255) -> Column:
    return F.transform(v, lambda x: x * ((high - low) / levels) + low)
