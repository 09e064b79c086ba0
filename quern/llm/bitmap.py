"""Bit maps of keys: tell most rows without a partner before any shuffle.

Their size follows the counted keys up to a fixed bound; a crowded map only
lets more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: 128 KB and 8 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26


class BitMap:
    """The bits of all values of a column, as a scalar subquery."""

    def __init__(self, keys: DataFrame, name: str):
        n = keys.count()
        self.bits = min(max(1 << (16 * n).bit_length(), LEAST_BITS), MOST_BITS)
        one = F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")
        words = keys.select(self._bit(F.col(name)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), one.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        zeros = keys.sparkSession.range(self.bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
        full = zeros.union(words).groupBy("word").agg(F.bit_or("mask").alias("mask"))
        array = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "mask"))), lambda x: x["mask"]).alias("map"))
        self.map = materialize(array, "bits").scalar()

    def _bit(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits))

    def may_hold(self, name: str) -> Column:
        """False only if the key was not put in."""
        bit = self._bit(F.col(name))
        word = F.get(self.map, F.shiftright(bit, 6).cast("int"))
        return F.coalesce(word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))) != 0, F.lit(False))
