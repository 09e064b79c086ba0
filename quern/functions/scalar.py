"""Text and number functions with the engine's documented meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Text of all parts in a row; NULL if any is NULL."""
    return F.concat(*(p.cast("string") for p in parts))


def substring(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Characters from 1-based ``start`` (0 counts as 1)."""
    at = start if isinstance(start, Column) else F.lit(start)
    at = F.when(at == 0, F.lit(1)).otherwise(at)
    size = F.char_length(text) if length is None else (length if isinstance(length, Column) else F.lit(length))
    return F.substring(text, at, size)


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def char_length(text: Column) -> Column:
    return F.char_length(text).cast("bigint")


def natural_log(x: Column) -> Column:
    return F.ln(x)


def ceil(x: Column) -> Column:
    """Smallest integer not below x, as a double."""
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def divide(a: Column, b: Column) -> Column:
    """Quotient as a double; NULL for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def contains(text: Column, part: Column | str) -> Column:
    return F.contains(text, part if isinstance(part, Column) else F.lit(part))


def starts_with(text: Column, part: Column | str) -> Column:
    return F.startswith(text, part if isinstance(part, Column) else F.lit(part))
