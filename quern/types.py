"""SQL type names, column and table definitions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Spellings of SQL types. Unsigned types take the next wider signed one.
NAMES: dict[str, T.DataType] = {
    "UINT8": T.ShortType(), "TINYINT UNSIGNED": T.ShortType(), "UINT16": T.IntegerType(), "SMALLINT UNSIGNED": T.IntegerType(), "UINT32": T.LongType(), "INT UNSIGNED": T.LongType(), "INTEGER UNSIGNED": T.LongType(),
    "UINT64": T.DecimalType(20, 0), "BIGINT UNSIGNED": T.DecimalType(20, 0), "INT8": T.ByteType(), "TINYINT": T.ByteType(), "INT16": T.ShortType(), "SMALLINT": T.ShortType(), "INT32": T.IntegerType(), "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(), "INT64": T.LongType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "FLOAT32": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(), "FLOAT64": T.DoubleType(), "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampNTZType(), "DATETIME": T.TimestampNTZType(), "DATE": T.TimestampNTZType(), "TIME": T.TimestampNTZType(), "TIMESTAMPTZ": T.TimestampType(),
    "INTERVAL": T.DayTimeIntervalType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(), "STRING": T.StringType(), "JSON": T.StringType(),
}
_TYPE = re.compile(r"([A-Za-z][A-Za-z0-9]*(?:\s+UNSIGNED)?)\s*(?:\(\s*(\d+)\s*\))?(?:\s*WITH\s+DISTANCE\s*=\s*(\w+))?", re.IGNORECASE)


class SqlTypeError(ValueError):
    pass


def parse_type(text: str) -> tuple[T.DataType, dict]:
    """Spark type and metadata of a SQL type name."""
    m = _TYPE.fullmatch(text.strip())
    if not m:
        raise SqlTypeError(f"unknown type {text!r}")
    name, size, metric = " ".join(m[1].upper().split()), m[2], m[3]
    meta = {"sql_type": name + (f"({size})" if size else "")}
    if name == "VECTOR":
        if not size or not 1 <= int(size) <= 4096:
            raise SqlTypeError("VECTOR needs a dimension from 1 to 4096")
        return T.ArrayType(T.FloatType()), meta | {"dimension": int(size), "metric": {"INNER_PRODUCT": "ip", "IP": "ip", "COSINE": "cosine"}.get((metric or "L2").upper(), "l2")}
    if name not in NAMES:
        raise SqlTypeError(f"unknown type {text!r}")
    if name in ("VARCHAR", "CHAR") and size:
        meta["length"] = int(size)
    if name.startswith("UINT") or name.endswith("UNSIGNED"):
        meta["unsigned"] = True
    return NAMES[name], meta


@dataclass(frozen=True)
class ColumnDef:
    name: str
    kind: T.DataType
    meta: dict = field(default_factory=dict)
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False
    auto_increment: bool = False
    default: str | None = None


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[ColumnDef, ...]
    options: dict = field(default_factory=dict)
    time_column: str | None = None  # of a time-series table
    indexes: tuple[dict, ...] = ()

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind, True, c.meta) for c in self.columns])

    def column(self, name: str) -> ColumnDef:
        found = next((c for c in self.columns if c.name.lower() == name.lower()), None)
        if found is None:
            raise KeyError(f"no column {name} in {self.name}")
        return found

    def with_columns(self, columns) -> TableDef:
        return replace(self, columns=tuple(columns))

    def order_column(self) -> str:
        """What a row order without ORDER BY follows: time, else the key, else the first column."""
        times = [c.name for c in self.columns if isinstance(c.kind, T.TimestampNTZType | T.TimestampType)]
        return self.time_column or (times or self.key or [self.columns[0].name])[0]
