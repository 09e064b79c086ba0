"""Runs a registered query and its SQL side by side and compares rows, names and types."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(kind: pa.DataType) -> str:
    if pa.types.is_timestamp(kind):
        return "timestamp"
    return str(kind).replace("large_", "")


def canonical(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*(table.column(n).to_pylist() for n in names), strict=True)

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x + 0.0:.9g}"
        if hasattr(x, "replace") and hasattr(x, "tzinfo"):
            return x.replace(tzinfo=None).isoformat()
        return x

    return sorted((tuple(cell(x) for x in row) for row in rows), key=repr)


def differences(spark_rows: pa.Table, sql_rows: pa.Table) -> str:
    """Empty if equal."""
    if sorted(spark_rows.column_names) != sorted(sql_rows.column_names):
        return f"columns {spark_rows.column_names} and {sql_rows.column_names}"
    kinds = [(n, plain(spark_rows.schema.field(n).type), plain(sql_rows.schema.field(n).type)) for n in spark_rows.column_names]
    if unlike := [k for k in kinds if k[1] != k[2]]:
        return f"types {unlike}"
    a, b = canonical(spark_rows), canonical(sql_rows)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {odd}"
    return ""


def run(con, sql: str) -> pa.Table:
    result = con.execute(sql)
    for name in ("fetch_arrow_table", "to_arrow_table", "arrow"):
        if hasattr(result, name):
            out = getattr(result, name)()
            return out.read_all() if hasattr(out, "read_all") else out
    return pa.Table.from_pandas(result.fetchdf())
