"""The same functions under their SQL names, as temporary SQL functions.

Catalyst inlines their bodies, so a query that calls them plans like one
that spells the expression out. The JSON editors are pandas UDFs.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..session import ship
from . import jsons

_SUM = "aggregate({}, 0D, (s, x) -> s + x)"
_IP = _SUM.format("zip_with(a, b, (x, y) -> x * y)")
_L2 = f"sqrt({_SUM.format('zip_with(a, b, (x, y) -> (x - y) * (x - y))')})"
_NORMS = f"sqrt({_SUM.format('transform(a, x -> x * x)')}) * sqrt({_SUM.format('transform(b, x -> x * x)')})"
_COS = f"CASE WHEN {_NORMS} = 0 THEN 0D ELSE {_IP} / ({_NORMS}) END"
_VV = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_KIND = "schema_of_variant(try_variant_get(try_parse_json(doc), path, 'variant'))"
_TYPE = f"CASE WHEN startswith({_KIND}, 'ARRAY') THEN 'array' WHEN startswith({_KIND}, 'OBJECT') THEN 'object' WHEN {_KIND} = 'VOID' THEN 'null' WHEN {_KIND} = 'STRING' THEN 'string' WHEN {_KIND} = 'BOOLEAN' THEN 'boolean' WHEN {_KIND} IS NOT NULL THEN 'number' END"

DEFINITIONS = {
    "vector_l2": f"({_VV}) RETURNS DOUBLE RETURN {_L2}",
    "vector_ip": f"({_VV}) RETURNS DOUBLE RETURN {_IP}",
    "vector_cosine": f"({_VV}) RETURNS DOUBLE RETURN {_COS}",
    "vector_distance": f"({_VV}, metric STRING DEFAULT 'l2') RETURNS DOUBLE RETURN CASE lower(metric) WHEN 'l2' THEN {_L2} WHEN 'cosine' THEN 1 - ({_COS}) ELSE -{_IP} END",
    "vector_similar": f"({_VV}, metric STRING, threshold DOUBLE) RETURNS BOOLEAN RETURN CASE lower(metric) WHEN 'l2' THEN {_L2} <= threshold WHEN 'cosine' THEN {_COS} >= threshold ELSE {_IP} >= threshold END",
    "q_byte_length": "(t STRING) RETURNS BIGINT RETURN CAST(octet_length(t) AS BIGINT)",
    "q_substring": "(t STRING, start INT, size INT DEFAULT 2147483647) RETURNS STRING RETURN substring(t, CASE WHEN start = 0 THEN 1 ELSE start END, size)",
    "q_ceil": "(x DOUBLE) RETURNS DOUBLE RETURN CAST(ceil(x) AS DOUBLE)",
    "q_floor": "(x DOUBLE) RETURNS DOUBLE RETURN CAST(floor(x) AS DOUBLE)",
    "to_epoch": "(ts TIMESTAMP) RETURNS DOUBLE RETURN unix_micros(ts) / 1000000D",
    "to_iso8601": "(ts TIMESTAMP) RETURNS STRING RETURN CASE WHEN pmod(unix_micros(ts), 1000000) = 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ssxxx\") ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx\") END",
    "json_extract": "(doc STRING, path STRING) RETURNS STRING RETURN get_json_object(doc, path)",
    "json_type": f"(doc STRING, path STRING DEFAULT '$') RETURNS STRING RETURN {_TYPE}",
    "json_value": f"(doc STRING, path STRING) RETURNS STRING RETURN CASE WHEN {_TYPE} IN ('string', 'number', 'boolean') THEN get_json_object(doc, path) END",
    "json_query": f"(doc STRING, path STRING) RETURNS STRING RETURN CASE WHEN {_TYPE} IN ('object', 'array') THEN get_json_object(doc, path) END",
    "json_has": "(doc STRING, path STRING) RETURNS BOOLEAN RETURN coalesce(try_variant_get(try_parse_json(doc), path, 'variant') IS NOT NULL, false)",
    "q_json_array_length": "(doc STRING, path STRING DEFAULT '$') RETURNS BIGINT RETURN coalesce(CAST(json_array_length(get_json_object(doc, path)) AS BIGINT), 0L)",
    "json_keys": "(doc STRING, path STRING DEFAULT '$') RETURNS STRING RETURN coalesce(to_json(array_sort(json_object_keys(get_json_object(doc, path)))), '[]')",
    "json_valid": "(doc STRING) RETURNS BOOLEAN RETURN CASE WHEN doc IS NOT NULL THEN try_parse_json(doc) IS NOT NULL AND try_parse_json('[' || doc || ']') IS NOT NULL AND try_parse_json('{\"v\":' || doc || '}') IS NOT NULL END",
}


_PARAMETER = re.compile(r"(\w+) (ARRAY<DOUBLE>|STRING|DOUBLE|TIMESTAMP|INT)(?: DEFAULT ('[^']*'|\d+))?")


def expand(name: str, arguments: list[str]) -> str | None:
    """The expression that a call stands for; None for other functions.

    Spark allows its SQL functions in few places (not in ORDER BY, say), so the
    dialect writes their bodies out.
    """
    if name not in DEFINITIONS:
        return None
    head, body = DEFINITIONS[name].split(" RETURN ", 1)
    parameters = _PARAMETER.findall(head.rsplit(" RETURNS ", 1)[0])
    values: dict[str, str] = {}
    for k, (parameter, kind, default) in enumerate(parameters):
        if k >= len(arguments) and not default:
            raise ValueError(f"{name} takes {len(parameters)} arguments")
        given = arguments[k] if k < len(arguments) else default
        values[parameter] = f"CAST({given} AS {kind})" if kind in ("ARRAY<DOUBLE>", "TIMESTAMP") else f"({given})"
    if len(arguments) > len(parameters):
        raise ValueError(f"{name} takes {len(parameters)} arguments")
    return "(" + re.sub(r"'[^']*'|\w+", lambda m: values.get(m[0], m[0]), body) + ")"


def register(spark: SparkSession) -> None:
    """Make all functions known to the session; may be called again."""
    ship(spark)
    for name, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    for name, udf in (("q_json_set", jsons.set_udf), ("q_json_remove", jsons.remove_udf), ("q_json_merge", jsons.merge_udf), ("q_json_append", jsons.append_udf)):
        spark.udf.register(name, udf)
