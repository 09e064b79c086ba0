"""JSON functions over text columns.

Readers are Catalyst expressions (get_json_object and variants). The four
editors have no built-in form; they are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STEP = re.compile(r"\.([^.\[\]]+)|\[(\d+)\]|\[['\"]([^'\"]+)['\"]\]")


def extract(doc: Column, path: str, kind: str | None = None) -> Column:
    """What stands at ``path``: text of a scalar, JSON of an object or array; cast to ``kind`` if given."""
    out = F.get_json_object(doc, path)
    return out.try_cast(kind) if kind else out


def extract_text(doc: Column, path: str) -> Column:
    """A string's text; NULL for anything else."""
    return F.when(type_of(doc, path) == "string", F.get_json_object(doc, path))


def extract_int(doc: Column, path: str) -> Column:
    """A whole number; NULL for anything else."""
    return F.when(type_of(doc, path) == "number", F.get_json_object(doc, path).try_cast("bigint"))


def extract_float(doc: Column, path: str) -> Column:
    """A number as a double; NULL for anything else."""
    return F.when(type_of(doc, path) == "number", F.get_json_object(doc, path).try_cast("double"))


def type_of(doc: Column, path: str = "$") -> Column:
    """string, number, boolean, null, object or array; NULL where nothing stands."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), path, "variant"))
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.isNotNull(), "number")
    )


def value(doc: Column, path: str) -> Column:
    """Text of a scalar, else NULL."""
    return F.when(type_of(doc, path).isin("string", "number", "boolean"), F.get_json_object(doc, path))


def query(doc: Column, path: str) -> Column:
    """JSON of an object or array, else NULL."""
    return F.when(type_of(doc, path).isin("object", "array"), F.get_json_object(doc, path))


def has(doc: Column, path: str) -> Column:
    """Whether the path exists; a JSON null counts as present."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(doc), path, "variant").isNotNull(), F.lit(False))


def array_length(doc: Column, path: str = "$") -> Column:
    """Elements of the array at ``path``; 0 for anything else."""
    return F.coalesce(F.json_array_length(F.get_json_object(doc, path)), F.lit(0)).cast("bigint")


def keys(doc: Column, path: str = "$") -> Column:
    """Sorted keys as a JSON array; [] for anything but an object."""
    return F.coalesce(F.to_json(F.array_sort(F.json_object_keys(F.get_json_object(doc, path)))), F.lit("[]"))


def array(*values: Column) -> Column:
    """JSON array of values of any types."""
    parts = [F.coalesce(F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit("")) for v in values]
    return F.concat(F.lit("["), F.concat_ws(",", *(F.when(p == "", "null").otherwise(p) for p in parts)), F.lit("]"))


def obj(*pairs: Column) -> Column:
    """JSON object of alternating keys and values of any types; NULL values are written as null."""
    items = []
    for key, val in zip(pairs[::2], pairs[1::2], strict=True):
        part = F.coalesce(F.regexp_extract(F.to_json(F.struct(val.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1), F.lit(""))
        name = F.regexp_extract(F.to_json(F.struct(key.cast("string").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
        items.append(F.concat(name, F.lit(":"), F.when(part == "", "null").otherwise(part)))
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def is_valid(doc: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after a first value; inside an array and inside an object
    anything left over is an error in at least one of the two.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), doc, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), doc, F.lit("}"))).isNotNull()
    return F.when(doc.isNotNull(), inside & F.try_parse_json(doc).isNotNull())


# ---- editors ---------------------------------------------------------------


def _steps(path: str) -> list[str | int]:
    found = list(_STEP.finditer(path[1:] if path.startswith("$") else f".{path}"))
    return [int(m[2]) if m[2] is not None else (m[1] or m[3]) for m in found]


def _load(text: str | None):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


def _dump(doc) -> str:
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def _set(doc, steps: list, new):
    if not steps:
        return new
    step, *rest = steps
    if isinstance(doc, list):
        if isinstance(step, str) and step.isdigit():
            step = int(step)
        if isinstance(step, int):
            if step < len(doc):
                doc[step] = _set(doc[step], rest, new)
            elif step == len(doc):
                doc.append(_set({}, rest, new))
        return doc
    if not isinstance(doc, dict):
        doc = {}
    doc[str(step)] = _set(doc.get(str(step), {}), rest, new)
    return doc


def _remove(doc, steps: list):
    *way, last = steps
    at = doc
    for step in way:
        at = _child(at, step)
    if isinstance(at, dict):
        at.pop(str(last), None)
    elif isinstance(at, list) and str(last).isdigit() and int(last) < len(at):
        at.pop(int(last))
    return doc


def _child(at, step):
    if isinstance(at, dict):
        return at.get(str(step))
    if isinstance(at, list) and str(step).isdigit() and int(step) < len(at):
        return at[int(step)]
    return None


def _merge(doc, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for key, val in patch.items():
        if val is None:
            out.pop(key, None)
        else:
            out[key] = _merge(out.get(key), val)
    return out


def _append(doc, steps: list, new):
    at = doc
    for step in steps:
        at = _child(at, step)
    if isinstance(at, list):
        at.append(new)
    return doc


def _value(raw: str | None):
    """A value given as JSON text, or as plain text where it is none."""
    try:
        return json.loads(raw) if raw is not None else None
    except ValueError:
        return raw


def _editor(change):
    @F.pandas_udf(StringType())
    def edit(doc: pd.Series, path: pd.Series, new: pd.Series) -> pd.Series:
        out = []
        for text, where, val in zip(doc, path, new, strict=True):
            loaded = _load(text)
            out.append(None if text is None or (loaded is None and text.strip() != "null") else _dump(change(loaded, where, val)))
        return pd.Series(out, dtype="object")

    return edit


set_udf = _editor(lambda doc, path, new: _set(doc, _steps(path), _value(new)))
remove_udf = _editor(lambda doc, path, _: _remove(doc, _steps(path)) if _steps(path) else doc)
merge_udf = _editor(lambda doc, patch, _: _merge(doc, _load(patch)))
append_udf = _editor(lambda doc, path, new: _append(doc, _steps(path), _value(new)))


def _text(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def set_value(doc: Column, path: Column | str, new: Column | str) -> Column:
    """The document with ``new`` (JSON text, or plain text) at the path; missing keys are made."""
    return set_udf(doc, _text(path), _text(new).cast("string"))


def remove(doc: Column, path: Column | str) -> Column:
    return remove_udf(doc, _text(path), F.lit(None).cast("string"))


def merge_patch(doc: Column, patch: Column | str) -> Column:
    """RFC 7396 merge patch; null deletes."""
    return merge_udf(doc, _text(patch), F.lit(None).cast("string"))


def array_append(doc: Column, path: Column | str, new: Column | str) -> Column:
    """The document with ``new`` at the end of the array at the path; unchanged where there is none."""
    return append_udf(doc, _text(path), _text(new).cast("string"))
