"""Models as SQL functions: a registry of pandas UDFs, batched by Arrow, loaded once a worker."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import ship

#: What a worker has loaded, and its cached results, by model name and path.
_LOADED: dict[tuple[str, str], Callable] = {}
_CACHES: dict[tuple[str, str], InferenceCache] = {}


def hash_embedding(texts: pd.Series, dim: int = 64) -> list[np.ndarray]:
    """Deterministic unit vectors: signed counts of hashed words. Each distinct word of a batch is hashed once."""
    words = [str(text).lower().split() for text in pd.Series(texts, dtype=object).fillna("")]
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    code, distinct = pd.factorize(np.array(list(chain.from_iterable(words)), dtype=object))
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in distinct), np.uint8).reshape(-1, 16)
    slot = np.ascontiguousarray(digests[:, :4]).view("<u4").ravel() % dim if len(distinct) else np.zeros(0, np.int64)
    sign = np.where(digests[:, 8] & 1, 1, -1) if len(distinct) else slot
    out = np.bincount(row * dim + slot[code], weights=sign[code], minlength=len(words) * dim).reshape(len(words), dim) if len(row) else np.zeros((len(words), dim))
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return list((out / np.where(size > 0, size, 1)).astype(np.float32))


class InferenceCache:
    """Results of a worker's latest calls: the least recently used go beyond ``entries`` or ``most_bytes``, and all after ``ttl`` seconds."""

    def __init__(self, entries: int = 10_000, most_bytes: int = 64 << 20, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.entries, self.most_bytes, self.ttl, self.clock = entries, most_bytes, ttl, clock
        self.held: OrderedDict[tuple, tuple[float, int, object]] = OrderedDict()
        self.bytes = self.hits = self.misses = 0

    def get(self, key: tuple):
        found = self.held.get(key)
        if found is None or self.clock() - found[0] > self.ttl:
            if found is not None:
                self._drop(key)
            self.misses += 1
            return None
        self.held.move_to_end(key)
        self.hits += 1
        return found[2]

    def put(self, key: tuple, value) -> None:
        if key in self.held:
            self._drop(key)
        size = sum(len(x) if isinstance(x, str | bytes) else 8 for x in key) + getattr(value, "nbytes", 64)
        self.held[key] = (self.clock(), size, value)
        self.bytes += size
        while self.held and (len(self.held) > self.entries or self.bytes > self.most_bytes):
            self._drop(next(iter(self.held)))

    def _drop(self, key: tuple) -> None:
        self.bytes -= self.held.pop(key)[1]

    def call(self, function: Callable, columns: tuple[pd.Series, ...]) -> list:
        """The function's results, called only for rows that are not held, each different one once."""
        keys = list(zip(*(c.tolist() for c in columns), strict=True))
        out = {key: found for key in dict.fromkeys(keys) if (found := self.get(key)) is not None}
        first: dict[tuple, int] = {}
        for i, key in enumerate(keys):
            if key not in out:
                first.setdefault(key, i)
        if first:
            at = list(first.values())
            for key, value in zip(first, function(*(c.iloc[at].reset_index(drop=True) for c in columns)), strict=True):
                out[key] = value
                self.put(key, value)
        return [out[key] for key in keys]


def onnx_loader(path: str) -> Callable:
    """A callable for an ONNX file with one numeric input and one output."""
    import onnxruntime

    session = onnxruntime.InferenceSession(path)
    name = session.get_inputs()[0].name
    return lambda *columns: session.run(None, {name: np.stack([np.asarray(c, np.float32) for c in columns], axis=1)})[0].tolist()


class ModelRegistry:
    """CREATE MODEL, DROP MODEL and calls by name."""

    def __init__(self, spark: SparkSession):
        self.spark = ship(spark)
        self.models: dict[str, dict] = {}

    def create(self, name: str, path: str, arguments: list[tuple[str, str]], returns: str, *, loader: Callable[[str], Callable] | None = None, if_not_exists: bool = False, cache: dict | None = None) -> None:
        """Register a model as a SQL function; ``cache`` holds the bounds of an InferenceCache, for models that always answer alike."""
        if name in self.models:
            if if_not_exists:
                return
            raise ValueError(f"model {name} exists")
        load = loader or (hash_loader if path.startswith("hash:") else onnx_loader)
        kind = {"VECTOR": ArrayType(FloatType())}.get(returns.upper().split("(")[0], returns.lower())

        def call(*columns: pd.Series) -> pd.Series:
            key = (name, path)
            if key not in _LOADED:
                _LOADED[key] = load(path)
            if cache is not None:
                found = _CACHES.setdefault(key, InferenceCache(**cache)).call(_LOADED[key], columns)
                return pd.Series(found, dtype="object" if isinstance(kind, ArrayType) else None)
            return pd.Series(_LOADED[key](*columns), dtype="object" if isinstance(kind, ArrayType) else None)

        call.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        self.spark.udf.register(name, F.pandas_udf(call, kind))
        self.models[name] = {"path": path, "arguments": arguments, "returns": returns}

    def drop(self, name: str, *, if_exists: bool = False) -> None:
        if name not in self.models and not if_exists:
            raise ValueError(f"no model {name}")
        if self.models.pop(name, None):
            self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def hash_loader(path: str) -> Callable:
    """Path 'hash:<dim>': the built-in embedding."""
    dim = int(path.partition(":")[2] or 64)
    return lambda texts: hash_embedding(texts, dim)
