"""Stored vector indexes: inverted lists, product codes, and navigable graphs by shard.

Lists and codes give the exact answer: bounds by the triangle inequality tell
which lists and rows cannot hold a nearer one, and only those are left out.
Graph search is approximate; its beam width trades time for recall.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import scratch_dir, ship


def _sampled(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most about ``most`` rows, by a hash of the vector, so that all of the table is drawn from."""
    share = min(1.0, most / max(1, df.count()))
    return df if share == 1.0 else df.filter(F.pmod(F.xxhash64(column), F.lit(1 << 20)) < max(1, int(share * (1 << 20))))


def _reach(near: DataFrame, k: int) -> float:
    """Distance of the last of k found rows, with room for rounding; infinity where fewer were found."""
    row = near.agg(F.count("distance").alias("n"), F.max("distance").alias("d")).first()
    return row.d * (1 + 1e-9) + 1e-9 if row.n == k else math.inf


def _nearest(rows: DataFrame, column: str, query: list[float], k: int, ties: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("distance", V.l2(F.col(column), V.literal(query))).orderBy("distance", *ties).limit(k)


class IvfIndex:
    """Inverted lists by k-means, stored in one folder a list: a search reads the nearest lists only.

    Then it reads those others whose farthest member could still be nearer than
    what was found, and of them only rows that their distance from their own
    centre does not exclude. So the result is that of the whole scan.
    """

    def __init__(self, df: DataFrame, column: str, *, lists: int = 16, sample: int = 100_000, seed: int = 1, path: str | None = None):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.column, self.spark = column, df.sparkSession
        self.path = path or f"{scratch_dir(self.spark)}/ivf-{uuid.uuid4().hex}"
        rows = df.filter(F.col(column).isNotNull()).withColumn("__v", array_to_vector(F.col(column).cast("array<double>")))
        model = KMeans(k=lists, seed=seed, featuresCol="__v", predictionCol="list_id").fit(_sampled(rows, column, sample))
        self.centers = [c.tolist() for c in model.clusterCenters()]
        own = F.element_at(F.array(*(V.literal(c) for c in self.centers)), F.col("list_id") + 1)
        listed = model.transform(rows).drop("__v").withColumn("__from_center", V.l2(F.col(column), own))
        listed.repartition("list_id").write.partitionBy("list_id").parquet(self.path)
        self.rows = self.spark.read.schema(listed.schema).parquet(self.path)
        self.farthest = {r.list_id: r.far for r in self.rows.groupBy("list_id").agg(F.max("__from_center").alias("far")).collect()}  # one row a list

    def search(self, query: list[float], k: int, *, probes: int = 4, ties: tuple[str, ...] = ()) -> DataFrame:
        far = [math.dist(c, query) for c in self.centers]
        near = sorted(self.farthest, key=lambda j: far[j])[:probes]
        reach = _reach(_nearest(self.rows.filter(F.col("list_id").isin(near)), self.column, query, k, ties), k)
        others = [j for j in self.farthest if j not in near and far[j] - self.farthest[j] <= reach]
        least = F.abs(F.element_at(F.array(*(F.lit(x) for x in far)), F.col("list_id") + 1) - F.col("__from_center"))
        may = F.col("list_id").isin(near) | (F.lit(True) if math.isinf(reach) else least <= reach)
        rows = self.rows.filter(F.col("list_id").isin([*near, *others])).filter(may)
        return _nearest(rows, self.column, query, k, ties).drop("__from_center")


class ProductCodes:
    """Codes of ``parts`` sub-vectors with sixteen centroids each, and how far each row is from its code."""

    def __init__(self, df: DataFrame, column: str, *, parts: int = 8, sample: int = 20_000, rounds: int = 8, seed: int = 1, path: str | None = None):
        self.column, self.spark = column, ship(df.sparkSession)
        self.path = path or f"{scratch_dir(self.spark)}/pq-{uuid.uuid4().hex}"
        x = np.array([r[0] for r in _sampled(df, column, sample).select(F.col(column).cast("array<double>")).limit(2 * sample).collect()])
        df = df.filter(F.col(column).isNotNull())
        self.cuts = np.linspace(0, x.shape[1], parts + 1).astype(int)
        rng = np.random.Generator(np.random.PCG64(seed))
        self.centroids = []
        for lo, hi in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            part = x[:, lo:hi]
            c = part[rng.choice(len(part), 16, replace=len(part) < 16)].copy()
            for _ in range(rounds):
                own = ((part[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
                for k in range(16):
                    if (own == k).any():
                        c[k] = part[own == k].mean(axis=0)
            self.centroids.append(c)
        cuts, centroids = self.cuts, self.centroids

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                v = np.array(rows[column].tolist(), float).reshape(len(rows), -1)
                codes, error = np.zeros((len(v), len(centroids)), np.int32), np.zeros(len(v))
                for s, (lo, hi, c) in enumerate(zip(cuts[:-1], cuts[1:], centroids, strict=True)):
                    square = ((v[:, None, lo:hi] - c[None]) ** 2).sum(axis=2)
                    codes[:, s] = square.argmin(axis=1)
                    error += square.min(axis=1)
                yield rows.assign(__code=list(codes), __error=np.sqrt(error))

        schema = T.StructType([*df.schema, T.StructField("__code", T.ArrayType(T.IntegerType())), T.StructField("__error", T.DoubleType())])
        df.mapInPandas(encode, schema).write.parquet(self.path)
        self.rows = self.spark.read.schema(schema).parquet(self.path)

    def search(self, query: list[float], k: int, *, shortlist: int = 100, ties: tuple[str, ...] = ()) -> DataFrame:
        """Exact: a row's distance differs from its code's by at most its own from the code."""
        q = np.asarray(query, float)
        tables = [((c - q[lo:hi]) ** 2).sum(axis=1).tolist() for lo, hi, c in zip(self.cuts[:-1], self.cuts[1:], self.centroids, strict=True)]
        squares = [F.element_at(F.array(*(F.lit(x) for x in t)), F.element_at("__code", s + 1) + 1) for s, t in enumerate(tables)]
        coded = self.rows.withColumn("__by_code", F.sqrt(sum(squares[1:], squares[0])))
        first = coded.orderBy("__by_code", *ties).limit(shortlist)
        reach = _reach(_nearest(first, self.column, query, k, ties), k)
        may = F.lit(True) if math.isinf(reach) else F.col("__by_code") - F.col("__error") <= reach
        return _nearest(coded.filter(may), self.column, query, k, ties).drop("__code", "__error", "__by_code")


class Graph:
    """A hierarchical navigable small world of the vectors of one shard."""

    def __init__(self, x: np.ndarray, links: int = 16, beam: int = 64, seed: int = 1):
        self.x, self.links, self.beam = x, links, beam
        rng = np.random.Generator(np.random.PCG64(seed))
        self.level = np.minimum((-np.log(rng.random(len(x)) + 1e-12) / math.log(links)).astype(int), 8)
        self.near: list[dict[int, list[int]]] = [{} for _ in range(int(self.level.max(initial=0)) + 1)]
        self.entry = -1
        for node in range(len(x)):
            self._add(node)

    def _distance(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return ((self.x[nodes] - q) ** 2).sum(axis=1)

    def _walk(self, q: np.ndarray, entry: int, layer: int, beam: int) -> list[tuple[float, int]]:
        """The ``beam`` nearest that a best-first walk from ``entry`` meets, nearest first."""
        start = float(self._distance(q, [entry])[0])
        seen, todo, best = {entry}, [(start, entry)], [(-start, entry)]
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = [n for n in self.near[layer].get(node, ()) if n not in seen]
            seen.update(new)
            for e, n in zip(self._distance(q, new).tolist() if new else (), new, strict=True):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(todo, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def _add(self, node: int) -> None:
        top = int(self.level[node])
        if self.entry < 0:
            self.entry = node
        else:
            at, q = self.entry, self.x[node]
            for layer in range(int(self.level[self.entry]), -1, -1):
                found = self._walk(q, at, layer, self.beam if layer <= top else 1)
                at = found[0][1]
                if layer <= top:
                    most = self.links * (2 if layer == 0 else 1)
                    self.near[layer][node] = [n for _, n in found[: self.links]]
                    for _, n in found[: self.links]:
                        own = self.near[layer].setdefault(n, [])
                        own.append(node)
                        if len(own) > most:
                            by = np.argsort(self._distance(self.x[n], own), kind="stable")[:most]
                            self.near[layer][n] = [own[k] for k in by]
            if top > self.level[self.entry]:
                self.entry = node
        for layer in range(top + 1):
            self.near[layer].setdefault(node, [])

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        at = self.entry
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self._walk(q, at, layer, 1)[0][1]
        return self._walk(q, at, 0, max(beam, k))[:k]


class GraphIndex:
    """Rows dealt into shards of bounded size by hash, a graph for each, stored as bytes; a search asks every shard and ranks what they return."""

    def __init__(self, df: DataFrame, column: str, key: str, *, shard_rows: int = 20_000, links: int = 16, beam: int = 64, path: str | None = None):
        import pickle

        self.column, self.key, self.spark = column, key, ship(df.sparkSession)
        self.path = path or f"{scratch_dir(self.spark)}/graph-{uuid.uuid4().hex}"
        shards = max(1, -(-df.count() // shard_rows))

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("key")
            graph = Graph(np.array(rows["v"].tolist(), float), links, beam)
            return pd.DataFrame({"keys": [rows["key"].tolist()], "graph": [pickle.dumps(graph)]})

        dealt = df.select(F.col(key).cast("long").alias("key"), F.col(column).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
        dealt.filter("v is not null").groupBy("shard").applyInPandas(build, "keys array<long>, graph binary").write.parquet(self.path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphIndex:
        index = cls.__new__(cls)
        index.spark, index.path = ship(spark), path
        return index

    def search(self, query: list[float], k: int, *, beam: int = 128) -> DataFrame:
        """(key, distance) of about the k nearest rows by L2."""

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pickle

            q = np.asarray(query, float)
            for rows in batches:
                for keys, graph in zip(rows["keys"], rows["graph"], strict=True):
                    found = pickle.loads(graph).search(q, k, beam)
                    yield pd.DataFrame({"key": [int(keys[n]) for _, n in found], "distance": [math.sqrt(d) for d, _ in found]})

        shards = self.spark.read.schema("keys array<long>, graph binary").parquet(self.path)
        return shards.mapInPandas(ask, "key long, distance double").orderBy("distance", "key").limit(k)
