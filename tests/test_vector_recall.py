"""The approximate searches find what brute force finds, with the registered parameters."""

import math

import pytest

from quern.operators import vector_index as VI
from quern.operators import vector_search as VS

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").cache()


@pytest.fixture(scope="module")
def exact(embeddings):
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    return [(q, [i for _, i in sorted((math.dist(q, v), i) for i, v in rows)[:10]]) for _, q in rows[:: len(rows) // 8]]


def recall(found, exact):
    return sum(len({r.vec_id for r in found(q).collect()} & set(ids)) for q, ids in exact) / (10 * len(exact))


def test_binary(embeddings, exact):
    assert recall(lambda q: VS.binary_knn(embeddings, "embedding", q, 10, ties=("vec_id",)), exact) == 1


def test_ivf(embeddings, exact):
    index = VI.IvfIndex(embeddings, "embedding", lists=8)
    assert recall(lambda q: index.search(q, 10, probes=4, ties=("vec_id",)), exact) == 1


def test_ivf_with_few_probes_stays_exact(embeddings, exact):
    index = VI.IvfIndex(embeddings, "embedding", lists=16)
    assert recall(lambda q: index.search(q, 10, probes=1, ties=("vec_id",)), exact) == 1


def test_product_codes(embeddings, exact):
    index = VI.ProductCodes(embeddings, "embedding", parts=8)
    assert recall(lambda q: index.search(q, 10, shortlist=30, ties=("vec_id",)), exact) == 1


def test_graph(spark, embeddings, exact):
    index = VI.GraphIndex(embeddings, "embedding", "vec_id", shard_rows=200)
    again = VI.GraphIndex.open(spark, index.path)
    found = lambda q: again.search(q, 10).withColumnRenamed("key", "vec_id")
    assert recall(found, exact) >= 0.95


def test_graph_of_one_and_of_equal_points():
    import numpy as np

    assert [n for _, n in VI.Graph(np.zeros((1, 3))).search(np.ones(3), 5, 8)] == [0]
    many = VI.Graph(np.zeros((300, 3))).search(np.zeros(3), 10, 32)
    assert len(many) == 10 and len({n for _, n in many}) == 10
