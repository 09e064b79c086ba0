"""The pipeline's stages, each on what its predecessor kept."""

import brute
import corpus_pipeline
import pytest

from quern.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents").withColumn("grp", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(3))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        pairs = [(i, r.text) for i, r in before.items()]
        if name == "packing":
            assert set(after) == set(before)
            break
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            want = {i: t for i, _, _, t in brute.line_passages(pairs)}
            assert {i: r.text for i, r in after.items()} == want and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_dedup":
            assert set(after) == {i for i, _, _, kept in brute.near(pairs, 80, 5) if kept}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            assert set(after) == {i for i, _, hit, _ in brute.contamination(pairs, items) if not hit}
        else:
            bad = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 0}
            good = {r.doc_id for r in table(spark, SF, "labels").collect() if r.quality == 1}
            assert len(bad & set(after)) <= 0.1 * len(bad) + 1 and len(good - set(after)) <= 0.02 * len(good) + 1


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 11)])
def test_registered(name):
    import __spark_entry__

    assert sum(q.startswith(name) for q in __spark_entry__.queries()) == 1


DOCS = "doc_id long, text string, lang string, source string, n_chars int, score string, src string"


@pytest.fixture(scope="module")
def odd(spark):
    prose = "It was the best of times, it was the worst of times, and there was more of it than of the other one. " * 4
    long = "\n".join(f"Line {k} of the very long text that is here for the test of it, with number {k * k}." for k in range(4000))
    rows = [(None, None), (None, prose), (1, ""), (1, ""), (2, prose), (2, prose), (3, prose + "End."), (4, None), (5, long), (6, long + " x"), (7, " \n \n"), (8, "a\nb\nc"), (9, "z\na\nb\nc")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", "clash") for i, t in rows], DOCS).repartition(3)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_odd_rows(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0
    out = stage(spark, odd, SF)
    rows = out.collect()
    if name == "packing":
        assert len({(r.doc_id, r.piece) for r in rows if r.doc_id in (1, 2)}) == 2 and len([r for r in rows if r.doc_id is None]) == 2
        return
    assert out.columns == odd.columns and all(r.score == r.src == "clash" for r in rows)
    ids = [r.doc_id for r in rows]
    if name == "line_dedup":
        assert len(rows) == 13
        assert {r.text for r in rows if r.doc_id == 9} == {"z"} and {r.n_chars for r in rows if r.doc_id == 9} == {1}
        assert {r.text for r in rows if r.doc_id == 4} == {None}
    elif name == "near_dedup":
        assert ids.count(None) == 2 and ids.count(1) == 2 and ids.count(2) == 2 and set(ids) == {None, 1, 2, 4, 5, 7, 8, 9}
    elif name == "decontamination":
        assert len(rows) == 13
    else:
        assert ids.count(1) in (0, 2) and ids.count(2) in (0, 2)


def test_texts_travel_in_small_batches(spark):
    """A task's texts are never one batch; freed memory goes back to the system."""
    from quern.llm import common

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"n": [b.nbytes for b in batches]})

    try:
        spark.conf.set(name, "64m")
        common.prepare(spark)
        rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('some words ', 400) text")
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 4 * common.BATCH_BYTES and max(found) < 1.1 * common.BATCH_BYTES
        spark.conf.set(name, "1m")
        common.prepare(spark)
        assert spark.conf.get(name) in ("1m", "1048576b")  # a session's own smaller limit stays
    finally:
        spark.conf.set(name, had)
    common.release_memory()
