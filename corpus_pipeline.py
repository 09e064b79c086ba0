"""A training-data pipeline over ``documents``: five stages, each one operator of ``quern.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of documents.

Every stage takes null ids and texts, empty and very long texts, repeated rows,
empty tables and extra columns of any name: a null text is an empty one, but
stays null where its row passes a stage unchanged; an empty table gives an
empty table; extra columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, line_dedup, near_dedup, packing, quality
from quern.llm.bitmap import BitMap
from quern.llm.common import materialize, table
from quern.llm.queries import BYTE_MODEL, BYTE_RANKS


def _columns(docs: DataFrame, source: str = "src") -> list:
    return [F.col(f"{source}.`{c}`").alias(c) for c in docs.columns]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Empty texts are scored like all others; repeated rows share their fate."""
    scored = quality.score_documents(docs, table(spark, sf_dir, "labels"), carry=docs.columns)
    return scored.filter("predicted = 1").select(*_columns(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of two or more lines that an earlier one has; n_chars follows the text.

    Rows of null id come first. Rows equal in id and text are one document and stay alike.
    """
    kept = line_dedup.remove_repeated_lines(docs)
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("src.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(kind)).otherwise(F.col("src.n_chars"))
    return kept.select(*(new.get(c, F.col(f"src.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one of smallest doc_id.

    Groups are those of five-word shingles and a similarity of 0.8 or more. Rows
    of one doc_id are one document, so all of them stay or go; rows of null id and
    texts without words stay.
    """
    found = near_dedup.find_near_duplicates(docs)
    dropped = materialize(found.filter("not kept").select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("src"))
    # most documents stay; a bit map tells them before any text is shuffled
    may_go = BitMap(dropped, "dropped_id").may_hold("src.doc_id")
    checked = packed.filter(may_go).join(dropped, F.col("src.doc_id") == F.col("dropped_id"), "left_anti")
    return packed.filter(~may_go).unionByName(checked).select(*_columns(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage, of ten words or a whole shorter item. Wordless texts stay."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=docs.columns)
    return found.filter("not contaminated").select(*_columns(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; an empty text has its end token, a null id stays null."""
    return packing.pack(docs, public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(BYTE_RANKS))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("packing", packed_sequences),
]

#: SQL expresses neither the classifier nor the sketches; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
