"""Token counts by a sentencepiece model, with overlap resynchronisation for huge texts.

A place between two characters is *stable* when no piece of the vocabulary
holds these two side by side: then no merge can ever cross it, whatever stands
around it, so encodings of both sides are independent. Stability is read off
the vocabulary, not assumed.

Texts up to ``huge_chars`` are counted whole. Longer ones are cut into
overlapping chunks, which spread over the cluster; each chunk is encoded with
offsets, and neighbours are spliced at a stable place that both encodings have
as a token border. Where an overlap holds none, the text goes round again with
wider overlaps, at last as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, null_free, prepare, row_salted

SPACE = "▁"  # how the model writes a space
CACHE_ENTRIES = 1 << 19


@lru_cache(maxsize=2)
def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=2)
def takes_text_as_it_is(model_path: str) -> bool:
    """Whether the model changes nothing in a text but spaces: only then words and chunks can be counted apart."""
    probe = "\ufb01 \uff21 e\u0301 \u00e9 \u00bd x\u00a0y \u2126 \u3042 \u304b\u3099 A"
    return load(model_path).normalize(probe).replace(SPACE, " ").strip() == probe


@lru_cache(maxsize=2)
def joined_pairs(model_path: str) -> frozenset[str]:
    """Every pair of characters that stand side by side in some piece."""
    model = load(model_path)
    pairs: set[str] = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            pairs.update(piece[k : k + 2] for k in range(len(piece) - 1))
    return frozenset(pairs)


def is_stable(text: str, at: int, pairs: frozenset[str]) -> bool:
    if not 0 < at < len(text):
        return False
    return text[at - 1 : at + 1].replace(" ", SPACE) not in pairs


class Counter:
    """Counts tokens of whole texts; equal words are encoded once per cache fill."""

    def __init__(self, model_path: str):
        self.model = load(model_path)
        pairs = joined_pairs(model_path)
        # a space after any other character is a stable place, unless some piece joins the two
        self.by_words = takes_text_as_it_is(model_path) and not any(p[1] == SPACE and p[0] != SPACE for p in pairs)
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if not self.by_words or not text or SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return len(self.model.encode(text))
        known, words = self.known, text.split(" ")
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        new = [w for w in set(words) if w not in known]
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = list(set(words))
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return sum(map(known.__getitem__, words))


def _count_whole(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(model_path)
        for batch in batches:
            tokens = [count(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk_chars: int):
    """Rows (doc_id, text, n_bytes, overlap, row_key) into overlapping chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, n_bytes, overlap, key in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                step = max(chunk_chars, overlap)
                starts = list(range(0, max(1, len(text) - overlap), step))
                for i, at in enumerate(starts):
                    end = len(text) if i + 1 == len(starts) else at + step + overlap
                    yield pa.RecordBatch.from_pydict({"row_key": [key], "doc_id": [doc_id], "n_bytes": [n_bytes], "overlap": [overlap], "chunk": [i], "n_chunks": [len(starts)], "at": [at], "text": [text[at:end]]}, CHUNK_ARROW)

    return run


COUNTED = "doc_id long, n_bytes long, n_tokens long"
CHUNKS = "row_key long, doc_id long, n_bytes long, overlap int, chunk int, n_chunks int, at long"
CHUNK_ARROW = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("overlap", pa.int32()), ("chunk", pa.int32()), ("n_chunks", pa.int32()), ("at", pa.int64()), ("text", pa.string())])
EDGES = "total long, head_at array<long>, head_before array<long>, tail_at array<long>, tail_before array<long>"


def chunk_borders(text: str, model_path: str) -> tuple[int, list[int], list[int]]:
    """Tokens of a chunk; its stable token borders with the number of tokens before each."""
    pairs = joined_pairs(model_path)
    model = load(model_path)
    pieces = model.encode(text, return_type="proto").pieces
    at, before, place, after_byte = [], [], 0, False
    for i, piece in enumerate(pieces):
        is_byte = model.is_byte(piece.id)
        # pieces for single bytes may start within a character
        if not (is_byte or after_byte) and is_stable(text, place, pairs):
            at.append(place)
            before.append(i)
        place, after_byte = place + len(piece.surface), is_byte
    return len(pieces), at, before


def _encode_chunks(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [c for c in batch.schema.names if c != "text"]
            out: dict[str, list] = {k: batch.column(k).to_pylist() for k in keys}
            out |= {k: [] for k in ("total", "head_at", "head_before", "tail_at", "tail_before")}
            for text, at, overlap in zip(batch.column("text").to_pylist(), out["at"], out["overlap"], strict=True):
                total, where, before = chunk_borders(text, model_path)
                head = [(at + p, b) for p, b in zip(where, before, strict=True) if p <= overlap]
                tail = [(at + p, b) for p, b in zip(where, before, strict=True) if p >= len(text) - overlap]
                out["total"].append(total)
                for name, found in (("head", head), ("tail", tail)):
                    out[f"{name}_at"].append([p for p, _ in found])
                    out[f"{name}_before"].append([b for _, b in found])
            schema = pa.schema([*(f for f in CHUNK_ARROW if f.name != "text"), ("total", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("head_at", "head_before", "tail_at", "tail_before"))])
            yield pa.RecordBatch.from_pydict(out, schema)

    return run


def splice(chunks: pd.DataFrame) -> int | None:
    """Tokens of the whole text, or None when some overlap has no common stable border."""
    rows = chunks.sort_values("chunk").to_dict("records")
    total, skip = 0, 0
    for left, right in zip(rows, rows[1:], strict=False):
        tail = dict(zip(left["tail_at"], left["tail_before"], strict=True))
        common = next(((tail[p], b) for p, b in zip(right["head_at"], right["head_before"], strict=True) if p in tail and tail[p] >= skip), None)
        if common is None:
            return None
        total += common[0] - skip
        skip = common[1]
    return total + rows[-1]["total"] - skip


def _splice(pdf: pd.DataFrame) -> pd.DataFrame:
    n = splice(pdf)
    first = pdf.iloc[0]
    return pd.DataFrame({"row_key": [first["row_key"]], "doc_id": pd.array([None if pd.isna(first["doc_id"]) else int(first["doc_id"])], "Int64"), "n_bytes": [first["n_bytes"]], "n_tokens": pd.array([n], "Int64")})


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, huge_chars: int = 1 << 15, chunk_chars: int = 1 << 14, overlap: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id, text).

    Null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null.
    Repeated rows give a row each. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = null_free(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    if not takes_text_as_it_is(model_path):
        huge_chars = (1 << 31) - 1
    chars = F.char_length("text")
    counted = base.filter(chars <= huge_chars).mapInArrow(_count_whole(model_path), COUNTED)
    # huge texts are few and stored once, each with a key of its own, equal rows too
    salted = row_salted(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    left = materialize(salted.filter(chars > huge_chars).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.col("salt").alias("row_key")), "huge")
    todo, parts = left, [counted]
    while not todo.isEmpty():
        chunks = todo.select("doc_id", "text", "n_bytes", F.lit(overlap).alias("overlap"), "row_key").mapInArrow(_cut(chunk_chars), f"{CHUNKS}, text string")
        # few bytes but much work: about a million characters a task, whatever adaptive execution would join by size
        size = todo.agg(F.sum(F.char_length("text").cast("long"))).first()[0]
        edges = chunks.repartition(min(max(1, size >> 20), 1 << 16), "row_key", "chunk").mapInArrow(_encode_chunks(model_path), f"{CHUNKS}, {EDGES}")
        spliced = materialize(edges.groupBy("row_key").applyInPandas(_splice, f"row_key long, {COUNTED}"), "tokens")
        parts.append(spliced.filter("n_tokens is not null").drop("row_key"))
        # where no common place was found, overlaps grow until a chunk holds the whole text
        todo, overlap = left.join(spliced.filter("n_tokens is null").select("row_key"), "row_key", "left_semi"), overlap * 8
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
