"""Benchmark decontamination by a broadcast set of normalised n-gram hashes.

Words are maximal runs of ASCII letters and digits and of all non-ASCII bytes,
after lower-casing A-Z. Each benchmark item gives its windows of ``n`` words,
or itself as one window when it is shorter. Documents are scanned where they
lie: one map over the table, no shuffle. A hash hit is verified against the
window's words before it counts.

The broadcast is bounded: what the windows take in memory is summed first, and
above ``broadcast_bytes`` they are split into that many blocks by hash. Blocks
are scanned one after the other; each leaves only the rows that it hits, and
its broadcast goes before the next one comes. Hits of all blocks are merged by
row, and only then texts are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import materialize, null_free, prepare, row_salted

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[0x30:0x3A] = INSIDE[0x61:0x7B] = INSIDE[0x80:] = True
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FILTER_BITS = 20
#: What a window takes in memory besides its text: its bytes object, entries of two tables and a list of items.
ENTRY_BYTES = 320


def _joined(low: bytes, words: rolling.Words, first: int, n: int) -> bytes:
    return b" ".join(low[s:e] for s, e in zip(words.start[first : first + n].tolist(), words.end[first : first + n].tolist(), strict=True))


def _item_windows(n: int):
    """(item_id, text) to its distinct windows (window, n_words, item_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"window": [], "n_words": [], "item_id": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = LOWER[np.frombuffer(text.encode(), np.uint8)]
                words = rolling.split_words(data, np.array([0, len(data)]), INSIDE)
                size, raw = min(n, len(words.start)), data.tobytes()
                found = {_joined(raw, words, i, size) for i in range(len(words.start) - size + 1)} if size else set()
                out["window"] += found
                out["n_words"] += [size] * len(found)
                out["item_id"] += [item] * len(found)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("window", pa.binary()), ("n_words", pa.int32()), ("item_id", pa.string())]))

    return run


class Windows:
    """Benchmark windows for lookup by hash, then by their words."""

    def __init__(self, rows: list[tuple[bytes, int, str | None]]):
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for window, size, item in rows:
            have = self.items.setdefault(bytes(window), [])
            if item is not None:
                have.append(item)
            by_length.setdefault(size, set()).add(bytes(window))
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, found in by_length.items():
            texts = sorted(found)
            data = np.frombuffer(b"".join(texts), np.uint8)
            words = rolling.split_words(data, np.cumsum([0, *map(len, texts)]), INSIDE)
            _, hashes = rolling.windows(rolling.word_hashes(data, words), words.row, size)
            near = np.zeros(1 << FILTER_BITS, bool)
            near[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.hashes[size] = np.unique(hashes), near

    def hits(self, low: bytes, words: rolling.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every window that occurs."""
        for size, (known, near) in self.hashes.items():
            start, found = rolling.windows(hashes, words.row, size)
            may = np.flatnonzero(near[found >> np.uint64(64 - FILTER_BITS)])
            at = np.minimum(np.searchsorted(known, found[may]), len(known) - 1)
            for first in start[may[known[at] == found[may]]].tolist():
                items = self.items.get(_joined(low, words, first, size))
                if items is not None:
                    yield first, size, items


SCANNED = "n_words long, hit_spans array<struct<start: long, end: long>>, items array<string>, clean_text string"


def _cut(data: np.ndarray, words: rolling.Words, spans: list[tuple[int, int]]) -> str:
    """The text without spans of its words, given as numbers within ``words``."""
    at, kept = 0, []
    for s, e in spans:
        kept.append(data[at : words.start[s]].tobytes())
        at = words.end[e - 1]
    return b"".join([*kept, data[at:].tobytes()]).decode()


def _scan(shared):
    """(src, text, ...) to (src, SCANNED): runs of hit words, items, and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        for batch in batches:
            column = batch.column(1)
            for lo, hi in rolling.text_slices(column):
                data, offsets = rolling.flat(column, lo, hi)
                low = LOWER[data]
                words = rolling.split_words(low, offsets, INSIDE)
                hit = np.zeros(len(words.start), bool)
                items: dict[int, set[str]] = {}
                raw = low.tobytes()
                for first, size, found in windows.hits(raw, words, rolling.word_hashes(low, words)):
                    hit[first : first + size] = True
                    items.setdefault(int(words.row[first]), set()).update(found)
                rows = hi - lo
                spans: list[list] = [[] for _ in range(rows)]
                texts: list[str | None] = [None] * rows
                for row in items:
                    a, b = words.first[row], words.first[row + 1]
                    own = rolling.Words(words.start[a:b] - offsets[row], words.end[a:b] - offsets[row], words.row[a:b], words.first)
                    runs = list(zip(*(x.tolist() for x in rolling.runs(hit[a:b])), strict=True))
                    spans[row] = [{"start": s, "end": e} for s, e in runs]
                    texts[row] = _cut(data[offsets[row] : offsets[row + 1]], own, runs)
                out = [batch.column(0).slice(lo, rows), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, SPAN), pa.array([sorted(items.get(r, ())) for r in range(rows)], pa.list_(pa.string())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["src", "n_words", "hit_spans", "items", "clean_text"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src, text, spans, items) of all blocks to (src, SCANNED)."""
    for batch in batches:
        column = batch.column(1)
        out: dict[str, list] = {"n_words": [], "hit_spans": [], "items": [], "clean_text": []}
        found = list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
        for lo, hi in rolling.text_slices(column):
            for row in range(lo, hi):
                data, offsets = rolling.flat(column, row, row + 1)
                words = rolling.split_words(LOWER[data], offsets, INSIDE)
                spans, items = found[row]
                hit = np.zeros(len(words.start), bool)
                for span in spans or ():
                    hit[span["start"] : span["end"]] = True
                runs = list(zip(*(x.tolist() for x in rolling.runs(hit)), strict=True))
                out["n_words"].append(len(hit))
                out["hit_spans"].append([{"start": s, "end": e} for s, e in runs])
                out["items"].append(sorted(set(items or ())))
                out["clean_text"].append(_cut(data, words, runs) if spans else None)
        kinds = (pa.int64(), SPAN, pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True))], ["src", *out])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, broadcast_bytes: int = 64 << 20, with_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(src, doc_id, n_words, hit_spans, items, n_hit, contaminated[, clean_text]) of every row; src holds the columns ``carry``.

    hit_spans: maximal runs of hit words as [start, end) word numbers. items:
    ids, as sorted strings, of items with a window in the row. clean_text: the
    text without the hit spans; null where nothing was hit.

    Null texts have no words. Windows of an item with null item_id hit words but
    give no id. Items of the same id count once. An empty benchmark hits nothing,
    an empty table gives no rows. Repeated rows give a row each. A very long text
    is held by one task. Columns of any name may be present.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = null_free(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    found = materialize(items.mapInArrow(_item_windows(n), "window binary, n_words int, item_id string").distinct(), "windows")
    size = int(found.select(F.sum(F.octet_length("window") + ENTRY_BYTES)).first()[0] or 0)
    blocks = max(1, -(-size // broadcast_bytes))
    found = found.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    src = F.struct(*(F.col(f"`{c}`") for c in (carry or ["doc_id"]))).alias("src")

    def shared(block: int):
        rows = found.filter(F.col("block") == block).select("window", "n_words", "item_id").toLocalIterator()
        return spark.sparkContext.broadcast(Windows([tuple(r) for r in rows]))

    if blocks == 1:
        base = null_free(docs.select(src, "text"))
        out = base.mapInArrow(_scan(shared(0)), T.StructType([base.schema["src"], *T.StructType.fromDDL(SCANNED)]))
    else:
        salted = null_free(row_salted(docs, src, F.col("text")))
        by_salt = salted.select(F.struct("salt").alias("src"), "text")
        hits = []
        for block in range(blocks):
            windows = shared(block)
            scan = by_salt.mapInArrow(_scan(windows), T.StructType([by_salt.schema["src"], *T.StructType.fromDDL(SCANNED)]))
            hits.append(materialize(scan.filter(F.size("hit_spans") > 0).select("src.salt", "hit_spans", "items"), "hits"))
            windows.destroy()
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        every = every.groupBy("salt").agg(F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.flatten(F.collect_list("items")).alias("items"))
        joined = salted.join(every, "salt", "left").select("src", "text", "hit_spans", "items")
        out = joined.mapInArrow(_merge, T.StructType([joined.schema["src"], *T.StructType.fromDDL(SCANNED)]))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda sum_, x: sum_ + x["end"] - x["start"])
    out = out.withColumn("n_hit", n_hit)
    return out.select("src", F.col("src.doc_id").cast("long").alias("doc_id"), "n_words", "hit_spans", "items", "n_hit", (F.col("n_hit") > 0).alias("contaminated"), *(["clean_text"] if with_text else []))
