"""Removal of repeated word windows by counted Rabin-Karp hashes.

Every window of ``window`` words of every text is hashed. Texts are dealt into
groups of bounded size; a group sends the leading ``bits`` of each of its
distinct hashes once, sorted and packed by bucket, with a bit for "more than
once in this group", so that a window in a third of all texts still costs a few
bytes from each group. Buckets count over the whole corpus and answer with one
bit for each hash: may it be repeated?

Of those windows that may be, the groups then send two full hashes by
independent bases, and the buckets decide by all 128 bits. So a short first
hash costs no correctness, only more windows in the second count. With the
bucket, which comes from a third hash, two different windows among the 10**13
of 100 TB are taken for one with a probability below 1e-12 for the whole
corpus. Last, the groups hash again and remove every word under a repeated
window.

Group and bucket sizes both grow with the square root of the corpus, so the
packed rows stay large and no task outgrows its memory (100 TB: 64 MB of text a
group, about 10**8 hashes a bucket). Rows are dealt by their place in the input
and not by their content, so equal rows spread over all groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rolling
from .common import null_free, prepare, row_salted, text_bytes

INSIDE = np.ones(256, bool)
INSIDE[[0x20, *range(0x09, 0x0E)]] = False
SECOND_BASE, THIRD_BASE = 0xD6E8FEB86659FD93 | 1, 0xBF58476D1CE4E5B9 | 1
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def layout(total_bytes: int) -> tuple[int, int]:
    """Numbers of groups and of buckets for so much text."""
    root = math.sqrt(total_bytes / 1e9)
    group = min(max(1e6 * root, 1 << 18), 64 << 20)
    least = 32 if total_bytes < 16e6 else 256
    return max(least, math.ceil(total_bytes / group)), int(min(max(512 * root, least), 1 << 18))


class Group:
    """All windows of a group's texts: word lists by slice, starts, hashes and buckets."""

    def __init__(self, column: pa.Array, window: int, buckets: int, bits: int):
        self.slices, self.window = [], window
        hashes, bucket, self.own = [], [], []
        for lo, hi in rolling.text_slices(column):
            data, offsets = rolling.flat(column, lo, hi)
            words = rolling.split_words(data, offsets, INSIDE)
            own = rolling.word_hashes(data, words)
            start, found = rolling.windows(own, words.row, window)
            second = rolling.mix(rolling.span_hash(rolling.prefix_sums(own, SECOND_BASE), start, start + window, SECOND_BASE))
            self.slices.append((lo, hi, data, offsets, words, start))
            self.own.append(own)
            hashes.append(found)
            bucket.append(((second >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32))
        self.hashes = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.bucket = np.concatenate([np.empty(0, np.uint64), *bucket]).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
        self.short = self.hashes >> np.uint64(64 - bits)

    def candidates(self, flags: np.ndarray):
        """Places, hashes and third hashes of the windows that may be repeated."""
        order, new, _, _ = distinct(self.short, self.bucket)
        may = np.zeros(len(self.hashes), bool)
        if len(may):
            may[order] = flags[np.cumsum(new) - 1]
        third, done = [np.empty(0, np.uint64)], 0
        for (*_, start), own in zip(self.slices, self.own, strict=True):
            at = start[may[done : done + len(start)]]
            done += len(start)
            third.append(rolling.mix(rolling.span_hash(rolling.prefix_sums(own, THIRD_BASE), at, at + self.window, THIRD_BASE)) if len(at) else third[0])
        places = np.flatnonzero(may)
        return places, self.hashes[places], np.concatenate(third)


def distinct(hashes: np.ndarray, bucket: np.ndarray, third: np.ndarray | None = None):
    """Order by (bucket, hash, third), first of each equal run therein, and each run's length."""
    order = np.argsort(hashes) if third is None else np.lexsort((third, hashes))
    order = order[np.argsort(bucket[order], kind="stable")]
    h, b = hashes[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1])
    if third is not None:
        t = third[order]
        new[1:] |= t[1:] != t[:-1]
    first = np.flatnonzero(new)
    return order, new, first, np.diff(np.append(first, len(h)))


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text")
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


SENT = pa.schema([("bucket", pa.int32()), ("grp", pa.int32()), ("n", pa.int64()), ("hashes", pa.binary()), ("again", pa.binary())])
SENT_SQL = "bucket int, grp int, n long, hashes binary, again binary"


def send(grp: int, bucket: np.ndarray, raw: np.ndarray, again: np.ndarray) -> pa.Table:
    """Rows of ``raw`` bytes packed by bucket, which ascends."""
    cuts = np.flatnonzero(np.diff(bucket.astype(np.int64))) + 1
    starts = np.concatenate([[0], cuts]) if len(bucket) else np.empty(0, np.int64)
    ends = np.concatenate([cuts, [len(bucket)]]) if len(bucket) else starts
    pairs = list(zip(starts.tolist(), ends.tolist(), strict=True))
    return pa.Table.from_pydict({"bucket": bucket[starts].astype(np.int32), "grp": np.full(len(starts), grp, np.int32), "n": ends - starts, "hashes": [raw[s:e].tobytes() for s, e in pairs], "again": [np.packbits(again[s:e]).tobytes() for s, e in pairs]}, SENT)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _send_short(window: int, buckets: int, bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = Group(_text(table), window, buckets, bits)
        order, _, first, count = distinct(group.short, group.bucket)
        raw = np.ascontiguousarray(group.short[order][first]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]
        return send(key[0].as_py(), group.bucket[order][first], raw, count > 1)

    return run


def _send_full(window: int, buckets: int, bits: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return SENT.empty_table()
        group = Group(_text(left), window, buckets, bits)
        places, hashes, third = group.candidates(_answers(right, 1))
        order, _, first, count = distinct(hashes, group.bucket[places], third)
        raw = np.stack([hashes[order][first], third[order][first]], axis=1)
        return send(key[0].as_py(), group.bucket[places][order][first], raw, count > 1)

    return run


FLAGS = pa.schema([("grp", pa.int32()), ("stage", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("repeated", pa.binary())])
FLAGS_SQL = "grp int, stage int, bucket int, n long, repeated binary"


def count_bucket(stage: int, width: int):
    """One bit for each hash of ``width`` bytes that a group sent to this bucket: is it repeated?"""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        raw = np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint8).reshape(-1, width)
        flags = np.concatenate([_bits(x, n) for x, n in zip(table.column("again").to_pylist(), sizes, strict=True)])
        words = np.zeros((len(raw), -(-width // 8) * 8), np.uint8)
        words[:, :width] = raw
        columns = np.ascontiguousarray(words).view("<u8").T
        order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(tuple(columns))
        same = np.ones(max(0, len(raw) - 1), bool)
        for column in columns:
            h = column[order]
            same &= h[1:] == h[:-1]
        more = np.zeros(len(raw), bool)
        more[1:] |= same
        more[:-1] |= same
        # a hash that only one group sent, but more than once, is repeated too
        flags[order] |= more
        ends = np.cumsum(sizes)
        bits = [np.packbits(flags[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return pa.Table.from_pydict({"grp": table.column("grp"), "stage": pa.array([stage] * len(sizes), pa.int32()), "bucket": table.column("bucket"), "n": table.column("n"), "repeated": pa.array(bits, pa.binary())}, FLAGS)

    return run


def _answers(table: pa.Table, stage: int) -> np.ndarray:
    rows = zip(*(table.column(c).to_pylist() for c in ("stage", "bucket", "n", "repeated")), strict=True)
    return np.concatenate([np.zeros(0, bool), *(_bits(raw, n) for _, _, n, raw in sorted(r for r in rows if r[0] == stage))])


KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", SPAN), ("kept_text", pa.string())])


def _remove(window: int, buckets: int, bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(_text(left), window, buckets, bits)
        places, hashes, third = group.candidates(_answers(right, 1))
        order, new, _, _ = distinct(hashes, group.bucket[places], third)
        repeated = np.zeros(len(group.hashes), bool)
        if len(places):
            repeated[places[order]] = _answers(right, 2)[np.cumsum(new) - 1]
        out: dict[str, list] = {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
        done = 0
        for lo, hi, data, offsets, words, start in group.slices:
            gone = rolling.covered(start[repeated[done : done + len(start)]], window, len(words.start))
            done += len(start)
            for row in range(hi - lo):
                own = gone[words.first[row] : words.first[row + 1]]
                texts = data[offsets[row] : offsets[row + 1]].tobytes().split()
                spans = []
                if own.any():
                    spans = [{"start": s, "end": e} for s, e in zip(*(x.tolist() for x in rolling.runs(own)), strict=True)]
                    at, kept = 0, []
                    for span in spans:
                        kept += texts[at : span["start"]]
                        at = span["end"]
                    texts = kept + texts[at:]
                out["n_words"].append(len(own))
                out["n_removed"].append(len(own) - len(texts))
                out["removed"].append(spans)
                out["kept_text"].append(b" ".join(texts).decode())
        return pa.Table.from_pydict({"doc_id": left.column("doc_id"), **out}, KEPT)

    return run


def remove_repeated_windows(docs: DataFrame, *, window: int = 35, bits: int = 40) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text) of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than ASCII white space. A word goes when it
    lies in a window whose words also start elsewhere, in the same text or
    another; windows are judged on the input. removed: maximal [start, end)
    runs of word numbers. kept_text: kept words joined by one space.

    Null and empty texts, and texts shorter than a window, lose nothing.
    Repeated rows are texts of their own, so both lose their windows. Null ids
    stay null. A very long text is held by one task. Other columns are ignored,
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    groups, buckets = layout(text_bytes(docs))
    base = null_free(row_salted(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    grouped = base.withColumn("grp", F.pmod("salt", F.lit(groups)).cast("int")).drop("salt")
    short = grouped.groupBy("grp").applyInArrow(_send_short(window, buckets, bits), SENT_SQL)
    may = short.groupBy("bucket").applyInArrow(count_bucket(1, -(-bits // 8)), FLAGS_SQL)
    full = grouped.groupBy("grp").cogroup(may.groupBy("grp")).applyInArrow(_send_full(window, buckets, bits), SENT_SQL)
    flags = may.union(full.groupBy("bucket").applyInArrow(count_bucket(2, 16), FLAGS_SQL))
    return grouped.groupBy("grp").cogroup(flags.groupBy("grp")).applyInArrow(_remove(window, buckets, bits), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string")
