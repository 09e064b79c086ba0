"""Packing of token sequences by a configuration linear program over lengths.

1. Texts are tokenized once, cut into pieces, and numbered by (task, length);
only numbers are stored. 2. The histogram of lengths, at most ``size`` rows
whatever the corpus, goes to the driver. 3. Multiplicative weights solve the
covering program "fewest configurations that hold every length's count". A
round prices a length by its tokens times its weight; a knapsack dynamic program
gives the best price of every amount of room, from which comes, for each length,
the best configuration that holds it. Those of nearly the best price of all are
taken as often as the counts allow, in whole sequences, until none is left.
Then weights grow exponentially with the share of a length that was not
covered, and the next round starts anew. The prices of each round bound the
optimum from below; the rounds end near that bound, and the best one counts.
What it leaves, a few sequences, goes to best-fit decreasing. 4. Every piece
finds its place from its number alone.
"""

from __future__ import annotations

import array
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, null_free, prepare, release_memory

CACHE_ENTRIES = 1 << 19
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
TWO_SPACES = re.compile(r"\s\s")
#: Up to here letters are the same in all Unicode versions that the two libraries may hold.
LATIN_END = "ɏ"


@lru_cache(maxsize=1)
def _libraries(json_path: str, ranks_path: str):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Tokenizer.from_file(json_path), fast


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes, equal to the tokenizer file's own.

    This vocabulary never joins a word with what follows a single space or line
    end, so equal words are encoded once per cache fill. Texts with runs of
    white space, with strings of special tokens, or with words beyond Latin
    letters go through the tokenizers library itself.
    """

    def __init__(self, json_path: str, ranks_path: str):
        self.full, self.fast = _libraries(json_path, ranks_path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.line_end = self.word("\n")

    def whole(self, text: str) -> bytes:
        return array.array("I", self.full.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        if text.isascii() or max(text) <= LATIN_END:
            return array.array("I", self.fast.encode_ordinary(text)).tobytes()
        return self.whole(text)

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if TWO_SPACES.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        lines = text.split("\n")
        words: list[str] = []
        for line in lines:
            # every word after the first takes the space before it
            first, *rest = line.split(" ")
            words.append(first)
            words += [" " + w for w in rest]
            words.append("\n")
        words.pop()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        new = {w for w in words if w not in known}
        if len(known) + len(new) > CACHE_ENTRIES:
            known.clear()
            new = set(words)
        for w in new:
            known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n % size or min(n, size)
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _tokenize(encoder: Callable[[], Encoder], size: int, end_id: int):
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # before the vocabulary and the cache of words come in
        encode, part = encoder(), TaskContext.get().partitionId()
        seen = [0] * (size + 1)
        for batch in batches:
            out: dict[str, list] = {n: [] for n in PIECES.names}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                    values = (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length])
                    seen[length] += 1
                    for name, value in zip(PIECES.names, values, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, PIECES)
        del encode
        release_memory()

    return run


# ---- the plan, on the histogram -------------------------------------------


@dataclass
class Plan:
    """Configurations as (number of sequences, {length: copies})."""

    size: int
    configurations: list[tuple[int, dict[int, int]]] = field(default_factory=list)

    def sequences(self) -> int:
        return sum(n for n, _ in self.configurations)

    def places(self) -> dict[str, np.ndarray]:
        """Rows (length, first number, copies in a sequence, first sequence, first offset), by length and number."""
        rows, numbered, base = [], {}, 0
        for n, config in self.configurations:
            offset = 0
            for length in sorted(config, reverse=True):
                copies = config[length]
                first = numbered.get(length, 0)
                rows.append((length, first, copies, base, offset))
                numbered[length] = first + copies * n
                offset += copies * length
            base += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        return {name: table[:, i].copy() for i, name in enumerate(("length", "first", "copies", "base", "offset"))}


def room_values(lengths: np.ndarray, prices: np.ndarray, size: int) -> np.ndarray:
    """The greatest total price of lengths within 0 .. ``size`` (copies unlimited); lengths ascend."""
    best = np.zeros(size + 1)
    for room in range(int(lengths[0]), size + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        best[room] = max(best[room - 1], (best[room - lengths[:fits]] + prices[:fits]).max())
    return best


def priced_configuration(first: int, lengths: np.ndarray, prices: np.ndarray, left: np.ndarray, best: np.ndarray, slack: float) -> tuple[float, dict[int, int]]:
    """The configuration with the ``first``-th length that is best by the table of room values, among what is left; and its price.

    Of lengths that are about as good the largest goes in: small ones close gaps later.
    """
    room, used = len(best) - 1 - int(lengths[first]), {first: 1}
    total, near = float(prices[first]), slack * best[-1]
    while room >= lengths[0]:
        fits = int(np.searchsorted(lengths, room, "right"))
        gain = best[room - lengths[:fits]] + prices[:fits]
        gain[left[:fits] == 0] = -1.0
        for k, n in used.items():
            if k < fits and n >= left[k]:
                gain[k] = -1.0
        most = gain.max()
        if most < 0:
            break
        k = int(np.flatnonzero(gain >= most - near)[-1])
        used[k] = used.get(k, 0) + 1
        total += float(prices[k])
        room -= int(lengths[k])
    return total, used


def fill(lengths: np.ndarray, need: np.ndarray, weights: np.ndarray, size: int, *, rounds: int = 100, rate: float = 0.01, most_slack: float = 0.1, reserve: float = 0.04) -> tuple[dict[tuple, int], np.ndarray]:
    """Whole configurations of nearly the best price, and what they leave of ``need``."""
    left, slack = need.copy(), 1e-3
    taken: dict[tuple, int] = {}
    for _ in range(rounds):
        open_ = np.flatnonzero(left)
        if not len(open_) or slack > most_slack:
            break
        own, kept = lengths[open_], (reserve * need[open_]).astype(np.int64)
        prices = own * weights[open_] * np.exp(-rate * (1 - left[open_] / need[open_]))
        best = room_values(own, prices, size)
        before, mine = int(left.sum()), np.maximum(left[open_] - kept, 0)
        # rare large lengths first: small ones fit in later
        for first in range(len(own) - 1, -1, -1):
            if not mine[first]:
                continue
            price, used = priced_configuration(first, own, prices, mine, best, slack / 4)
            if price < (1 - slack) * best[size]:
                continue
            at, copies = np.array(list(used)), np.array(list(used.values()))
            n = int((mine[at] // copies).min())
            mine[at] -= n * copies
            key = tuple(sorted((int(own[k]), c) for k, c in used.items()))
            taken[key] = taken.get(key, 0) + n
        left[open_] -= np.maximum(left[open_] - kept, 0) - mine
        if left.sum() > 0.9 * before:
            slack *= 2  # nearly optimal ones are used up
    return taken, left


@dataclass
class Cover:
    """What the program placed: configurations, the rest, and the dual bound on sequences."""

    taken: list[tuple[int, dict[int, int]]]
    rest: dict[int, int]
    bound: int

    def sequences(self, size: int) -> int:
        return sum(n for n, _ in self.taken) + sum(n for n, _ in best_fit(self.rest, size))


def multiplicative_weights(histogram: dict[int, int], size: int, *, rounds: int = 12, rate: float = 1.0, near: float = 5e-4) -> Cover:
    """Whole configurations that cover the histogram, nearly as few as the program allows."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], np.int64)
    weights, bound, found, fewest = np.ones(len(lengths)), 0, None, math.inf
    for _ in range(rounds):
        prices = lengths * weights
        bound = max(bound, math.ceil(float((need * prices).sum() / room_values(lengths, prices, size)[size]) - 1e-6))
        taken, left = fill(lengths, need, weights, size)
        cover = Cover([(n, dict(key)) for key, n in taken.items()], {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}, bound)
        if (n := cover.sequences(size)) < fewest:
            found, fewest = cover, n
        if fewest <= bound * (1 + near):
            break
        # lengths that were not covered weigh more from now on
        weights = weights * np.exp(rate * (left / need - (left * lengths).sum() / (need * lengths).sum()))
    return Cover(found.taken, found.rest, bound)


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing on counts: equal bins move together."""
    rooms: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        for room in sorted(r for r in rooms if r >= length):
            if not n:
                break
            each, groups = room // length, rooms.pop(room)
            while groups and n:
                bins, config = groups.pop()
                full = min(bins, n // each)
                moves = [(full, each), (1, n - full * each)] if full < bins and n - full * each else [(full, each)]
                for k, copies in moves:
                    if k:
                        rooms.setdefault(room - copies * length, []).append((k, config | {length: copies}))
                        n, bins = n - k * copies, bins - k
                if bins:
                    groups.append((bins, config))
            if groups:
                rooms.setdefault(room, []).extend(groups)
        if n:
            each = size // length
            if n // each:
                rooms.setdefault(size - each * length, []).append((n // each, {length: each}))
            if n % each:
                rooms.setdefault(size - n % each * length, []).append((1, {length: n % each}))
    return [x for groups in rooms.values() for x in groups]


def make_plan(histogram: dict[int, int], size: int) -> Plan:
    """The configurations of the program, and best fit for its rest."""
    cover = multiplicative_weights(histogram, size)
    return Plan(size, cover.taken + best_fit(cover.rest, size))


def _place(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for frame in frames:
            length, number = frame["length"].to_numpy(), frame["number"].to_numpy()
            # the plan's rows of this length, then among them the last that starts at or before this number
            lo, hi = np.searchsorted(p["length"], length, "left"), np.searchsorted(p["length"], length, "right")
            while (lo + 1 < hi).any():
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (p["first"][mid] <= number)
                hi = np.where((lo + 1 < hi) & ~right, mid, hi)
                lo = np.where(right, mid, lo)
            within = number - p["first"][lo]
            yield pd.DataFrame({
                "doc_id": frame["doc_id"], "piece": frame["piece"], "start": frame["start"], "length": length, "ids_crc32": frame["ids_crc32"],
                "sequence_id": p["base"][lo] + within // p["copies"][lo], "offset": p["offset"][lo] + within % p["copies"][lo] * length,
            })

    return run


def pack(docs: DataFrame, json_path: str, ranks_path: str, *, size: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs`` (doc_id, text).

    A document's tokens are its text's ids and ``end_id``. Null and empty texts
    have the end alone. Repeated rows and null ids are packed like all others,
    other columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = null_free(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    pieces = materialize(base.mapInArrow(_tokenize(lambda: Encoder(json_path, ranks_path), size, end_id), PIECES_SQL), "pieces")
    counts = materialize(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = pieces.join(starts, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    places = spark.sparkContext.broadcast(make_plan(histogram, size).places() if histogram else Plan(size).places())
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInPandas(_place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
