"""Quality scores: random Fourier features, ridge normal equations, isotonic calibration.

Document statistics (shares of character classes, word shapes, repetition,
function words) are standardised and mapped to random Fourier features, which
approximate a Gaussian kernel. Each partition sums its normal equations by
fold; sums of sums fit a ridge regression. Out-of-fold scores, binned, are
calibrated by pool-adjacent-violators.

The fit reads a sample of labelled rows of at most about ``fit_rows`` rows,
which therefore may be broadcast; scoring is one map over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rolling
from .common import prepare, release_memory
from .html_text import STOP_WORDS
from .substring_dedup import INSIDE

FOLDS = 5
BINS = 2048
UPPER, LOWER, DIGIT, SPACE, LINE_END, STOP_MARK, SYMBOL, WIDE, OTHER = range(9)
CLASSES = np.full(256, OTHER, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[[9, 11, 12, 13, 32]], CLASSES[10] = UPPER, LOWER, DIGIT, SPACE, LINE_END
CLASSES[[ord(c) for c in ".,;:?'\"()-"]] = STOP_MARK
CLASSES[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]!"]] = SYMBOL
CLASSES[128:] = WIDE


def _stop_hashes() -> np.ndarray:
    texts = sorted({w.encode() for s in STOP_WORDS for w in (s, s.capitalize())})
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = rolling.split_words(data, np.cumsum([0, *map(len, texts)]), INSIDE)
    return np.sort(rolling.word_hashes(data, words))


def statistics(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Document statistics, one row for each text, from the whole text."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    byte_row = np.repeat(np.arange(rows), size)
    kinds = CLASSES[data]
    counts = np.bincount(byte_row * 9 + kinds, minlength=rows * 9).reshape(rows, 9)
    words = rolling.split_words(data, offsets, INSIDE)
    n = np.diff(words.first)
    some, per_word = np.maximum(size, 1), np.maximum(n, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.row, mask, rows) / per_word

    length = (words.end - words.start).astype(float)
    mean = share(length)
    hashes = rolling.word_hashes(data, words) if len(data) else np.empty(0, np.uint64)
    by_row = rolling.mix(hashes + words.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(by_row, return_index=True)
    distinct = np.bincount(words.row[first], minlength=rows) / per_word
    same_next = np.zeros(len(hashes), bool)
    same_next[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    lower = np.concatenate([[0], np.cumsum(kinds == LOWER)])
    upper = np.concatenate([[0], np.cumsum(kinds == UPPER)])
    shouted = (lower[words.end] == lower[words.start]) & (upper[words.end] - upper[words.start] > 1) if len(words.start) else np.empty(0, bool)
    ending = kinds[words.end - 1] if len(words.start) else np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)
    columns = [
        np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(share(length**2) - mean**2, 0)), distinct, share(same_next), share(stop[at] == hashes), share(shouted),
        share(ending == SYMBOL), share(ending == STOP_MARK), share((length == 1) & (ending == SYMBOL)), np.log1p(counts[:, LINE_END]), counts[:, LINE_END] / per_word,
        *(counts[:, k] / some for k in (UPPER, LOWER, DIGIT, SPACE, STOP_MARK, SYMBOL, WIDE, OTHER)),
    ]
    return np.stack([np.asarray(c, float) for c in columns], axis=1)


def column_statistics(column: pa.Array, stop: np.ndarray) -> np.ndarray:
    parts = [statistics(*rolling.flat(column, lo, hi), stop) for lo, hi in rolling.text_slices(column)]
    return np.concatenate(parts) if parts else np.empty((0, 21))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    direction: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    raw: np.ndarray | None = None  # calibration: raw scores and their probabilities
    probability: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        z = np.cos((x - self.mean) / self.scale @ self.direction + self.phase) * np.sqrt(2 / len(self.phase))
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x) @ self.weights, self.raw, self.probability), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators on points sorted by x; centre and mean of each block."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    out = np.array(blocks)
    return out[:, 0] / out[:, 2], out[:, 1] / out[:, 2]


STATS = pa.schema([("fold", pa.int32()), ("label", pa.float64()), ("x", pa.list_(pa.float64()))])


def _statistics_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stop = _stop_hashes()
    for batch in batches:
        x = column_statistics(batch.column(2), stop)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), STATS.field("x").type)], STATS.names)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            z, fold, y = model.features(_matrix(batch.column(2))), np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                have = sums.setdefault(k, [np.zeros((z.shape[1], z.shape[1])), np.zeros(z.shape[1])])
                have[0] += own.T @ own
                have[1] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_pydict({"fold": list(sums), "gram": [g.tobytes() for g, _ in sums.values()], "moment": [m.tobytes() for _, m in sums.values()]}, EQUATIONS)

    return run


EQUATIONS = pa.schema([("fold", pa.int32()), ("gram", pa.binary()), ("moment", pa.binary())])


def _add(table: pa.Table) -> pa.Table:
    out = {c: [np.sum([np.frombuffer(x) for x in table.column(c).to_pylist()], axis=0).tobytes()] for c in ("gram", "moment")}
    return pa.Table.from_pydict({"fold": [table.column("fold")[0].as_py()], **out}, EQUATIONS)


def _raw_scores(model: Model, weights: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, fold = model.features(_matrix(batch.column(2))), batch.column(0).to_pylist()
                raw = np.array([row @ weights[k] for row, k in zip(z, fold, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, -1, 2) * BINS).astype(np.int64)), batch.column(1)], ["bin", "label"])

    return run


def fold_of(doc_id):
    """crc32 of the id's text modulo 5; a null id has the empty text."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % FOLDS).cast("int")


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 200_000, fourier: int = 256, ridge: float = 1e-3, seed: int = 5) -> Model:
    """A model of labels.quality from documents outside fold 0.

    Several labels of one id are averaged. Labels that are null, or of a null
    or unknown id, are ignored. Without any label every score is 0.5.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label")).filter("doc_id is not null and label is not null")
    usable = usable.withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 0")
    share = min(1.0, fit_rows / max(1, usable.count()))
    sample = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = sample.groupBy("doc_id").agg(F.avg("label").alias("label"), F.first("fold").alias("fold"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most about fit_rows rows of three numbers: a bounded broadcast
    known = texts.join(F.broadcast(sample), "doc_id").select("fold", "label", "text")
    x = known.mapInArrow(_statistics_map, "fold int, label double, x array<double>").persist()
    try:
        width = len(STATISTIC_NAMES)
        moments = x.select(*(F.struct(F.avg(F.col("x")[i]).alias("m"), F.stddev_pop(F.col("x")[i]).alias("s")).alias(f"c{i}") for i in range(width))).first()
        rng = np.random.Generator(np.random.PCG64(seed))
        mean = np.array([m["m"] or 0.0 for m in moments])
        scale = np.array([m["s"] or 1.0 for m in moments])
        model = Model(mean, scale, rng.normal(size=(width, fourier)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, fourier))
        if moments[0]["m"] is None:
            return model
        partial = x.coalesce(16).mapInArrow(_equations(model), "fold int, gram binary, moment binary")
        sums = {r["fold"]: (np.frombuffer(r["gram"]).reshape(fourier + 1, -1), np.frombuffer(r["moment"])) for r in partial.groupBy("fold").applyInArrow(_add, "fold int, gram binary, moment binary").collect()}  # one row a fold

        def solve(folds) -> np.ndarray:
            gram, moment = sum(sums[k][0] for k in folds), sum(sums[k][1] for k in folds)
            return np.linalg.solve(gram + ridge * max(gram[-1, -1], 1) * np.diag([*[1 / fourier] * fourier, 1e-9]), moment)

        model.weights = solve(list(sums))
        held = {k: solve([j for j in sums if j != k] or [k]) for k in sums}
        bins = x.mapInArrow(_raw_scores(model, held), "bin long, label double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("y")).orderBy("bin").collect()  # at most 3 * BINS + 1 rows
        model.raw, model.probability = isotonic(np.array([r["bin"] / BINS for r in bins]), np.array([r["y"] for r in bins]), np.array([r["n"] for r in bins], float))
        return model
    finally:
        x.unpersist()


STATISTIC_NAMES = (
    "log bytes", "log words", "mean word length", "word length deviation", "distinct words", "words equal to the one before", "stop words", "shouted words", "words ending in a symbol",
    "words ending in punctuation", "lone symbols", "log lines", "lines a word", "upper", "lower", "digit", "space", "punctuation", "symbol", "wide", "other",
)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stop = _stop_hashes()
        for batch in batches:
            if batch.num_rows:
                scores = model.score(column_statistics(batch.column(1), stop))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["src", "score"])
        release_memory()

    return run


def score_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, carry: list[str] | None = None, **fitting) -> DataFrame:
    """(src, doc_id, held_out, score, predicted) of every row; src holds the columns ``carry``.

    Only the text makes the score. Null and empty texts have all-zero counts
    and are scored like any text. Null ids are in fold 0. Repeated rows give a
    row each. Columns of any name may be present.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, **fitting)
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in (carry or ["doc_id"]))).alias("src"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scored = base.mapInArrow(_score(model), T.StructType([base.schema["src"], T.StructField("score", T.DoubleType())]))
    doc_id = F.col("src.doc_id").cast("long")
    return scored.select("src", doc_id.alias("doc_id"), (fold_of(doc_id) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
