"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are standardized and mapped by random Fourier features, whose inner
products approximate a Gaussian kernel.  As an addition the standardized statistics themselves are
features too, so that the score goes on where the kernel has no labelled neighbours.  Partitions sum
the normal equations of ridge regression, so any number of labelled rows gives one matrix of fixed
size to the driver.  Features lie on a grid and are summed as integers, so the sums don't depend on
how rows are dealt.  Ridge outputs are calibrated by isotonic regression over a fixed number of bins,
on learning rows that the ridge hasn't seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import materialize, small_batches

FEATURES = 192
RIDGE = 1e-2
BINS = 512
SEED = 7
THRESHOLD = 0.3
#: Share of the uncalibrated output in a score; it orders texts that calibration leaves equal.
TIE_SHARE = 1e-3
#: Rows with this remainder of crc32(doc_id) modulo 5 are held out; of the others, those with the second one calibrate.
HELD_OUT_REMAINDER, CALIBRATION_REMAINDER = 0, 1
#: Features of the normal equations are multiples of 1 / GRID.
GRID = 4096

_CLASSES = np.zeros(256, np.uint8)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:'\"()-", b"!?", b"|", b"#*$%&<>~^=+@\\/{}[]_`"), 1):
    _CLASSES[list(_chars)] = _k
_CLASSES[128:] = 1
NAMES = (
    "log_bytes", "log_words", "log_word_bytes", "upper", "digit", "punctuation", "exclamation", "bar", "symbol", "line_end", "non_ascii",
    "capital_words", "marked_words", "distinct_words", "most_frequent_word", "adjacent_equal", "repeated_pairs", "log_line_bytes", "short_words", "long_words",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; an empty text has zeros."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(NAMES)))
    if not len(data):
        return out
    size = np.diff(offsets)
    owner = np.repeat(np.arange(rows), size)
    kinds = np.bincount(owner * 10 + _CLASSES[data], minlength=rows * 10).reshape(rows, 10).astype(float)
    total = np.maximum(size, 1)
    starts, ends, row = tb.words(data, offsets)
    n = np.bincount(row, minlength=rows)
    per = np.maximum(n, 1)
    length = ends - starts

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(row[mask], minlength=rows) / per

    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(n)
    out[:, 2] = np.log1p(np.bincount(row, length, minlength=rows) / per)
    out[:, 3] = kinds[:, 2] / np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    for k, kind in ((4, 3), (5, 6), (6, 7), (7, 8), (8, 9), (9, 5)):
        out[:, k] = kinds[:, kind] / total
    out[:, 10] = np.bincount(owner, data >= 128, minlength=rows) / total
    if len(starts):
        out[:, 11] = share(_CLASSES[data[starts]] == 2)
        out[:, 12] = share(_CLASSES[data[ends - 1]] >= 7)
        out[:, 18], out[:, 19] = share(length <= 3), share(length >= 15)
        h = tb.span_hashes(tb.prefix_hash(data, tb.LOWER_VALUES), starts, ends)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[:, 15] = share(same)
        first = np.searchsorted(row, np.arange(rows + 1))
        pairs = h[:-1] * tb.U64(0xD1342543DE82EF95) + h[1:]
        for i in range(rows):
            lo, hi = first[i], first[i + 1]
            if hi > lo:
                times = np.unique(h[lo:hi], return_counts=True)[1]
                out[i, 13], out[i, 14] = len(times) / (hi - lo), times.max() / (hi - lo)
            if hi - lo > 1:
                out[i, 16] = 1 - len(np.unique(pairs[lo : hi - 1])) / (hi - lo - 1)
    out[:, 17] = np.log1p(size / (kinds[:, 5] + 1))
    return out


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text."""

    @tb.released
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            for lo, hi in tb.slices(offsets):
                part = offsets[lo : hi + 1]
                x = statistics(data[part[0] : part[-1]], part - part[0])
                flat = pa.array(x.astype(np.float32).reshape(-1))
                column = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), column], ["doc_id", "x"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(compute, "doc_id long, x array<float>")


@dataclass
class Model:
    """Standardization, random frequencies, ridge weights, and the calibration's points."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        waves = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.clip(self.raw(x), -1, 2)
        level = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.clip(raw, 0, 1)
        return np.clip((1 - TIE_SHARE) * level + TIE_SHARE * (raw + 1) / 3, 0, 1)


def matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES)).astype(float)


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The nondecreasing fit of least weighted squares, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.concatenate([np.full(int(n), m) for _, m, n in blocks]) if blocks else np.zeros(0)


def remainder() -> Column:
    """crc32 of the doc_id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def added(blocks: Iterator[np.ndarray], m: int) -> np.ndarray:
    total = np.zeros((m, m + 1), np.int64)
    for block in blocks:
        total += block
    return total


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, y) over stats (doc_id, x); labels that are null are left out.

    With no labelled row every score is one half.  Where no row is left for one of ridge and
    calibration, all rows serve for both.
    """
    found = stats.join(labels.where("y is not null").select("doc_id", F.col("y").cast("double").alias("y")), "doc_id")
    found = materialize(found.select("x", "y", (remainder() == CALIBRATION_REMAINDER).alias("calibrates")), "quality-train")
    learning, calibrating = found.where("not calibrates"), found.where("calibrates")
    if learning.isEmpty() or calibrating.isEmpty():
        learning = calibrating = found
    rows = learning.select("x", "y")
    d = len(NAMES)
    moments = rows.agg(F.count("*"), *(F.avg(F.get("x", F.lit(i))) for i in range(d)), *(F.stddev_pop(F.get("x", F.lit(i))) for i in range(d))).first()
    mean, scale = (np.array([v or 0.0 for v in moments[1 + k * d : 1 + (k + 1) * d]]).astype(np.float32).astype(float) for k in range(2))
    scale[scale < 1e-6] = 1.0
    rng = np.random.Generator(np.random.PCG64(SEED))
    frequencies = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES))
    model = Model(mean, scale, frequencies, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0))
    m = 1 + d + FEATURES

    @tb.released
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def products(batch: pa.RecordBatch) -> np.ndarray:
            # Whole numbers whose products and sums over a batch are exact in doubles.
            z = np.rint(model.features(matrix(batch, 0)) * GRID)
            y = np.rint(batch.column(1).to_numpy(zero_copy_only=False) * GRID)
            return (z.T @ np.hstack([z, y[:, None]])).astype(np.int64)

        a = added((products(b.slice(lo, 4096)) for b in batches for lo in range(0, b.num_rows, 4096)), m)
        if a.any():
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["sums"])

    @tb.released
    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = added((np.frombuffer(x.as_buffer(), np.int64).reshape(m, m + 1) for b in batches for x in b.column(0)), m)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary())], ["sums"])

    # A row a task, added in about as many groups as each of them has rows, then on the driver.
    per_task = rows.mapInArrow(sums, "sums binary")
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    total = per_task.repartition(groups).mapInArrow(combined, "sums binary").toArrow()
    normal = added((np.frombuffer(x.as_buffer(), np.int64).reshape(m, m + 1) for x in total["sums"]), m) / GRID**2
    square = normal[:, :m]
    n = moments[0] or 0
    if not n:
        model.weights = np.zeros(m)
        model.weights[0] = 0.5
        return model
    penalty = np.full(m, RIDGE * max(n, 1) / m)
    penalty[0] = 1e-9
    model.weights = np.linalg.solve(square + np.diag(penalty), normal[:, m])

    @tb.released
    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = ((np.clip(model.raw(matrix(batch, 0)), -1, 2) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(at, BINS - 1)), batch.column(1)], ["bin", "y"])

    table = calibrating.select("x", "y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").toArrow()
    model.knots = (table["bin"].to_numpy() + 0.5) / BINS * 3 - 1
    model.levels = isotonic(table["n"].to_numpy().astype(float), table["y"].to_numpy())
    return model


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of the labels that may be learnt from."""
    return labels.select(F.col("doc_id").cast("long"), F.col(label).alias("y")).where(remainder() != HELD_OUT_REMAINDER)


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """The rows of docs, with all their columns, whose own text scores THRESHOLD or more.

    Scores are those of scored(); rows are judged each, whatever their doc_id, null or repeated.
    Statistics are computed again on the way, which is cheaper than bringing scores to texts.
    """
    model = fit(materialize(statistics_table(docs), "quality-stats"), known_labels(labels, label))

    @tb.released
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.buffers(batch.column("text"))
            for lo, hi in tb.slices(offsets):
                part = offsets[lo : hi + 1]
                x = statistics(data[part[0] : part[-1]], part - part[0]).astype(np.float32).astype(float)
                yield batch.slice(lo, hi - lo).filter(pa.array(model.score(x) >= THRESHOLD))

    return small_batches(docs).mapInArrow(keep, docs.schema)


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs; learns from rows not held out.

    Null texts count as empty and get the score of an empty text.  Repeated rows are scored each;
    a doc_id labelled several times is learnt from each time.  Null doc_ids are scored, not learnt
    from.  Only doc_id and text of docs are read.
    """
    stats = materialize(statistics_table(docs), "quality-stats")
    model = fit(stats, known_labels(labels, label))

    @tb.released
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(matrix(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return stats.mapInArrow(apply, "doc_id long, score double, predicted int").select(
        "doc_id", F.coalesce(remainder() == HELD_OUT_REMAINDER, F.lit(False)).alias("held_out"), "score", "predicted"
    )
