"""Vector code compression: product codes of integer vectors, exact, by Walsh-Hadamard transforms.

A component x is the integer floor(256 * x).  A vector is cut into PARTS equal consecutive parts, and
each part is named by the nearest entry of its position's codebook.  Parts and entries are padded with
zeros to a power of two M and transformed by the integer Walsh-Hadamard transform in order of sequency.
The squared distance of two transforms is M times that of the parts, so adding up squared differences
one sequency band after another gives growing lower bounds: an entry goes as soon as its bound
exceeds the whole distance of the entry that looked best after the first coefficient.  All is done in 64-bit integers.

Each round is one pass over the vectors: tasks assign parts against the broadcast codebooks (512 bytes a
component) and add up the parts of each entry, so a task sends at most 64 sums for each part, whatever it read.

Rows whose vector is null or holds null, NaN or infinite components are dropped.  Vectors of another
length have codebooks of their own; a length that 16 doesn't divide is padded with zeros at the end.
Components are held within +-2**30 / M (2**28 where parts have 3 or 4 components), so that sums of squares fit in 64 bits.  Rows of one vec_id are
coded one by one; among them the smaller vector comes first as a first entry, and null vec_ids come last.
With fewer than 64 vectors there are fewer entries.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import sized

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a part's transform: with components of at most 2**BITS / M, scaled squared distances stay below 2**63.
BITS = 30
#: Vectors that a task holds at a time.
CHUNK = 2_048

_HEX = np.frombuffer("".join(f"{k:02x}" for k in range(256)).encode(), np.uint8).reshape(256, 2)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the integer components of the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    width = F.greatest(F.ceil(F.size(x) / PARTS), F.lit(1))
    bound = F.pow(F.lit(2.0), F.lit(BITS) - F.ceil(F.log2(width)))
    kept = vectors.where(good).select("vec_id", "label", x.alias("x"), bound.alias("bound"))  # worked out once a vector
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.col("bound")), -F.col("bound"))).cast("long")).alias("x"))


def parts_of(rows: np.ndarray) -> np.ndarray:
    """Vectors of one length as (vector, part, component), padded with zeros."""
    n, size = rows.shape
    width = -(-size // PARTS)
    if size < PARTS * width:
        rows = np.concatenate([rows, np.zeros((n, PARTS * width - size), np.int64)], axis=1)
    return rows.reshape(n, PARTS, width)


def walsh(x: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform over the last axis, padded to a power of two, in order of sequency."""
    width = x.shape[-1]
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((*x.shape[:-1], size), np.int64)
    out[..., :width] = x
    step = 1
    while step < size:
        halves = out.reshape(*x.shape[:-1], size // (2 * step), 2, step)
        out = np.stack([halves[..., 0, :] + halves[..., 1, :], halves[..., 0, :] - halves[..., 1, :]], axis=-2).reshape(out.shape)
        step *= 2
    # Row i of the transform changes sign gray^-1(reversed bits of i) times.
    k = np.arange(size)
    gray = k ^ (k >> 1)
    natural = np.zeros(size, np.int64)
    for b in range(size.bit_length() - 1):
        natural = natural << 1 | (gray >> b & 1)
    return out[..., natural]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, scaled distance) of the nearest transformed entry of each transformed part; ties go to the lower index."""
    size = parts.shape[1]
    bound = (parts[:, :1] - entries[None, :, 0]) ** 2
    guess = bound.argmin(axis=1)
    most = ((parts - entries[guess]) ** 2).sum(axis=1)
    row, entry = np.nonzero(bound <= most[:, None])
    bound = bound[row, entry]
    lo = 1
    while lo < size:
        hi = 2 * lo
        bound = bound + ((parts[row, lo:hi] - entries[entry, lo:hi]) ** 2).sum(axis=1)
        left = bound <= most[row]
        row, entry, bound = row[left], entry[left], bound[left]
        lo = hi
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(bound, first)
    best = np.flatnonzero(bound == least[row])
    _, at = np.unique(row[best], return_index=True)
    return entry[best[at]], least


def assigned(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, index of each part's entry, squared distance summed over parts) of vectors of one length."""
    parts = parts_of(rows)
    index = np.zeros(parts.shape[:2], np.int64)
    error = np.zeros(len(rows), np.int64)
    if parts.shape[2]:
        scale = 1 << (parts.shape[2] - 1).bit_length()
        for p in range(PARTS):
            index[:, p], far = nearest(walsh(parts[:, p]), walsh(book[p]))
            error += far // scale
    return parts, index, error


def by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, vectors) of a batch, CHUNK vectors at a time."""
    x = batch.column(column)
    ends = x.offsets.to_numpy().astype(np.int64)
    values = x.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for size in np.unique(sizes):
        same = np.flatnonzero(sizes == size)
        for lo in range(0, len(same), CHUNK):
            rows = same[lo : lo + CHUNK]
            yield int(size), rows, values[ends[rows][:, None] + np.arange(size)].astype(np.int64).reshape(len(rows), size)


def first_books(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length (part, entry, component) of its ENTRIES smallest vec_ids."""
    order = Window.partitionBy(F.size("x")).orderBy(F.col("vec_id").asc_nulls_last(), "x")
    firsts = vectors.select("vec_id", "x", F.row_number().over(order).alias("k")).where(F.col("k") <= ENTRIES)
    found: dict[int, list] = {}
    for row in firsts.select("x", "k").collect():  # 64 a length
        found.setdefault(len(row["x"]), []).append((row["k"], row["x"]))
    return {n: parts_of(np.array([x for _, x in sorted(rows, key=lambda r: r[0])], np.int64).reshape(len(rows), n)).transpose(1, 0, 2).copy() for n, rows in found.items()}


def better_books(vectors: DataFrame, books: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Books with each entry replaced by the floor of the mean of the parts that are nearest to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(b.shape, np.int64) for n, b in shared.value.items()}
        counts = {n: np.zeros(b.shape[:2], np.int64) for n, b in shared.value.items()}
        for batch in batches:
            for n, _, rows in by_length(batch, 0):
                parts, index, _ = assigned(rows, shared.value[n])
                for p in range(PARTS):
                    np.add.at(sums[n][p], index[:, p], parts[:, p])
                    counts[n][p] += np.bincount(index[:, p], minlength=counts[n].shape[1])
        for n, times in counts.items():
            part, entry = np.nonzero(times)
            if len(part):
                total = sums[n][part, entry]
                ends = np.arange(len(part) + 1, dtype=np.int32) * total.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), n, np.int32)), pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(times[part, entry]), pa.ListArray.from_arrays(pa.array(ends), pa.array(total.ravel()))],
                    ["length", "part", "entry", "n", "total"],
                )

    sums = vectors.select("x").mapInArrow(add_up, "length int, part int, entry int, n long, total array<long>")
    each = sums.select("length", "part", "entry", "n", F.posexplode_outer("total").alias("at", "value"))
    books = {n: b.copy() for n, b in books.items()}
    for row in each.groupBy("length", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toLocalIterator():  # as many as the books have components
        if row["at"] is not None:
            books[row["length"]][row["part"], row["entry"], row["at"]] = row["value"] // row["n"]
    return books


def book_hash(book: np.ndarray) -> str:
    """The hash of a length's entries: decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of integer_vectors() by fitted books."""
    shared = vectors.sparkSession.sparkContext.broadcast({n: (b, book_hash(b)) for n, b in books.items()})

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, at, rows in by_length(batch, 2):
                book, name = shared.value[n]
                _, index, error = assigned(rows, book)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * 2 * PARTS
                text = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(_HEX[index]).tobytes()))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), text, pa.array(error), pa.array([name] * len(rows), pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")


def fitted_books(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Codebooks of integer_vectors() by length after ROUNDS rounds over all of them."""
    books = first_books(vectors)
    for _ in range(ROUNDS if books else 0):
        books = better_books(vectors, books)
    return books


def compressed(table: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of a table (vec_id, embedding, label).

    label_error sums the errors of equal labels, nulls together; it is null where it exceeds 64 bits.
    """
    vectors = integer_vectors(table)
    coded = encode(vectors, fitted_books(vectors))
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(sized(totals, 64), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
