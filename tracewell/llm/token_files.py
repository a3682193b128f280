"""Token-id files compressed by an adaptive context-mixing range coder.

A block holds the ids of whole documents.  It is coded from a reset model, so blocks are read
independently, and carries a CRC-32 of its ids.  Three predictors are mixed: the id that last held
in the order-2 context, the two that lead the order-1 context, and adaptive order-0 frequencies of
all ids.  Their weights are learnt for each joint state of the contexts' confidences, and one
arithmetic-coding step takes an id out of the mixture.  A block is split into lanes that are coded
side by side in numpy with one model: at every step each lane codes an id, then the model learns all
of them.  All arithmetic is in integers, so a file reads the same anywhere.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch_dir, sized, small_batches
from .textbytes import buffers, slices
from .word_bpe import text_encoder

#: Ids of a block, on average, its lanes, and the least ids of a lane.
BLOCK_IDS = 1 << 21
LANES = 4_096
LANE_IDS = 256
END_ID = 1
#: Ids have to be below this.
MOST_IDS = (1 << 20) - 1
#: Bytes of text that are encoded together; a longer text is encoded alone.
SLICE_BYTES = 1 << 20
#: Bytes of text of a file, on average.
FILE_TEXT_BYTES = 16 << 20

U64 = np.uint64
#: Bits of the mixture's weights, of the order-0 frequencies, and of a step of the decoder's table of them.
WEIGHT_BITS, COUNT_BITS, STEP_BITS = 12, 22, 5
_SHIFT, _WORD, _TOP, _BOTTOM = U64(WEIGHT_BITS + COUNT_BITS), U64(16), U64(1 << 48), U64(1 << 42)
_SLOT_BITS = 18
_SLOTS = 1 << _SLOT_BITS
_NONE = (1 << 20) - 1
_TRUST = 15
#: A trust after a miss and after a hit; a guess that misses without trust is replaced.
_TRUST_AFTER = np.stack([np.arange(_TRUST + 1) >> 1, np.minimum(np.arange(_TRUST + 1) + 1, _TRUST)], axis=1).reshape(-1)
_TRUST_ONE, _TRUST_TWO = _TRUST_AFTER << 40, _TRUST_AFTER << 20
_RATE = 16
#: Steps after which weights and frequencies are computed anew; the first so many are after every step, late ones after twice as many.
_REFRESH = 16


class Lanes:
    """Lower ends and widths of the lanes' intervals, and how they are narrowed and shifted."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, U64), np.full(lanes, ~U64(0), U64)

    def narrow(self, m: int, start: np.ndarray, size: np.ndarray) -> None:
        """Take the parts [start, start + size) of the first m lanes' intervals, and shift out settled words."""
        low, rng = self.low[:m], self.range[:m]
        step = rng >> _SHIFT
        low += start * step
        np.multiply(step, size, out=rng)
        active = np.flatnonzero(((low ^ (low + rng)) < _TOP) | (rng < _BOTTOM))
        while len(active):
            a, b = low[active], rng[active]
            same = (a ^ (a + b)) < _TOP
            b = np.where(same, b, (~a + U64(1)) & (_BOTTOM - U64(1)))
            self.shift(active, a)
            a <<= _WORD
            b <<= _WORD
            low[active], rng[active] = a, b
            active = active[((a ^ (a + b)) < _TOP) | (b < _BOTTOM)]

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        raise NotImplementedError


class Encoder(Lanes):
    """A range coder for each lane, writing 16-bit words."""

    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.words, self.owners = [], []

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.words.append((low >> U64(48)).astype("<u2"))
        self.owners.append(lanes.astype(np.int32))

    def finish(self) -> bytes:
        """The lanes' numbers of words and their words; two last words point into each interval."""
        point = ((self.low + (_BOTTOM - U64(1))) >> U64(42)) << U64(42)
        every = np.arange(len(point), dtype=np.int32)
        for k in (48, 32):
            self.words.append((point >> U64(k) & U64(0xFFFF)).astype("<u2"))
            self.owners.append(every)
        owner = np.concatenate(self.owners)
        sizes = np.bincount(owner, minlength=len(point))
        wide = int(sizes.max()) > 0xFFFF
        return bytes([wide]) + sizes.astype("<u4" if wide else "<u2").tobytes() + np.concatenate(self.words)[np.argsort(owner, kind="stable")].tobytes()


class Decoder(Lanes):
    """The reading side of Encoder; a lane reads zeros beyond its end."""

    def __init__(self, data: bytes, lanes: int):
        super().__init__(lanes)
        kind, width = ("<u4", 4) if data[0] else ("<u2", 2)
        sizes = np.frombuffer(data, kind, lanes, 1).astype(np.int64)
        words = np.frombuffer(data, "<u2", offset=1 + width * lanes)
        self.words = np.zeros(len(words) + lanes, U64)
        self.words[np.arange(len(words)) + np.repeat(np.arange(lanes), sizes)] = words
        self.end = np.cumsum(sizes + 1) - 1
        self.at = self.end - sizes
        self.code = np.zeros(lanes, U64)
        every = np.arange(lanes)
        for _ in range(4):
            self.shift(every, self.low)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lanes]
        self.code[lanes] = (self.code[lanes] << _WORD) | self.words[at]
        self.at[lanes] = np.minimum(at + 1, self.end[lanes])

    def point(self, m: int) -> np.ndarray:
        """Where in the first m lanes' intervals their codes lie."""
        return np.minimum((self.code[:m] - self.low[:m]) // (self.range[:m] >> _SHIFT), (U64(1) << _SHIFT) - U64(1)).astype(np.int64)


class Model:
    """The mixed predictions of a block; both sides step it through the same ids.

    Parts of the mixture: 0 is the order-2 guess, 1 and 2 the order-1 guesses, 3 all ids by frequency.
    An order-1 entry packs its leading guess, the other one and a trust; an order-2 entry a guess and
    a trust.  A guess of NONE is never right.
    """

    def __init__(self, ids: int):
        self.ids, self.steps = ids, 0
        self.one, self.two = np.full(ids, _NONE << 20 | _NONE, np.int64), np.full(_SLOTS, _NONE, np.int32)
        self.parts = np.ones((2 * (_TRUST + 1) ** 2, 4), np.int64)
        self.parts[:, 3] = 4
        self.edges = np.zeros((len(self.parts), 5), np.int64)
        self.count, self.missed = np.ones(ids, np.int64), []
        self.refresh()

    def refresh(self) -> None:
        """The mixture's weights and order-0 frequencies out of the counts."""
        if self.missed:
            self.count += _RATE * np.bincount(np.concatenate(self.missed), minlength=self.ids)
            self.missed = []
        whole = 1 << COUNT_BITS
        self.frequency = 1 + self.count * (whole - self.ids) // int(self.count.sum())
        self.frequency[-1] += whole - int(self.frequency.sum())
        self.before = np.zeros(self.ids + 1, np.int32)
        np.cumsum(self.frequency, out=self.before[1:])
        self.frequency = self.frequency.astype(np.int32)
        shares = 1 + self.parts[:, :3] * ((1 << WEIGHT_BITS) - 4) // self.parts.sum(axis=1)[:, None]
        np.cumsum(shares, axis=1, out=self.edges[:, 1:4])
        self.edges[:, 4] = 1 << WEIGHT_BITS
        self.table = None

    def predict(self, last: np.ndarray, earlier: np.ndarray) -> None:
        """Guesses of the contexts, and their joint state, for lanes by their last two ids."""
        self.last = last
        self.slot = (((last << 20) ^ earlier).astype(U64) * U64(0x9E3779B97F4A7C15) >> U64(64 - _SLOT_BITS)).astype(np.int64)
        one, two = self.one.take(last), self.two.take(self.slot)
        self.g1, self.h1, self.u1 = one & _NONE, one >> 20 & _NONE, one >> 40
        self.g2, self.u2 = two & _NONE, two >> 20
        self.state = (self.u2 << 5 | self.u1 << 1) | (self.g1 == self.g2)

    def parts_of(self, x: np.ndarray) -> np.ndarray:
        """The part of the mixture by which each id is coded: the first that can tell it."""
        return np.where(x == self.g2, 0, np.where(x == self.g1, 1, 3 - (x == self.h1)))

    def interval(self, x: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of ids in the mixture."""
        edge = self.state * 5 + part
        start = self.edges.take(edge)
        weight = self.edges.take(edge + 1) - start
        by_count = part == 3
        start <<= COUNT_BITS
        start += weight * np.where(by_count, self.before.take(x), 0)
        weight *= np.where(by_count, self.frequency.take(x), 1 << COUNT_BITS)
        return start.view(U64), weight.view(U64)

    def find(self, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, parts) whose intervals hold the points."""
        if self.table is None:
            # The id at the start of each step is the number of ids that end at or before it.
            steps = 1 << (COUNT_BITS - STEP_BITS)
            self.table = np.cumsum(np.bincount((self.before[1:-1] + (1 << STEP_BITS) - 1) >> STEP_BITS, minlength=steps)[:steps], dtype=np.int32)
        head, row = point >> COUNT_BITS, self.state * 5
        last = self.edges.take(row + 3)
        second, third, by_count = head >= self.edges.take(row + 1), head >= self.edges.take(row + 2), head >= last
        # Exact: the quotients are whole or at least 1 / 4096 from the next whole number.
        inner = (np.maximum(point - (last << COUNT_BITS), 0) / ((1 << WEIGHT_BITS) - last)).astype(np.int64)
        y = self.table.take(inner >> STEP_BITS)
        active = np.flatnonzero(self.before.take(y + 1) <= inner)
        while len(active):
            y[active] += 1
            active = active[self.before.take(y[active] + 1) <= inner[active]]
        x = np.where(by_count, y, np.where(third, self.h1, np.where(second, self.g1, self.g2)))
        part = second.astype(np.int64)
        part += third
        part += by_count
        return x, part

    def learn(self, x: np.ndarray, part: np.ndarray) -> None:
        """Take in the ids that the last intervals were of; of late steps every fourth counts for weights and frequencies."""
        if self.steps < 4 * _REFRESH or self.steps % 4 == 0:
            self.parts += np.bincount(self.state * 4 + part, minlength=self.parts.size).reshape(self.parts.shape)
            # Frequencies learn the ids that the contexts didn't foretell.
            self.missed.append(x[part == 3])
        self.steps += 1
        if self.steps <= _REFRESH or self.steps % (_REFRESH if self.steps < 128 else 2 * _REFRESH) == 0:
            self.refresh()
        hit = x == self.g1
        event = self.u1 << 1 | hit
        gone = event == 0
        other = np.where(gone, self.g1, np.where(hit, self.h1, x))
        other <<= 20
        other |= np.where(gone, x, self.g1)
        other |= _TRUST_ONE.take(event)
        self.one[self.last] = other
        event = self.u2 << 1 | (part == 0)
        self.two[self.slot] = np.where(event == 0, x, self.g2) | _TRUST_TWO.take(event)


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, -(-n // lanes)


def compress(ids: np.ndarray) -> bytes:
    """A block's ids as bytes; ids are from 0 to MOST_IDS - 1."""
    n = len(ids)
    if not n:
        return b""
    if int(ids.min()) < 0 or int(ids.max()) >= MOST_IDS:
        raise ValueError(f"ids have to be from 0 to {MOST_IDS - 1}")
    size = int(ids.max()) + 1
    lanes, steps = _shape(n)
    padded = np.zeros(lanes * steps, np.int64)
    padded[:n] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    coder, model = Encoder(lanes), Model(size)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        m = -(-(n - t) // steps)
        x = table[t, :m]
        model.predict(last[:m], before[:m])
        part = model.parts_of(x)
        coder.narrow(m, *model.interval(x, part))
        model.learn(x, part)
        before[:m], last[:m] = last[:m], x
    return size.to_bytes(4, "little") + coder.finish()


def decompress(data: bytes, n: int) -> np.ndarray:
    """The n ids of a block's bytes."""
    if not n:
        return np.zeros(0, np.int64)
    lanes, steps = _shape(n)
    coder, model = Decoder(data[4:], lanes), Model(int.from_bytes(data[:4], "little"))
    table = np.zeros((steps, lanes), np.int64)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        m = -(-(n - t) // steps)
        model.predict(last[:m], before[:m])
        x, part = model.find(coder.point(m))
        coder.narrow(m, *model.interval(x, part))
        table[t, :m] = x
        model.learn(x, part)
        before[:m], last[:m] = last[:m], x
    return table.T.reshape(-1)[:n]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Write the ids of docs (doc_id, text), in ascending doc_id order, as block files at path.

    A row of a file is a block: its file's part number, its number in the file, the documents with
    their numbers of ids, a CRC-32 and the coded ids.  Each document ends with END_ID.  Null texts
    are empty; a null doc_id comes first; rows that repeat a doc_id are documents of their own.
    A document is never split, so a block is longer than BLOCK_IDS by one document at most.
    """
    spark = docs.sparkSession
    text_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism * 2, -(-text_bytes // FILE_TEXT_BYTES))
    ordered = small_batches(docs).select(F.col("doc_id").cast("long"), "text").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, docs_, sizes, held, total = 0, 0, [], [], [], 0
        encoder = text_encoder(tokenizer_path)

        def close() -> pa.RecordBatch:
            data = b"".join(held)
            ids = np.frombuffer(data, "<u4").astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([zlib.crc32(data)], pa.int64()),
                    pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([compress(ids)], pa.binary()),
                ],
                ["part", "block", "n_ids", "crc32", "doc_ids", "doc_sizes", "payload"],
            )

        for batch in batches:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            data, offsets = buffers(batch.column(1))
            ids_of = batch.column(0).to_pylist()
            for lo, hi in slices(offsets, SLICE_BYTES):
                begin = int(offsets[lo])
                ids, ends = encoder.encode(data[begin : int(offsets[hi])], offsets[lo : hi + 1] - begin)
                packed, at = ids.astype("<u4").tobytes(), 0
                for doc_id, stop in zip(ids_of[lo:hi], ends.tolist(), strict=True):
                    docs_.append(doc_id), sizes.append(stop - at + 1), held.extend((packed[4 * at : 4 * stop], end))
                    total += stop - at + 1
                    at = stop
                    if total >= BLOCK_IDS:
                        yield close()
                        block, docs_, sizes, held, total = block + 1, [], [], [], 0
        if docs_:
            yield close()

    schema = "part int, block int, n_ids long, crc32 long, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in files; ids are packed 32-bit integers.

    Fails on a block whose ids don't match its checksum.
    """
    blocks = files.select("part", "block", "n_ids")
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    starts = blocks.withColumn("inner", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).join(parts, "part")
    starts = starts.select("part", "block", (F.col("inner") + F.col("part_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n, crc, docs, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = decompress(payload, n).astype("<u4").tobytes()
                if zlib.crc32(data) != crc:
                    raise ValueError("a block's ids don't match its checksum")
                ends = np.cumsum(sizes)
                cut = [data[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(cut, pa.binary())], ["doc_id", "start", "n_tokens", "ids"]
                )

    coded = files.join(sized(starts, 24), ["part", "block"]).select("start", "n_ids", "crc32", "doc_ids", "doc_sizes", "payload")
    return coded.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written below the scratch folder."""
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tracewell/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path)
    schema = "part int, block int, n_ids long, crc32 long, doc_ids array<bigint>, doc_sizes array<bigint>, payload binary"
    return read_token_files(spark.read.schema(schema).parquet(path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
