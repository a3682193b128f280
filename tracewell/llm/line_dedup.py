"""Line dedup: lines that many documents share lose all their occurrences, by levelled sorted runs of line hashes.

Documents come in batches.  A batch's lines become (hash, number of documents), added up before and
after a shuffle on the hash.  Hashes that the runs already know to be frequent are taken out of it by a merge
anti-join, and the rest is written as a new run of level 0.  Two runs of a level are compacted into one run of the
next level, so N batches cost each hash about log N rewrites.  A run is a table bucketed by hash and sorted within buckets:
anti-joins and compactions are merge joins which shuffle none of the runs.

A last pass drops lines whose hash is frequent.  Frequent hashes are broadcast as one sorted array
if their counted number allows it; beyond that, (row, line, hash) is semi-joined with the runs, and texts meet
only the numbers of their own lines.  Hashes have 128 bits (MD5 of the key), and are not compared byte by byte.

A line's key is the line without white space (space, U+0009 to U+000D) at its ends, A-Z lower-cased; an empty key
is never dropped.  Each row is a document, also where doc_ids repeat or are null, and a document counts once for a key.
A null text has one empty line and stays null.  Other columns pass unchanged.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import fresh, materialize, scratch_dir, small_batches, with_row_key

#: A key in at least so many documents is frequent.
LEAST_DOCUMENTS = 10
#: Shortest key, in code points.
LEAST_POINTS = 1
#: Batches that a table's files are dealt to.
BATCHES = 8
SPACE = b" \t\n\v\f\r"
#: Hashes that a task counts before it hands them on.
HELD = 200_000


def line_hashes(text: bytes) -> list[bytes]:
    """For each line of a text the hash of its key; b"" for a key shorter than LEAST_POINTS."""
    found = []
    for line in text.split(b"\n"):
        key = line.strip(SPACE).lower()  # of bytes: A-Z only
        found.append(hashlib.md5(key, usedforsecurity=False).digest() if len(key) >= 4 * LEAST_POINTS or len(key.decode(errors="replace")) >= LEAST_POINTS else b"")
    return found


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def line_counts(docs: DataFrame) -> DataFrame:
    """(hash, n): in how many rows of docs each line key stands."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["hash", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts_of(batch, "text"):
                keys = set(line_hashes(text))
                keys.discard(b"")
                seen.update(keys)
                if len(seen) >= HELD:
                    yield flush()
        if seen:
            yield flush()

    found = small_batches(docs.select("text")).mapInArrow(count, "hash binary, n long")
    return found.groupBy("hash").agg(F.sum("n").alias("n"))


class Runs:
    """Levelled sorted runs of (hash, n) in the shared scratch folder.

    add() takes any batch's line_counts(); frequent() gives the hashes that reach `least` documents so far.
    An append costs its own batch; what is written again is at most one compaction a level.
    """

    def __init__(self, spark, least: int = LEAST_DOCUMENTS, buckets: int | None = None):
        self.spark, self.least = spark, least
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[str | None] = []

    def _write(self, counts: DataFrame) -> str:
        name = f"tracewell_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{scratch_dir(self.spark)}/tracewell/{name}").format("parquet").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(self.spark)}/tracewell/{name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # leaves the files of a table with a path
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one, by a merge join of their common buckets."""
        more = self.spark.table(other).select("hash", F.col("n").alias("more"))
        return self.spark.table(one).join(more.hint("merge"), "hash", "full_outer").select("hash", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    def _compacted(self, one: str, other: str) -> str:
        name = self._write(self._merged(one, other))
        self._drop(one)
        self._drop(other)
        return name

    def add(self, counts: DataFrame) -> None:
        """Add a batch: what is frequent already is known, the rest becomes a run of level 0."""
        for name in filter(None, self.levels):
            known = self.spark.table(name).where(F.col("n") >= self.least).select("hash")
            counts = counts.join(known.hint("merge"), "hash", "left_anti")
        name, level = self._write(counts), 0
        while level < len(self.levels) and self.levels[level]:
            name = self._compacted(name, self.levels[level])
            self.levels[level] = None
            level += 1
        self.levels[level:level + 1] = [name]

    def frequent(self) -> DataFrame:
        """(hash) of the keys found in at least `least` documents; all runs become one."""
        last = None
        for k, name in enumerate(self.levels):
            if name:
                last, self.levels[k] = self._compacted(last, name) if last else name, None
        if last is None:
            return self.spark.createDataFrame([], "hash binary")
        self.levels[-1] = last
        return self.spark.table(last).where(F.col("n") >= self.least).select("hash")

    def close(self) -> None:
        """Drop all runs."""
        for name in filter(None, self.levels):
            self._drop(name)
        self.levels = []


def batches_of(docs: DataFrame) -> list[DataFrame]:
    """docs in up to BATCHES batches of whole files, each of which reads its own files; one batch if docs isn't a scan of files."""
    try:
        path = docs.select(F.col("_metadata.file_path")).columns and F.col("_metadata.file_path")
    except AnalysisException:
        return [docs]
    files = len(docs.inputFiles())
    n = min(BATCHES, max(files, 1))
    return [docs.where(F.pmod(F.xxhash64(path), F.lit(n)) == k) for k in range(n)] if n > 1 else [docs]


def frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(hash) of the line keys found in at least `least` rows of docs, written to the scratch folder."""
    runs = Runs(docs.sparkSession, least)
    for batch in batches_of(docs):
        runs.add(line_counts(batch))
    found = materialize(runs.frequent(), "frequent-lines")
    runs.close()
    return found


def _pairs(hashes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 2).astype(np.uint64)


def without(rows: DataFrame, frequent: DataFrame, schema: str, n_lines: str, n_dropped: str) -> DataFrame:
    """The last pass with the frequent hashes broadcast: two sorted columns of 64 bits."""
    known = frequent.select("hash").toArrow().column(0).combine_chunks()
    held = _pairs(known.to_pylist())
    order = np.lexsort((held[:, 1], held[:, 0]))
    table = rows.sparkSession.sparkContext.broadcast((held[order, 0].copy(), held[order, 1].copy()))

    def hit(pairs: np.ndarray) -> np.ndarray:
        high, low = table.value
        at = np.searchsorted(high, pairs[:, 0])
        found, open_ = np.zeros(len(pairs), bool), np.ones(len(pairs), bool)
        while open_.any():  # more than once only where hashes agree in their upper half
            open_ &= at < len(high)
            open_[open_] = high[at[open_]] == pairs[open_, 0]
            found[open_] |= low[at[open_]] == pairs[open_, 1]
            at += 1
        return found

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            kept, lines, gone = [], [], []
            for x in batch.column(at).cast(pa.large_binary()).to_pylist():
                hashes = line_hashes(x or b"")
                named = [k for k, h in enumerate(hashes) if h]
                bad = {named[k] for k in np.flatnonzero(hit(_pairs([hashes[k] for k in named])))} if named else set()
                kept.append(b"\n".join(line for k, line in enumerate(x.split(b"\n")) if k not in bad) if bad else x)
                lines.append(len(hashes))
                gone.append(len(bad))
            columns = list(batch.columns)
            columns[at] = pa.array(kept, pa.large_binary()).view(pa.large_string()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names, n_lines, n_dropped])

    return small_batches(rows).mapInArrow(drop, schema)


def without_joined(docs: DataFrame, frequent: DataFrame, n_lines: str, n_dropped: str) -> DataFrame:
    """The last pass where the frequent hashes are too many to broadcast: lines are semi-joined as (row, line, hash)."""
    rows, key = with_row_key(docs)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                hashes = line_hashes(text)
                for lo in range(0, len(hashes), HELD):
                    some = [(lo + k, h) for k, h in enumerate(hashes[lo : lo + HELD]) if h]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([k for k, _ in some], pa.int32()), pa.array([h for _, h in some], pa.binary())], ["of", "line", "hash"])

    lines = small_batches(rows.select(F.col(key).cast("long").alias("of"), "text")).mapInArrow(numbered, "of long, line int, hash binary")
    bad = lines.join(frequent, "hash", "left_semi").groupBy("of").agg(F.collect_list("line").alias("lines"))
    met = rows.join(bad.withColumnsRenamed({"of": fresh(rows, "of"), "lines": fresh(rows, "lines")}), F.col(key) == F.col(fresh(rows, "of")), "left")
    gone, split = F.coalesce(F.col(fresh(rows, "lines")), F.array().cast("array<int>")), F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text = F.array_join(F.filter(split, lambda _, k: ~F.array_contains(gone, k)), "\n")
    out = {c: F.col(c) for c in docs.columns} | {"text": F.when(F.size(gone) > 0, text).otherwise(F.col("text"))}
    return met.select(*(v.alias(c) for c, v in out.items()), F.size(split).cast("long").alias(n_lines), F.size(gone).cast("long").alias(n_dropped))


def without_frequent_lines(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """docs with frequent lines cut out of text, and n_lines (before) and n_dropped.

    Where docs has columns of these names, the new ones are n_lines_1 and so on.
    """
    frequent = frequent_lines(docs, least)
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    if frequent.count() * 16 > shared.BROADCAST_LIMIT_BYTES:
        return without_joined(docs, frequent, n_lines, n_dropped)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{n_lines}` long, `{n_dropped}` long"
    return without(docs, frequent, schema, n_lines, n_dropped)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of without_frequent_lines(); the hash of a null text is that of an empty one."""
    kept = without_frequent_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
