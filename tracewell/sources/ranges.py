"""Line files by byte ranges: what lies before a cursor is never read, and no more than one line is held.

A range [begin, end) of a file owns the lines whose line end lies in it, so files may be cut anywhere, and a
line that is still being written belongs to a range to come.  Files are listed by Spark, and ranges are rows: cursors
and wanted paths are joined to them before any file is opened.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the longest line that is read, with its line end.
MOST_LINE_BYTES = 16 << 20
#: Bytes of a range; a file that is no longer is one range.
RANGE_BYTES = 64 << 20
#: What begins a line of a bundle that names the file whose lines follow; no JSON text holds it unescaped.
HEAD = "\x1e"
#: Bytes read at a time, and bytes and rows of a batch that a worker hands on.
STEP, BATCH_BYTES, BATCH_ROWS = 64 << 10, 2 << 20, 2_000
#: White space of a blank line, as Unicode has it.
BLANK = " \t\n\x0b\x0c\r\x85\xa0                　"


def opened(path: str) -> io.BufferedReader:
    """A file of any store that Arrow knows, or a local one, for reading at any place."""
    if "://" not in path or path.startswith("file:"):
        local = path.removeprefix("file:")
        return open("/" + local.lstrip("/") if path.startswith("file:") else local, "rb", buffering=STEP)
    store, name = pyarrow.fs.FileSystem.from_uri(path)
    return io.BufferedReader(store.open_input_file(name), STEP)


def line_start(f: io.BufferedReader, at: int) -> int:
    """Where the line begins that byte `at` belongs to; reads backwards in steps."""
    while at > 0:
        low = max(0, at - STEP)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def line_end(f: io.BufferedReader, at: int, most: int) -> int:
    """The place after the first line end in [at, most), or -1; reads on in steps."""
    f.seek(at)
    while at < most:
        step = f.read(min(STEP, most - at))
        if not step:
            return -1
        found = step.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(step)
    return -1


def lines_in(f: io.BufferedReader, begin: int, end: int, most: int = MOST_LINE_BYTES) -> Iterator[tuple[int, int, str, bytes | None]]:
    """(offset, bytes without line end, kind, line) of the lines of f that end in [begin, end).

    kind is 'line', 'blank' or 'oversized'; an oversized line is passed over in steps and is None.
    """
    after = line_end(f, begin, end)
    if after < 0:
        return
    at = line_start(f, begin)
    f.seek(at)
    while True:
        line = f.readline(most)
        if line.endswith(b"\n"):
            after = at + len(line)
            if after > end:
                return
            kind = "blank" if not line.decode("utf-8", "replace").strip(BLANK) else "line"
            yield at, len(line) - 1, kind, line[:-1]
        else:
            if len(line) < most:  # still being written
                return
            after = line_end(f, at + most, end)
            if after < 0:
                return
            yield at, after - at - 1, "oversized", None
            f.seek(after)
        at = after
        if at >= end:
            return


def files_below(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, size) of the files below root, at any depth, whose names fit; nothing is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("size"))


def ranges_of(files: DataFrame, cursors: DataFrame | None = None, wanted: DataFrame | None = None, size: int = RANGE_BYTES) -> DataFrame:
    """(path, begin, end, first) of files (path, size) that have bytes after their cursors (path, cursor) and are wanted (path), if given.

    first is the file's cursor.  A file shorter than its cursor was written anew and is read from its beginning.
    """
    if wanted is not None:
        files = files.join(wanted.select("path").distinct(), "path", "left_semi")
    files = files.join(cursors.select("path", "cursor"), "path", "left") if cursors is not None else files.withColumn("cursor", F.lit(0))
    first = F.when(F.coalesce("cursor", F.lit(0)) > F.col("size"), 0).otherwise(F.coalesce("cursor", F.lit(0))).cast("long")
    files = files.select("path", "size", first.alias("first")).where("first < size")
    return files.select("path", "first", "size", F.explode(F.expr(f"sequence(first, size - 1, {size}L)")).alias("begin")).select("path", "begin", F.least(F.col("begin") + size, F.col("size")).alias("end"), "first")


LINE = "path string, begin long, offset long, number long, line string, kind string, n_bytes long"


def dealt(ranges: DataFrame) -> DataFrame:
    """ranges dealt to a fixed number of tasks: rows this small would else be coalesced into one, which then reads every file."""
    return ranges.repartition(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("path"), F.col("begin"))


def read_ranges(ranges: DataFrame, most: int = MOST_LINE_BYTES, bundled: bool = False) -> DataFrame:
    """The lines of ranges (path, begin, end), of LINE's columns; number counts a range's lines of kind 'line' from 0.

    Bundles hold several files, each after a line of HEAD and its name, and are read as one range each: path is then that name,
    and offsets and numbers count from the file's own beginning.
    """
    head = HEAD.encode()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows, held, number, name, start = [], 0, 0, path, 0
                with opened(path) as f:
                    for offset, n_bytes, kind, line in lines_in(f, begin, end, most):
                        if bundled and line is not None and line.startswith(head):
                            name, start, number = line[len(head) :].decode(), offset + n_bytes + 1, 0
                            continue
                        if rows and (held + n_bytes > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                            yield packed(begin, rows)
                            rows, held = [], 0
                        rows.append((name, offset - start, number, None if line is None else line.decode("utf-8", "replace"), kind, n_bytes))
                        held += n_bytes if line is not None else 0
                        number += kind == "line"
                if rows:
                    yield packed(begin, rows)

    def packed(begin: int, rows: list) -> pa.RecordBatch:
        path, offset, number, line, kind, n_bytes = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(path), pa.array([begin] * len(rows), pa.int64()), pa.array(offset, pa.int64()), pa.array(number, pa.int64()), pa.array(line, pa.string()), pa.array(kind), pa.array(n_bytes, pa.int64())],
            ["path", "begin", "offset", "number", "line", "kind", "n_bytes"],
        )

    return ranges.select("path", "begin", "end").mapInArrow(read, LINE)


def count_ranges(ranges: DataFrame, most: int = MOST_LINE_BYTES) -> DataFrame:
    """(path, begin, n): how many lines of kind 'line' each range has; texts stay in the workers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for path, begin, end in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                with opened(path) as f:
                    n.append(sum(kind == "line" for _, _, kind, _ in lines_in(f, begin, end, most)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["path", "begin", "n"])

    return ranges.select("path", "begin", "end").mapInArrow(count, "path string, begin long, n long")
