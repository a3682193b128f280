"""A streaming source that follows growing session files from each file's own byte place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tracewell.sources.ranges import RANGE_BYTES, lines_in, opened

LINE = StructType([StructField("path", StringType()), StructField("offset", LongType()), StructField("line", StringType())])


class Piece(InputPartition):
    """The lines of a file that end in a range of its bytes."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class TailReader(DataSourceStreamReader):
    """Offsets are a size for each file, as a listing gives it; the driver opens none.

    New bytes are cut into ranges, each a partition.  A range has the lines that end in it, so a size
    in the middle of a line leaves that line to a later batch.
    """

    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.size = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def sizes(self) -> dict[str, int]:
        remote = "://" in self.root
        store, folder = pyarrow.fs.FileSystem.from_uri(self.root) if remote else (pyarrow.fs.LocalFileSystem(), self.root)
        start = self.root[: len(self.root) - len(folder.split("/", 1)[-1])].rstrip("/") + "/" if remote else ""
        found = store.get_file_info(pyarrow.fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return {(start + x.path.split("/", 1)[-1] if remote else x.path): x.size for x in found if x.is_file and fnmatch(x.base_name, self.pattern)}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self.sizes(), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        grown = [(p, before.get(p, 0) if e > before.get(p, 0) else 0, e) for p, e in sorted(now.items()) if e != before.get(p, 0)]  # a file that shrank was written anew
        return [Piece(p, b, min(b + self.size, e)) for p, begin, e in grown for b in range(begin, e, self.size)]

    def read(self, partition: Piece) -> Iterator[tuple]:
        with opened(partition.path) as f:
            for offset, _, kind, line in lines_in(f, partition.begin, partition.end):
                if kind == "line":
                    yield partition.path, offset, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        """Places are in the query's checkpoint; there is nothing else to keep."""


class TailSource(DataSource):
    """spark.readStream.format('session_tail').option('pattern', ...).load(folder): (path, offset, line).

    The folder is a path of a store that Arrow knows, or a local one that every executor has.  A line is read once it
    ends, so nothing is read twice and an unfinished line waits.  Blank lines and those over 16 MiB are passed over.  The
    checkpoint keeps every file's size.
    """

    @classmethod
    def name(cls) -> str:
        return "session_tail"

    def schema(self) -> StructType:
        return LINE

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(self.options)
