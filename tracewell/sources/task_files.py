"""Published tasks as files of their own, at the paths their ids name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def task_path(task_id: str) -> str:
    """tasks/sha256/<the first two digits>/<all digits>.json"""
    digits = (task_id or "").removeprefix("sha256:")
    if not (task_id or "").startswith("sha256:") or len(digits) < 2 or "/" in digits:
        raise ValueError(f"no task id of sha256: {task_id!r}")
    return f"tasks/sha256/{digits[:2]}/{digits}.json"


def store_of(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in root and not root.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(root)
    return pyarrow.fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root


@dataclass
class Written(WriterCommitMessage):
    """The paths that a task staged."""

    paths: list[str]


class TaskWriter(DataSourceWriter):
    """Stages a file a row; a job that commits moves them to their places, one that fails leaves nothing."""

    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = store_of(self.root)
        task = f"{root}/{self.job}/{uuid.uuid4().hex}"  # a task that is tried again stages anew
        paths = []
        for row in rows:
            path = task_path(row.task_id)
            store.create_dir(f"{task}/{path.rsplit('/', 1)[0]}", recursive=True)
            with store.open_output_stream(f"{task}/{path}") as out:
                out.write(row.body.encode())
            paths.append(f"{task}/{path}")
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = store_of(self.root)

        def move(staged: str) -> None:
            target = f"{root}/tasks/{staged.split('/tasks/')[-1]}"
            store.create_dir(target.rsplit("/", 1)[0], recursive=True)
            store.move(staged, target)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(move, [p for m in messages if m for p in m.paths]))
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*store_of(self.root))

    def _clean(self, store: pyarrow.fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


class TaskFiles(DataSource):
    """df (task_id, body).write.format('task_files').mode('append').save(root): a file a task, at its path below root."""

    @classmethod
    def name(cls) -> str:
        return "task_files"

    def schema(self) -> StructType:
        return StructType.fromDDL("task_id string, body string")

    def writer(self, schema: StructType, overwrite: bool) -> TaskWriter:
        return TaskWriter(self.options["path"])


def write_task_files(tasks: DataFrame, root: str) -> None:
    """Write tasks as JSON files below root, each at its id's path; of equal ids one row may stand, and an earlier file is replaced."""
    tasks.sparkSession.dataSource.register(TaskFiles)
    body = F.to_json(F.struct(*(F.col(f"`{c}`") for c in tasks.columns)))
    tasks.select("task_id", body.alias("body")).write.format("task_files").mode("append").save(root)
