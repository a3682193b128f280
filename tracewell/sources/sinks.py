"""Tables that sessions and tasks are written to, safe to write again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.text import safe_component
from tracewell.operators.latest import latest_per

from .task_files import write_task_files


def append_facts(rows: DataFrame, path: str) -> None:
    """Add resolved facts to the fact table; a job that fails adds nothing."""
    rows.write.mode("append").parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """existing with new's rows in place of those of the same keys: of each key the last by the order."""
    return latest_per(existing.unionByName(new), keys, order)


def write_snapshots(rows: DataFrame, path: str, key: str = "session_id") -> None:
    """Write pending records, one folder a session, in place of that session's earlier ones."""
    named = rows.withColumn("session", safe_component(F.col(key)))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").json(path)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Write published tasks as JSON below path, each in the file that its id names, in place of an earlier version."""
    write_task_files(tasks, path)
