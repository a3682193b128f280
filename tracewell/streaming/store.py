"""Submissions and claims as tables that several micro-batches and writers share: a key index by buckets, and a log of claims."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.jobs import STALE_SECONDS, due_jobs, first_per_payload

#: Buckets of the key index; a batch reads only those that its own keys fall in.
BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A partitioned table, empty where nothing was written yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, bucket int, batch long")
    return spark.read.schema(f"{schema}, bucket int, batch long").option("basePath", path).parquet(path)


class SubmissionStore:
    """Submissions by payload and tasks by id, each a key index of BUCKETS folders.

    A payload that is known gives no new submission and no new job; a new payload of a known task gives both, and leaves
    the task's first record as it is.  A batch's rows stand in folders of its own number below each bucket, in place of
    what an earlier try left there, and keys are looked up in other batches' rows; so a batch that runs again
    changes nothing.  Submissions are named by their payload for the same reason.
    """

    SUBMISSION = "payload_sha256 string, submission_id string, task_id string, contributor string, received_at timestamp"
    TASK = "task_id string, payload string"

    def __init__(self, root: str, buckets: int = BUCKETS):
        self.root, self.buckets = root.rstrip("/"), buckets

    def submissions(self, spark: SparkSession) -> DataFrame:
        return committed(spark, f"{self.root}/submissions", self.SUBMISSION)

    def tasks(self, spark: SparkSession) -> DataFrame:
        return committed(spark, f"{self.root}/tasks", self.TASK)

    def jobs(self, spark: SparkSession) -> DataFrame:
        """(id, submission_id, status, run_after, attempts): each submission's job as it was queued."""
        rows = self.submissions(spark)
        return rows.select(F.col("submission_id").alias("id"), "submission_id", F.lit("queued").alias("status"), F.unix_micros("received_at").alias("run_after"), F.lit(0).alias("attempts"))

    def known(self, index: DataFrame, new: DataFrame, key: str, number: int) -> DataFrame:
        """The keys of an index of other batches in the buckets that new has; new's buckets are at most as many as there are."""
        touched = [r[0] for r in new.select("bucket").distinct().collect()]
        return index.where(F.col("bucket").isin(touched) & (F.col("batch") != number)).select("bucket", key)

    def added(self, index: DataFrame, new: DataFrame, key: str, order: list[str], number: int) -> DataFrame:
        first = first_per_payload(new, key, order).withColumn("bucket", bucket_of(F.col(key), self.buckets))
        return first.join(self.known(index, first, key, number), ["bucket", key], "left_anti").withColumn("batch", F.lit(number).cast("long"))

    def accept(self, quarantine: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function over flows.submissions(): bad rows go to the quarantine, good ones to the store."""

        def run(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            batch = batch.persist()
            try:
                bad = F.col("_corrupt_record").isNotNull() | F.col("task_id").isNull() | (F.coalesce("payload", F.lit("")) == "")
                batch.where(bad).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
                good = batch.where(~bad).drop("_corrupt_record")
                tasks = self.added(self.tasks(spark), good.select("task_id", "payload", "received_at"), "task_id", ["received_at", "payload"], number)
                self._write(tasks.drop("received_at"), "tasks")
                named = good.withColumn("submission_id", F.concat(F.lit("sub_"), F.substring("payload_sha256", 1, 24))).drop("payload")
                self._write(self.added(self.submissions(spark), named, "payload_sha256", ["received_at", "task_id"], number), "submissions")
            finally:
                batch.unpersist()

        return run

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(f"{self.root}/{name}")


class ClaimLog:
    """Claims of jobs, stored once each: a log of versions, each of which names a folder of claims.

    A claim is worked out from the log as it stands, written, and committed by creating the next version's file, which
    only one writer can do; another one that worked from the same version works out its claim again.  A batch that runs
    again finds its version and gets the jobs it took before.  A job is free again once its last claim is stale.
    """

    CLAIM = "id string, submission_id string, attempts int, locked_at long, locked_by string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        self.fs = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.folder)

    def versions(self) -> list[dict]:
        """The log's entries in order: version, worker, batch, folder and time."""
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(self.folder) if s.getPath().getName().endswith(".json"))
        return [json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self.fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, n)), "UTF-8")) for n in found]

    def _commit(self, entry: dict) -> bool:
        """Whether this writer made the version."""
        name = f"{entry['version']:012d}.json"
        local = str(self.folder).removeprefix("file:") if str(self.fs.getScheme()) == "file" else None
        data = json.dumps(entry).encode()
        if local:
            staged = f"{local}/.{uuid.uuid4().hex}"
            with open(staged, "wb") as f:
                f.write(data)
            try:
                os.link(staged, f"{local}/{name}")  # fails where the name is taken, and the file is whole from the start
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(staged)
        try:
            out = self.fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(self.folder, name), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def _read(self, entries: list[dict]) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], self.CLAIM)
        return self.spark.read.schema(self.CLAIM).parquet(*(f"{self.root}/claims/{e['folder']}" for e in entries))

    def claims(self) -> DataFrame:
        """All claims that were committed."""
        return self._read(self.versions())

    def claim(self, jobs: DataFrame, now: int, worker: str, batch: int, limit: int, before_commit: Callable[[], None] | None = None) -> DataFrame:
        """The due jobs that a worker's batch takes: at most limit, by run_after and id, none that another claim holds.

        now is in microseconds.  attempts counts on from the job's last claim.
        """
        while True:
            log = self.versions()
            mine = [e for e in log if (e["worker"], e["batch"]) == (worker, batch)]
            if mine:
                return self._read(mine)
            held = self._read([e for e in log if e["at"] > now - STALE_SECONDS * 1_000_000])
            free = due_jobs(jobs.join(held, "id", "left_anti"), F.lit(now), limit)
            last = self._read(log).groupBy("id").agg(F.max("attempts").alias("tried"))
            taken = free.join(last, "id", "left").select("id", "submission_id", (F.greatest(F.coalesce("tried", F.lit(0)), "attempts") + 1).cast("int").alias("attempts"), F.lit(now).cast("long").alias("locked_at"), F.lit(worker).alias("locked_by"))
            folder = f"{worker}-{batch}-{uuid.uuid4().hex}"
            taken.write.parquet(f"{self.root}/claims/{folder}")
            if before_commit:
                before_commit()
            if self._commit({"version": len(log), "worker": worker, "batch": batch, "folder": folder, "at": now}):
                return self._read([{"folder": folder}])
            lost = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{folder}")
            self.fs.delete(lost, True)
