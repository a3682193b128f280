"""The submission store, the log of claims, and task files at their paths."""

import json
import os
import threading

import pytest

SCHEMA = "task_id string, payload string, contributor string, received_at timestamp, _corrupt_record string, payload_sha256 string"


def batch(spark, *rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t, p, "c", None, None, None) for t, p in rows], SCHEMA)
    return df.withColumns({"payload_sha256": F.sha2("payload", 256), "received_at": F.timestamp_seconds(F.lit(1_700_000_000))})


def test_payloads_and_tasks_are_stored_once(spark, tmp_path):
    from tracewell.streaming.store import SubmissionStore

    store = SubmissionStore(str(tmp_path / "s"), buckets=8)
    accept = store.accept(str(tmp_path / "bad"))
    accept(batch(spark, ("t1", "x"), ("t1", "x"), ("t2", "y"), (None, "z"), ("t3", "")), 0)
    names = lambda: sorted((r.task_id, r.batch) for r in store.submissions(spark).collect())
    assert names() == [("t1", 0), ("t2", 0)] and spark.read.parquet(str(tmp_path / "bad")).count() == 2
    for _ in range(2):  # again as after a failure
        accept(batch(spark, ("t1", "x"), ("t1", "changed"), ("t4", "y"), ("t4", "w")), 1)
        assert names() == [("t1", 0), ("t1", 1), ("t2", 0), ("t4", 1)]
        assert sorted((r.task_id, r.payload) for r in store.tasks(spark).collect()) == [("t1", "x"), ("t2", "y"), ("t4", "w")] or sorted((r.task_id, r.payload) for r in store.tasks(spark).collect()) == [("t1", "x"), ("t2", "y"), ("t4", "y")]
        assert store.jobs(spark).count() == store.jobs(spark).select("id").distinct().count() == 4


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    from tracewell.streaming.store import SubmissionStore, bucket_of
    from pyspark.sql import functions as F

    store = SubmissionStore(str(tmp_path / "s"), buckets=64)
    accept = store.accept(str(tmp_path / "bad"))
    accept(batch(spark, *((f"t{k}", f"p{k}") for k in range(300))), 0)
    new = batch(spark, ("t7", "p7")).withColumn("bucket", bucket_of(F.col("payload_sha256"), 64))
    known = store.known(store.submissions(spark), new, "payload_sha256", 1)
    assert known.where("payload_sha256 = sha2('p7', 256)").count() == 1
    assert len({f.split("bucket=")[1].split("/")[0] for f in store.submissions(spark).where("bucket = 1").inputFiles()}) > 1  # all of the table's files
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert known.count() < 30


def jobs(spark, n):
    return spark.createDataFrame([(f"j{k}", f"s{k}", "queued", k, 0) for k in range(n)] + [("late", "s", "queued", 10**15, 0), ("done", "s", "published", 0, 0)], "id string, submission_id string, status string, run_after long, attempts int")


def test_claims_are_stored_once(spark, tmp_path):
    from tracewell.streaming.store import ClaimLog

    log, due = ClaimLog(spark, str(tmp_path)), jobs(spark, 5)
    ids = lambda df: sorted((r.id, r.attempts, r.locked_by) for r in df.collect())
    now = 10**9
    assert ids(log.claim(due, now, "a", 0, 2)) == [("j0", 1, "a"), ("j1", 1, "a")]
    assert ids(log.claim(due, now + 1, "a", 0, 2)) == [("j0", 1, "a"), ("j1", 1, "a")], "a batch that runs again"
    assert ids(log.claim(due, now + 1, "b", 0, 2)) == [("j2", 1, "b"), ("j3", 1, "b")]
    assert ids(log.claim(due, now + 1, "a", 1, 9)) == [("j4", 1, "a")]
    assert ids(log.claim(due, now + 1, "a", 2, 9)) == []
    assert ids(log.claim(due, now + 300_000_000, "b", 1, 1)) == [("j0", 2, "b")], "stale after five minutes"


def test_overlapping_batches_never_take_one_job(spark, tmp_path):
    from tracewell.streaming.store import ClaimLog

    due, got, gate = jobs(spark, 6), {}, threading.Barrier(2, timeout=60)

    def once():
        """Both writers have read version 0 and written their claims before either commits."""
        done = False

        def wait():
            nonlocal done
            if not done:
                done = True
                gate.wait()

        return wait

    def work(name):
        got[name] = {r.id for r in ClaimLog(spark, str(tmp_path)).claim(due, 10**9, name, 0, 3, once()).collect()}

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(len, got.values())) == [3, 3] and not got["a"] & got["b"]
    log = ClaimLog(spark, str(tmp_path))
    assert [e["version"] for e in log.versions()] == [0, 1] and log.claims().count() == 6 and len(os.listdir(tmp_path / "claims")) == 2


def test_task_files_at_their_paths(spark, tmp_path):
    from tracewell.sources.sinks import write_tasks

    def files():
        return sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names)

    for n in (1, 2):
        write_tasks(spark.createDataFrame([("sha256:ab12", n), ("sha256:cd34", 0)][: 3 - n], "task_id string, n int"), str(tmp_path))
    assert files() == ["tasks/sha256/ab/ab12.json", "tasks/sha256/cd/cd34.json"]
    assert json.loads((tmp_path / "tasks/sha256/ab/ab12.json").read_text()) == {"task_id": "sha256:ab12", "n": 2}
    with pytest.raises(Exception, match="no task id"):
        write_tasks(spark.createDataFrame([("sha256:ef56", 1), ("bad", 2)], "task_id string, n int").coalesce(1), str(tmp_path))
    assert files() == ["tasks/sha256/ab/ab12.json", "tasks/sha256/cd/cd34.json"] and sorted(os.listdir(tmp_path)) == ["tasks"], "a job that fails leaves nothing"
