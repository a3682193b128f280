"""Job and submission tables: due work, time-outs, retries, idempotent inserts, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell.functions.classify import any_of, permits_redistribution
from tracewell.functions.hashing import corpus_task_id

#: Seconds after which locked work is stale and by which a retry backs off, attempts, and the rate limit.
STALE_SECONDS, BACKOFF_SECONDS, MOST_ATTEMPTS = 300, 30, 3
RATE_LIMIT, RATE_SECONDS = 120, 60
PENDING, TERMINAL = ["queued", "judging", "judged", "publishing"], ["published", "filtered", "failed"]
#: Fixed values: (from, event) to the status after it.
TRANSITIONS = {
    ("queued", "claim"): "judging", ("judging", "scored"): "judged", ("judging", "noise"): "filtered", ("judging", "retry"): "queued", ("judging", "fail"): "failed", ("judging", "stale"): "queued",
    ("judged", "claim"): "publishing", ("publishing", "success"): "published", ("publishing", "retry"): "judged", ("publishing", "fail"): "failed", ("publishing", "stale"): "judged",
}
#: Parts of the messages of failures that no retry mends.
PERMANENT_PARTS = ["missing api key", "api status 400", "api status 401", "api status 403", "invalid outcome", "decode verdict"]


def next_status(status: Column, event: Column) -> Column:
    """The status after an event; null where the event can't happen in a status."""
    out = F.lit(None).cast("string")
    for (a, e), b in TRANSITIONS.items():
        out = F.when((status == a) & (event == e), b).otherwise(out)
    return out


def is_stale(locked_at: Column, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """locked_at and now in microseconds."""
    return F.coalesce(locked_at <= now - seconds * 1_000_000, F.lit(False))


def failure_event(attempts: Column, permanent: Column) -> Column:
    return F.when(permanent | (attempts >= MOST_ATTEMPTS), "fail").otherwise("retry")


def permanent_failure(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return any_of([low.contains(p) for p in PERMANENT_PARTS])


def permanent_publish_failure(http_status: Column, conflict: Column) -> Column:
    """Whether a failed publication is never tried again: a refusal by the store (400, 401), or another task under its id."""
    return F.coalesce(http_status.isin(400, 401), F.lit(False)) | F.coalesce(conflict, F.lit(False))


def is_pending(status: Column) -> Column:
    return status.isin(PENDING)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


def run_after(now: Column, attempts: Column) -> Column:
    """When a failed job is tried again, in microseconds: a step later with each attempt."""
    return now + attempts * BACKOFF_SECONDS * 1_000_000


def due_jobs(jobs: DataFrame, now: Column, limit: int) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.col("run_after") <= now)).orderBy("run_after", "id").limit(limit)


def claimed(jobs: DataFrame, submissions: DataFrame, now: Column, worker: str, limit: int) -> DataFrame:
    """The jobs a micro-batch takes, locked for a worker and with one attempt more, beside their submissions."""
    taken = due_jobs(jobs, now, limit).withColumns({"status": F.lit("judging"), "attempts": F.col("attempts") + 1, "locked_at": now, "locked_by": F.lit(worker), "updated_at": now})
    return taken.join(submissions.drop("status", "attempts", "updated_at"), "submission_id")


def recovered(jobs: DataFrame, submissions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, submissions) after stale locks are let go.

    A stale job whose submission has no scorecard is queued again, and so is the submission; one that has
    a scorecard goes back to judged.  Jobs without a submission stay as they are.
    """
    known = submissions.select(F.col("submission_id").alias("_of"), F.col("scorecard").isNotNull().alias("_judged"))
    stale = (F.col("status") == "judging") & is_stale(F.col("locked_at"), now) & F.col("_of").isNotNull()
    told = jobs.join(known, jobs["submission_id"] == known["_of"], "left").withColumn("_stale", stale)
    after = F.when(F.col("_judged"), "judged").otherwise("queued")
    fresh = told.withColumns({
        "status": F.when(F.col("_stale"), after).otherwise(F.col("status")), "run_after": F.when(F.col("_stale"), now).otherwise(F.col("run_after")),
        "locked_at": F.when(~F.col("_stale"), F.col("locked_at")), "locked_by": F.when(~F.col("_stale"), F.col("locked_by")),
    }).select(jobs.columns)
    back = told.where("_stale").select("submission_id").distinct()
    moved = submissions.join(back.withColumn("_back", F.lit(True)), "submission_id", "left")
    moved = moved.withColumn("status", F.when(F.col("_back"), F.when(F.col("scorecard").isNotNull(), "judged").otherwise("queued")).otherwise(F.col("status")))
    return fresh, moved.select(submissions.columns)


def published(submissions: DataFrame, tasks: DataFrame) -> DataFrame:
    """Submissions that leaderboards and feeds may show: published, scored and stored in the corpus, beside their tasks."""
    good = submissions.where((F.col("status") == "published") & F.col("scorecard").isNotNull())
    return good.join(tasks.where(F.coalesce("github_path", F.lit("")) != ""), "task_id")


def submission_error(t: dict[str, Column], version: int, agreement: str) -> Column:
    """Why a submitted task is refused, null for a good one; the first reason counts.

    t has schema_version, task_id, remote, base_commit, first_prompt, problems (an array), has_patch, licence
    and agreement.  The id is computed anew and has to agree.
    """
    given, want = F.coalesce(t["task_id"], F.lit("")), corpus_task_id(t["remote"], t["base_commit"], t["first_prompt"])
    return (
        F.when(~F.coalesce(t["schema_version"] == version, F.lit(False)), "schema_version").when(given == "", "missing_id").when(given != want, "id_mismatch").when(F.size(t["problems"]) > 0, "not_reproducible")
        .when(t["has_patch"] & ~permits_redistribution(t["licence"]) & ~F.coalesce(t["agreement"] == agreement, F.lit(False)), "agreement")
    )


def pending_files(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Pending record files by name, as many as a scan takes."""
    ordered = files.orderBy("name")
    return ordered if limit is None else ordered.limit(limit)


def limited_requests(requests: DataFrame, key: str, at: str, tie: str, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """requests (key, at in microseconds, tie) with allowed: whether each is let through.

    A window begins with a key's first request after the window before it, so windows aren't aligned.  A
    key's requests pass through one task in order, which keeps a start and a count only.
    """
    dealt = requests.select(key, at, tie).repartition(key).sortWithinPartitions(key, at, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, start, n = object(), None, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None:  # a request without a time is refused and opens no window
                    allowed.append(False)
                    continue
                if k != who or t - start >= seconds * 1_000_000:
                    who, start, n = k, t, 0
                allowed.append(n < limit)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], [key, at, tie, "allowed"])

    return dealt.mapInArrow(run, StructType([*dealt.schema.fields]).add("allowed", "boolean"))


def first_per_payload(new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of the rows of one payload key the first by the order columns, without sorting any key's rows."""
    rest = [c for c in new.columns if c != key]
    best = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(key, "_row.*").select(new.columns)


def insert_new(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of new to add to existing: one a payload, none that is there already."""
    return first_per_payload(new, key, order).join(existing.select(key), key, "left_anti").select(new.columns)


def matured(captured_at: Column, now: Column, hours: int = 24) -> Column:
    """Whether a record of a time in microseconds is old enough to be released."""
    return now - captured_at >= hours * 3_600_000_000
