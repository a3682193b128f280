"""Streaming jobs: submissions as they come, matured records, rate limits per client."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.jobs import RATE_LIMIT, RATE_SECONDS

SUBMISSION = "task_id string, payload string, contributor string, received_at timestamp"


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON submissions dropped into a folder, with their payload's hash."""
    rows = spark.readStream.schema(SUBMISSION + ", _corrupt_record string").json(folder)
    return rows.withColumn("payload_sha256", F.sha2("payload", 256))


def limited(requests: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """A stream of (client, at) with allowed: a window begins with a client's first request after the last.

    State is a start and a count for each client.  It is dropped once the stream's event time has passed the
    window's end, so a backlog that is worked off slowly keeps its windows.
    """

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        allowed = []
        for at in rows["at"].astype("datetime64[us]").astype("int64"):
            if start is None or at - start >= seconds * 1_000_000:
                start, n = at, 1
                allowed.append(True)
            else:
                allowed.append(n < limit)
                n = min(n + 1, limit)
        state.update((int(start), int(n)))
        state.setTimeoutTimestamp(max(int(start) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "at": rows["at"], "allowed": allowed})

    timed = requests.withWatermark("at", f"{seconds} seconds")
    return timed.groupBy("client").applyInPandasWithState(decide, "client string, at timestamp, allowed boolean", "start long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def matured_stream(records: DataFrame, key: str = "session_id", hours: float = 24) -> DataFrame:
    """A stream of records (key, captured_at, ...), each let through once it is old enough.

    A key's younger records wait in its state, as JSON, until the clock releases them.
    """
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    age = int(hours * 3_600_000)

    def release(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        if not state.hasTimedOut:
            waiting += [row for b in batches for row in zip(b["due"].tolist(), b["record"].tolist(), strict=True)]
        now = state.getCurrentProcessingTimeMs()
        ripe = [r for due, r in waiting if due <= now]
        waiting = [(int(due), r) for due, r in waiting if due > now]
        if waiting:
            state.update(([d for d, _ in waiting], [r for _, r in waiting]))
            state.setTimeoutDuration(max(min(d for d, _ in waiting) - now, 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"record": ripe}, dtype="object")

    packed = records.select(F.coalesce(F.col(key), F.lit("")).alias("key"), (F.unix_millis("captured_at") + age).alias("due"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns)), {"ignoreNullFields": "false"}).alias("record"))
    out = packed.groupBy("key").applyInPandasWithState(release, "record string", "due array<bigint>, record array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select(F.from_json("record", columns).alias("r")).select("r.*")


CARRIED = ["session_id", "cwd", "git_branch", "model", "turn_id"]


def carried_stream(lines: DataFrame) -> DataFrame:
    """A stream of dialect B's lines (path, offset, line) with turn_index and the state its records carry forward.

    Each file's state (session, folder, branch, model, turn and number of records) outlives micro-batches, so a
    file that is read in pieces gives the columns that one pass over it gives.  Lines that are no record go.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *carried, n = state.get if state.exists else (*[None] * len(CARRIED), 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("offset", kind="stable")
        for offset, line in zip(rows["offset"].tolist(), rows["line"].tolist(), strict=True):
            try:
                record = json.loads(line)
            except (TypeError, ValueError):
                continue
            if not isinstance(record, dict) or not record.get("type"):
                continue
            payload = record.get("payload") if isinstance(record.get("payload"), dict) else {}
            git = payload.get("git") if isinstance(payload.get("git"), dict) else {}
            meta, context = record["type"] == "session_meta", record["type"] == "turn_context"
            new = [payload.get("id") if meta else None, payload.get("cwd") if meta or context else None, git.get("branch") if meta else None, payload.get("model") if context else None, payload.get("turn_id")]
            carried = [b or a for a, b in zip(carried, new, strict=True)]
            out.append((key[0], offset, n, *carried, line))
            n += 1
        state.update((*carried, n))
        yield pd.DataFrame(out, columns=["path", "offset", "turn_index", *CARRIED, "line"])

    named = ", ".join(f"{c} string" for c in CARRIED)
    return lines.groupBy("path").applyInPandasWithState(follow, f"path string, offset long, turn_index int, {named}, line string", f"{named}, n int", "append", GroupStateTimeout.NoTimeout)
