"""Normalized events of growing files as a stream, with each file's parser state kept between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.sources import dialects
from tracewell.sources.dialects import AT_END, CARRIED, LET_GO, OWN, TOKENS

#: Seconds without a new record after which a file's held message is let go.
FLUSH_SECONDS = 30.0
#: What goes through the state as it is, nested values as JSON.
PASSED = ["event", "hash", "stamp", "tool_call_id", "name", "arguments", "result"]
OUT = "path string, offset long, emitted long, place int, turn_index int, " + ", ".join(f"{c} string" for c in CARRIED) + ", " + ", ".join(f"{c} long" for c in TOKENS) + ", " + ", ".join(f"{c} string" for c in PASSED)
COLUMNS = [c.split()[0] for c in OUT.split(", ")]
STATE = ", ".join(f"{c} string" for c in CARRIED) + ", n int, last long, held string, " + ", ".join(f"{c} long" for c in TOKENS)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileState(StatefulProcessor):
    """Follows a file's records: carried fields, a count, at most one held message, and tokens that wait for a message."""

    def __init__(self, flush_seconds: float):
        self.wait = max(int(flush_seconds * 1000), 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("file", STATE)

    def load(self) -> dict:
        names = [c.split()[0] for c in STATE.split(", ")]
        return dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names) | {"n": 0, "last": 0} | dict.fromkeys(TOKENS, 0)

    def save(self, s: dict) -> None:
        self.state.update(tuple(s.values()))

    @staticmethod
    def let_go(s: dict, emitted: int, place: int) -> list[dict]:
        if s["held"] is None:
            return []
        held = json.loads(s["held"])
        s["held"] = None
        return [held | {"emitted": emitted, "place": place}]

    @staticmethod
    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[r.get(c) for c in COLUMNS] for r in rows], columns=COLUMNS, dtype="object")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, out = self.load(), []
        records = pd.concat(list(rows)).sort_values("offset", kind="stable").astype(object)
        for r in records.where(records.notna(), None).to_dict("records"):
            offset = int(r["offset"])
            for name, new in CARRIED.items():
                s[name] = r[new] or s[name]
            if r["is_boundary"] or r["is_assistant"]:
                out += self.let_go(s, offset, LET_GO)
            if r[TOKENS[0]] is not None:
                to = json.loads(s["held"]) if s["held"] is not None else s
                to |= {t: to[t] + int(r[t]) for t in TOKENS}
                if s["held"] is not None:
                    s["held"] = json.dumps(to)
                else:
                    s = to
            if r["event"] is not None:
                row = {c: r[c] for c in PASSED} | {c: s[c] for c in CARRIED} | {"path": key[0], "offset": offset, "emitted": offset, "place": OWN, "turn_index": s["n"]} | dict.fromkeys(TOKENS, 0)
                if r["is_assistant"]:
                    s |= {"held": json.dumps(row | {t: s[t] for t in TOKENS})} | dict.fromkeys(TOKENS, 0)
                else:
                    out.append(row)
            s |= {"n": s["n"] + 1, "last": offset}
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s["held"] is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        self.save(s)
        yield self.frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self.load()
        out = self.let_go(s, s["last"], AT_END)
        self.save(s)
        yield self.frame(out)

    def close(self) -> None:
        """State is the query's."""


def events_b_stream(lines: DataFrame, salt: bytes, flush_seconds: float = FLUSH_SECONDS) -> DataFrame:
    """A stream of dialect B's lines (path, offset, line) as the events that one pass of events_b() over them gives.

    Records are parsed and hashed without state; only what they set, count and hold goes through the file's state, which is
    one row whatever the file's length.  A held message leaves with the record that lets it go, or once its file has been
    still for flush_seconds, with the place of a file's end; tokens that come later wait for the next message.  A null path is a file of its own.
    State has timers, for which the session's state store has to be RocksDB; as a timer may always come, a query of
    trigger availableNow goes on, and one that is to end takes trigger once.
    """
    spark = lines.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass has to be {PROVIDER}")
    shaped = lines.withColumns({"kind": F.lit("line"), "line_no": F.lit(0)})
    steps = dialects.steps_b(shaped, salt)
    flat = steps.withColumns({"path": F.coalesce("path", F.lit("")), "arguments": F.to_json("arguments"), "result": F.to_json("result")})
    rows = flat.groupBy("path").transformWithStateInPandas(FileState(flush_seconds), OUT, "Append", "ProcessingTime")
    kinds = dict(steps.dtypes)
    return dialects.finished_b(rows.withColumns({c: F.from_json(c, kinds[c]) for c in ("arguments", "result")}))
