"""Looking up, rescoring and writing out single records of sessions and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import hashing, scoring


def find_session(events: DataFrame, wanted: str, salt: bytes) -> DataFrame:
    """The events of a session named by its id or by its salted hash."""
    return events.where((F.col("session_id") == wanted) | (hashing.salted(F.col("session_id"), salt) == wanted))


def event_line(columns: list[str]) -> Column:
    """An event as one JSON line; empty fields are left out."""
    return F.to_json(F.struct(*columns))


def read_events(lines: DataFrame, schema: str) -> DataFrame:
    """Events from their JSON lines (line): those that don't parse or have no type are left out."""
    parsed = lines.select(F.from_json("line", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("e"))
    return parsed.where("e._corrupt_record is null and coalesce(e.type, '') <> ''").select("e.*").drop("_corrupt_record")


def rescored(tasks: DataFrame) -> DataFrame:
    """Scores of submitted tasks, which carry no cost, tokens or errors.

    tasks has tool_calls and prompts as arrays, human_turns, files_touched, verification, landed,
    terminated, corrections, interruptions, rework and acceptances.
    """
    turns = F.when(F.coalesce("human_turns", F.lit(0)) > 0, F.col("human_turns")).otherwise(F.size("prompts"))
    rows = tasks.withColumns({"calls": F.size("tool_calls"), "turns": turns})
    s = {c: F.col(c) for c in ("verification", "landed", "terminated", "corrections", "interruptions", "rework", "acceptances", "turns")}
    s |= {"tool_calls": F.col("calls"), "tool_errors": F.lit(0), "edits": F.col("files_touched"), "verified_after_edit": F.lit(False)}
    nobody = F.lit(None).cast("double")
    return rows.withColumns({
        "efficiency": scoring.efficiency(F.lit(0.0), s["tool_calls"]), "autonomy": scoring.autonomy(s["tool_errors"], s["tool_calls"]), "friction": scoring.friction(s["turns"]),
        "success": scoring.success(s["verification"], s["landed"], s["terminated"], nobody), "utility": scoring.deterministic_utility(s), "confidence": scoring.utility_confidence(s, nobody),
    }).drop("calls")


def corpus_url(pull_url: Column, commit: Column, path: Column) -> Column:
    """Where a published file can be read, if its pull request is on the public host; else ''."""
    parts = F.regexp_extract(F.btrim(pull_url), r"^https?://github\.com/+([^/?#]+)/([^/?#]+)", 0)
    owner, name = (F.regexp_extract(F.btrim(pull_url), r"^https?://github\.com/+([^/?#]+)/([^/?#]+)", k) for k in (1, 2))
    whole = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/blob/"), F.url_encode(commit), F.lit("/"), F.ltrim(path, F.lit("/")))
    return F.when((parts != "") & (F.coalesce(commit, F.lit("")) != "") & (F.coalesce(path, F.lit("")) != ""), whole).otherwise("")


def client_key(headers: Column, remote: Column) -> Column:
    """A client's address from a request's headers (a map in lower case), else from its connection."""
    named = [F.nullif(F.btrim(F.try_element_at(headers, F.lit(k))), F.lit("")) for k in ("fly-client-ip", "x-real-ip")]
    forwarded = F.nullif(F.btrim(F.substring_index(F.try_element_at(headers, F.lit("x-forwarded-for")), ",", 1)), F.lit(""))
    return F.coalesce(*named, forwarded, F.regexp_replace(remote, r":\d+$", ""))
