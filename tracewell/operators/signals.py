"""Signals of sessions: the fold over normalized events, and outcomes from facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import classify, scoring, text
from tracewell.functions.rawjson import file_names
from tracewell.functions.regex import re2
from tracewell.sources.scratch import scratch_path

from .carry import last_result_per_call, seen_before


def session_fold(events: DataFrame) -> DataFrame:
    """One row a session file: model, token sums, counts by kind, errors, and duration in ms."""
    call, result = F.col("type") == "tool_call", F.col("type") == "tool_result"
    order = F.struct("offset", "place")
    seen = F.when(F.coalesce("model", F.lit("")) != "", order)
    out = events.groupBy("path").agg(
        F.max_by("model", seen).alias("model"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("cache_creation_input_tokens") + F.col("cache_read_input_tokens")).alias("cache_tokens"), F.count_if(F.col("type") == "user_prompt").alias("turns"), F.count_if(call).alias("tool_calls"),
        F.count_if(call & classify.is_web_tool(F.col("name"))).alias("web_fetches"), F.count_if(call & classify.is_edit_tool(F.col("name"))).alias("edits"),
        F.count_if(result & F.coalesce(F.col("result.is_error"), F.lit(False))).alias("tool_errors"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
    )
    return out.withColumn("duration_ms", F.coalesce(F.unix_millis("ended_at") - F.unix_millis("started_at"), F.lit(0)))


def is_scorable(fold: DataFrame) -> DataFrame:
    return fold.where("tool_calls > 0 or turns > 0 or input_tokens > 0")


def noted(facts: DataFrame) -> DataFrame:
    """facts with what their texts say in place of the texts: flags of commands, files of edits, signs in results and messages."""
    kind, body = F.col("kind"), F.col("body")
    call, user, result = kind == "call", kind == "user", kind == "result"
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = facts.withColumns({"id": F.coalesce("id", F.lit("")), "command": F.nullif(F.when(call & classify.is_exec_tool(F.col("name")), text.command_of(body)), F.lit(""))})
    command = F.col("command")
    rows = rows.withColumn("edit", yes(call & (classify.is_edit_tool(F.col("name")) | yes(command.rlike(re2(classify.EDIT_BY_SHELL))))))
    return rows.select(
        "path", "offset", "place", "kind", "id", "is_error", "edit", yes(command.rlike(re2(classify.VERIFY_COMMAND))).alias("verify"), yes(command.rlike(re2(classify.LAND_COMMAND))).alias("land"),
        F.when(F.col("edit"), edited_files(body, command)).alias("files"), F.when(result, yes(classify.output_failed(body))).alias("says_failed"), F.when(result, F.regexp_count(body, F.lit(re2(classify.DIFF_HUNK)))).alias("hunks"),
        F.when(user, classify.skill_name(body)).alias("skill"), yes(user & body.rlike(re2(classify.INTERRUPTION))).alias("cut_off"), yes(user & (text.strip(F.coalesce(body, F.lit(""))) != "")).alias("said_something"),
        F.when(user, classify.reaction(body)).alias("reaction"), F.when(kind == "end", body).alias("reason"),
    )


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written to the scratch folder and read back: sessions are parsed once, and plans over them stay short."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def outcome_signals(facts: DataFrame) -> DataFrame:
    """One row a session file of what its facts say: verification, landing, termination, turns, scope.

    The columns that end in _at are the byte places of the records that tell: the last verification's result,
    the first landing that succeeded (else the first that was answered), the last end or result, the first passed
    verification after an edit, the first second edit of a file; null where nothing tells.  Everything is a window or
    an aggregate over a file's own rows.  A file without facts has no row.
    """
    order = ["offset", "place"]
    at = F.struct(*order)
    rows = stored(noted(facts), "session-steps")
    call = F.col("kind") == "call"
    rows = seen_before(rows, "edited", F.col("edit"), ["path"], order)
    rows = seen_before(rows, "spoken", F.col("kind") == "assistant", ["path"], order)

    results = last_result_per_call(rows.where("kind = 'result'").select("path", "id", *order, "is_error", "says_failed"), ["path"], "id", order)
    results = results.select("path", "id", F.lit(True).alias("answered"), (F.col("is_error") | F.col("says_failed")).alias("failed"), F.col("offset").alias("answer_at"))
    tried = rows.where("verify or land").join(results, ["path", "id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False)))
    ok = F.col("answered") & ~F.coalesce("failed", F.lit(True))
    tried = tried.groupBy("path").agg(
        F.max_by(F.struct("answered", "failed", "answer_at"), F.when(F.col("verify"), at)).alias("last_verify"), F.max(F.col("verify") & F.col("edited") & ok).alias("verified_after_edit"),
        F.min_by("answer_at", F.when(F.col("verify") & F.col("edited") & ok, at)).alias("verified_after_edit_at"), F.min_by("answer_at", F.when(F.col("land") & ok, at)).alias("landed_at"), F.min_by("answer_at", F.when(F.col("land") & F.col("answered"), at)).alias("land_tried_at"),
        F.count_if("land").alias("landings"), F.max(F.col("land") & ok).alias("land_ok"), F.max(F.col("land") & ~F.col("answered")).alias("land_open"),
    )

    named = named_files(rows.where("edit")).withColumn("nth", F.row_number().over(Window.partitionBy("path", "file").orderBy(*order))).groupBy("path", "file").agg(F.count("*").alias("n"), F.max(F.when(F.col("nth") == 2, F.col("offset"))).alias("again_at"))
    test = F.lower("file").contains("test") | F.lower("file").contains("spec")
    scope = named.groupBy("path").agg(F.count("*").alias("files_touched"), F.count_if(test).alias("test_files"), F.sum(F.col("n") - 1).alias("rework"), F.min("again_at").alias("rework_at"))
    edit_calls = rows.where("edit and id <> ''").groupBy("path", "id").agg(F.min(at).alias("called"))
    hunks = rows.where("kind = 'result'").join(edit_calls, ["path", "id"]).where(at > F.col("called")).groupBy("path").agg(F.sum("hunks").alias("diff_hunks"))

    skill, cut_off = F.col("skill"), F.col("cut_off")
    human = (F.col("kind") == "user") & skill.isNull() & ~cut_off & F.col("said_something")
    said = F.when(human & F.col("spoken"), F.col("reaction"))
    moves = F.when(~call | (F.col("id") != ""), at)
    ended = F.when(F.coalesce("reason", F.lit("")) != "", at)
    base = rows.groupBy("path").agg(
        F.count_if(human).alias("human_turns"), F.count_if(cut_off).alias("interruptions"), F.count_if(said == "correction").alias("corrections"), F.count_if(said == "acceptance").alias("acceptances"),
        F.max(F.col("kind") == "pr_link").alias("pr_link"), F.count_if("edit").alias("edit_count"), F.max_by("reason", ended).alias("end_reason"), F.max_by(F.struct("kind", "id"), moves).alias("last_move"),
        F.max_by("is_error", F.when(F.col("kind") == "result", at)).alias("last_error"), F.max(F.when(F.col("kind") == "result", F.col("offset"))).alias("last_result_at"),
        F.max(F.when(F.col("kind") == "pr_link", F.col("offset"))).alias("pr_link_at"), F.max(F.when(F.coalesce("reason", F.lit("")) != "", F.col("offset"))).alias("ended_at"),
        F.transform(F.sort_array(F.collect_list(F.when(skill.isNotNull(), F.struct("offset", "place", skill.alias("skill"))))), lambda s: s["skill"]).alias("skills"),
    )
    joined = base.join(tried, "path", "left").join(scope, "path", "left").join(hunks, "path", "left")
    last = joined.select("path", F.col("last_move.id").alias("id")).join(results.select("path", "id", "answered"), ["path", "id"], "left").select("path", F.coalesce("answered", F.lit(False)).alias("last_answered"))
    joined = joined.join(last, "path")
    pending = (F.col("last_move.kind") == "call") & ~F.col("last_answered")
    verification = F.when(F.col("last_verify").isNull() | ~F.col("last_verify.answered"), "").when(F.col("last_verify.failed"), "failed").otherwise("passed")
    landing = F.when(F.col("pr_link"), "pr_link").when(F.coalesce("landings", F.lit(0)) == 0, "none").when(F.col("land_ok"), "succeeded").when(F.col("land_open"), "attempted_unknown").otherwise("failed")
    termination = (
        F.when(F.col("end_reason") == "success", "clean").when(F.col("end_reason").isNotNull() | F.coalesce(pending, F.lit(False)), "abandoned")
        .when(F.col("last_error"), "abandoned").when(F.col("last_error").isNotNull(), "clean").otherwise("unknown")
    )
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select(
        "path", verification.alias("verification"), landing.alias("landing_quality"), termination.alias("termination"), "human_turns", "interruptions", "corrections", "acceptances", number("rework"),
        F.coalesce("verified_after_edit", F.lit(False)).alias("verified_after_edit"), F.array_distinct("skills").alias("skills_used"), (F.size("skills") > 0).alias("skill_assisted"),
        number("files_touched"), number("test_files"), "edit_count", number("diff_hunks"),
        F.when(verification != "", F.col("last_verify.answer_at")).alias("verification_at"), F.when(F.col("pr_link"), F.col("pr_link_at")).otherwise(F.coalesce("landed_at", "land_tried_at")).alias("landing_at"),
        F.when(F.col("end_reason").isNotNull(), F.col("ended_at")).otherwise(F.col("last_result_at")).alias("termination_at"), "verified_after_edit_at", "rework_at",
    )


def edited_files(body: Column, command: Column) -> Column:
    """The files that an edit's input names, cleaned, or else those in its command."""
    clean = lambda names: F.array_distinct(F.filter(F.transform(names, text.evidence_path), lambda f: f != ""))
    own = clean(file_names(body))
    return F.when(F.size(own) > 0, own).otherwise(clean(file_names(F.coalesce(command, F.lit("")))))


def named_files(edits: DataFrame) -> DataFrame:
    """(path, offset, place, file) for each file of edits (path, offset, place, files)."""
    return edits.select("path", "offset", "place", F.explode("files").alias("file"))


def evidence(facts: DataFrame) -> DataFrame:
    """(path, evidence): per session file its observed signals in order, as (signal, value, offset, detail); details are fixed values."""
    order = ["offset", "place"]
    rows = seen_before(facts, "spoken", F.col("kind") == "assistant", ["path"], order)
    call = F.col("kind") == "call"
    rows = rows.withColumns({"command": F.when(call & classify.is_exec_tool(F.col("name")), text.command_of(F.col("body"))), "skill": F.when(F.col("kind") == "user", classify.skill_name(F.col("body")))})
    command, skill = F.col("command"), F.col("skill")
    edit = call & (classify.is_edit_tool(F.col("name")) | F.coalesce(command.rlike(re2(classify.EDIT_BY_SHELL)), F.lit(False)))
    rows = rows.withColumns({"files": F.when(edit, edited_files(F.col("body"), command)), "is_edit": F.coalesce(edit, F.lit(False)), "nth_skill": F.row_number().over(Window.partitionBy("path", "skill").orderBy(*order))})
    new_skill = skill.isNotNull() & (F.col("nth_skill") == 1)
    cut_off = (F.col("kind") == "user") & skill.isNull() & F.coalesce(F.col("body").rlike(re2(classify.INTERRUPTION)), F.lit(False))
    said = F.when((F.col("kind") == "user") & skill.isNull() & ~cut_off & F.col("spoken"), classify.reaction(F.col("body")))
    one = lambda signal, value, detail: F.struct(F.lit(signal).alias("signal"), value.alias("value"), F.col("offset"), detail.alias("detail"))
    found = F.array_compact(F.array(
        F.when(F.col("kind") == "pr_link", one("landing_quality", F.lit("pr_link"), F.lit("pr-link record"))),
        F.when(F.coalesce(command.rlike(re2(classify.VERIFY_COMMAND)), F.lit(False)), one("verification", F.lit("ran"), F.col("name"))),
        F.when(F.coalesce(command.rlike(re2(classify.LAND_COMMAND)), F.lit(False)), one("landing_quality", F.lit("attempted"), F.col("name"))),
        F.when(new_skill, one("skill_used", skill, F.lit("skill injection"))),
        F.when(cut_off, one("interruption", F.lit("true"), F.lit("developer interrupted the agent"))),
        F.when(said == "correction", one("human_correction", F.lit("true"), F.lit("matched correction phrase"))), F.when(said == "acceptance", one("human_acceptance", F.lit("true"), F.lit("matched acceptance phrase"))),
    ))
    scope = F.when(F.size("files") > 0, F.transform("files", lambda f: one("scope", F.lit("edit"), F.lit("file")))).when(F.col("is_edit"), F.array(one("scope", F.lit("edit"), F.lit("file unknown"))))
    listed = rows.select("path", *order, F.posexplode(F.concat(found, F.coalesce(scope, F.array().cast(EVIDENCE)))).alias("n", "e"))
    return listed.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct(*order, "n", "e"))), lambda x: x["e"]).alias("evidence"))


EVIDENCE = "array<struct<signal:string,value:string,offset:bigint,detail:string>>"


def finalized(outcomes: DataFrame, listed: DataFrame) -> DataFrame:
    """outcomes with evidence: what was observed, in order, then what it comes to, with the places that tell; details are fixed values."""
    c = F.col
    one = lambda signal, value, at, detail: F.struct(F.lit(signal).alias("signal"), value.alias("value"), F.coalesce(c(at), F.lit(0)).cast("long").alias("offset"), F.lit(detail).alias("detail"))
    said = F.array_compact(F.array(
        F.when(c("verification") != "", one("verification", c("verification"), "verification_at", "last verification result")), F.when(c("landing_quality") != "none", one("landing_quality", c("landing_quality"), "landing_at", "")),
        F.when(c("termination") != "unknown", one("termination", c("termination"), "termination_at", "")), F.when(c("rework") > 0, one("rework", F.lit("true"), "rework_at", "same file edited repeatedly")),
        F.when(c("verified_after_edit"), one("verified_after_edit", F.lit("true"), "verified_after_edit_at", "")),
    ))
    return outcomes.join(listed, "path", "left").withColumn("evidence", F.concat(F.coalesce("evidence", F.array().cast(EVIDENCE)), said))


def evidence_count(evidence_: Column, signal: str) -> Column:
    """How often a signal stands in a session's evidence."""
    return F.size(F.filter(evidence_, lambda e: e["signal"] == signal))


def scored(fold: DataFrame, outcomes: DataFrame, judged: str | None = None) -> DataFrame:
    """Scores of session files from their fold and outcomes; turns are human turns where these are known."""
    rows = is_scorable(fold).join(outcomes, "path", "left")
    rows = rows.withColumns({
        "turns": F.coalesce("human_turns", "turns"), "landed": F.coalesce(F.col("landing_quality").isin("succeeded", "pr_link"), F.lit(False)),
        "terminated": F.when(F.col("termination") == "clean", True).when(F.col("termination") == "abandoned", False),
        "verification": F.coalesce("verification", F.lit("")), "cost": scoring.cost_usd(F.coalesce("model", F.lit("")), F.col("input_tokens"), F.col("output_tokens"), F.col("cache_tokens")),
        **{c: F.coalesce(c, F.lit(0)) for c in ("corrections", "acceptances", "interruptions", "rework")},
    })
    s = {c: F.col(c) for c in rows.columns}
    judge = F.col(judged).cast("double") if judged else F.lit(None).cast("double")
    return rows.select(
        "path", "model", "cost", scoring.efficiency(s["cost"], s["tool_calls"]).alias("efficiency"), scoring.autonomy(s["tool_errors"], s["tool_calls"]).alias("autonomy"), scoring.friction(s["turns"]).alias("friction"),
        scoring.success(s["verification"], s["landed"], s["terminated"], judge).alias("success"), scoring.utility(s, judge).alias("utility"), scoring.utility_confidence(s, judge).alias("confidence"),
        scoring.utility_evidence(s).alias("evidence"),
    )
