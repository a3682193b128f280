"""The two session dialects as one table of normalized events, and as facts for signal extraction.

Events have the columns of EVENT: an envelope, the variant's own columns, and their places.  offset is the
record an event comes from; (path, emitted, place) is the order in which events leave: an assistant message of dialect B is
held until a later record lets it go, so it comes after the calls that followed it.  Texts and arguments leave this module as salted hashes only; facts keep
texts, for use inside a job.  Values that aren't texts of blocks are hashed as the bytes of their source, whatever its spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import hashing, text
from tracewell.functions.classify import output_failed, skill_name
from tracewell.functions.rawjson import canonical_json, raw_values
from tracewell.operators.carry import forward_fill, held_tokens

from .lines import base_name, dialect_of, rollout_session

SCHEMA_VERSION = 1
METRICS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
RECORD_A = f"""type string, uuid string, sessionId string, timestamp string, cwd string, gitBranch string, isSidechain boolean, subtype string,
message struct<role:string,model:string,usage:struct<{','.join(m + ':bigint' for m in METRICS)}>,content:string>, _corrupt_record string"""
RECORD_B = """timestamp string, type string, payload struct<id:string,timestamp:string,cwd:string,git:struct<branch:string>,turn_id:string,model:string,type:string,role:string,name:string,call_id:string,
content:string,arguments:string,output:string,info:struct<last_token_usage:struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>>>, _corrupt_record string"""
CALLS_B = ["function_call", "custom_tool_call", "web_search_call", "tool_search_call"]
RESULTS_B = ["function_call_output", "custom_tool_call_output", "web_search_output", "tool_search_output"]
EVENT = [
    "path", "offset", "emitted", "place", "schema_version", "type", "harness", "git_branch", "session_id", "cwd", "model", "event_id", "ts", "turn_index", "is_subagent", *METRICS,
    "prompt_hash", "message_hash", "tool_call_id", "name", "arguments", "result", "reason",
]


def blocks_of(content: Column) -> Column:
    """The blocks of a content array; null for strings and empty arrays."""
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, BLOCKS))
    return F.when(F.size(blocks) > 0, blocks)


def content_hash(raw: Column, blocks: Column, salt: bytes) -> Column:
    """The hash of a message: of its text blocks if it has blocks, else of the whole content as its source has it."""
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & (F.coalesce(b["text"], F.lit("")) != "")), lambda b: b["text"])
    return F.when(blocks.isNull(), hashing.salted_json(raw, salt)).otherwise(hashing.salted_list(texts, salt))


def reencoded(value: Column, raw: Column) -> Column:
    """A call's input as records keep it: objects and arrays as canonical JSON, strings as they are."""
    nested = F.when(raw.rlike(r"^[\[{]"), raw)
    return F.coalesce(canonical_json(nested), value)


def sanitized_input(raw: Column, salt: bytes) -> Column:
    """A call's arguments as their hash, sorted keys and JSON type."""
    kind = text.json_type(raw)
    return F.struct(hashing.salted_json(raw, salt).alias("hash"), F.when(kind == "object", text.json_keys(raw)).alias("keys"), kind.alias("json_type"))


def sanitized_result(raw: Column, is_error: Column, salt: bytes) -> Column:
    return F.struct(hashing.salted_json(raw, salt).alias("hash"), text.json_type(raw).alias("json_type"), is_error.alias("is_error"))


def _records(lines: DataFrame, schema: str, raw: dict[str, str] | None = None) -> DataFrame:
    """Parsed records of good lines; those that don't parse or lack a type are left out.  raw names paths whose source spelling is wanted."""
    parsed = lines.where("kind = 'line'").withColumn("r", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("r._corrupt_record is null and coalesce(r.type, '') <> ''").select("path", "offset", "line_no", "r.*", *([raw_values(F.col("line"), **raw).alias("raw")] if raw else [])).drop("_corrupt_record")


def records_a(lines: DataFrame, **raw: str) -> DataFrame:
    """Dialect A's records; turn_index counts every line read, also those that don't parse."""
    return _records(lines, RECORD_A, raw).withColumnRenamed("line_no", "turn_index")


def _finished(rows: DataFrame) -> DataFrame:
    missing = {c: F.lit(None) for c in EVENT if c not in rows.columns}
    types = {"arguments": "struct<hash:string,keys:array<string>,json_type:string>", "result": "struct<hash:string,json_type:string,is_error:boolean>", "is_subagent": "boolean"}
    typed = {c: v.cast(types.get(c, "string")) for c, v in missing.items()}
    return rows.withColumns(typed).withColumns({m: F.coalesce(F.col(m).cast("long"), F.lit(0)) for m in METRICS}).withColumn("schema_version", F.lit(SCHEMA_VERSION)).select(EVENT)


def events_a(lines: DataFrame, salt: bytes) -> DataFrame:
    """Normalized events of dialect A's lines.

    A user record is a prompt, then its tool results; an assistant record a message, then its calls,
    of which the first event alone carries the tokens.
    """
    _require(salt)
    r = records_a(lines, content="message.content", inputs="message.content[].input", contents="message.content[].content")
    m, usage = F.col("message"), F.col("message.usage")
    r = r.withColumn("blocks", blocks_of(m["content"]))
    spelled = F.arrays_zip(F.col("blocks").alias("b"), F.col("raw.inputs").alias("input"), F.col("raw.contents").alias("content"))
    r = r.withColumn("spelled", F.when(F.col("blocks").isNotNull(), spelled))
    one = lambda **c: F.struct(*(c.get(k, F.lit(None).cast(t)).alias(k) for k, t in _VARIANT.items()))
    whole = content_hash(F.col("raw.content"), F.col("blocks"), salt)
    message = F.when(F.coalesce(whole, F.lit("")) != "", F.array(F.when(F.col("type") == "user", one(type=F.lit("user_prompt"), prompt_hash=whole)).otherwise(one(type=F.lit("assistant_message"), message_hash=whole)))).otherwise(F.array().cast(_VARIANTS))
    results = F.transform(F.filter("spelled", lambda x: x["b"]["type"] == "tool_result"), lambda x: one(type=F.lit("tool_result"), tool_call_id=x["b"]["tool_use_id"], result=sanitized_result(x["content"], x["b"]["is_error"], salt)))
    calls = F.transform(F.filter("spelled", lambda x: x["b"]["type"] == "tool_use"), lambda x: one(type=F.lit("tool_call"), tool_call_id=x["b"]["id"], name=x["b"]["name"], arguments=sanitized_input(x["input"], salt)))
    none = F.array().cast(_VARIANTS)
    fanned = (
        F.when(F.col("type") == "user", F.concat(message, F.coalesce(results, none)))
        .when(F.col("type") == "assistant", F.concat(message, F.coalesce(calls, none)))
        .when(F.col("type") == "started", F.array(one(type=F.lit("session_start"))))
        .when(F.col("type") == "result", F.array(one(type=F.lit("session_end"), reason=F.col("subtype"))))
        .otherwise(F.array(one(type=F.col("type"))))
    )
    known = F.col("record").isin("user", "assistant", "started", "result")
    rows = r.select("*", F.posexplode(fanned).alias("place", "e")).withColumnRenamed("type", "record")
    first = (F.col("record") == "assistant") & (F.col("place") == 0)
    envelope = lambda c: F.when(known, c)
    return _finished(rows.select(
        "path", "offset", F.col("offset").alias("emitted"), "place", "turn_index", "e.*", F.lit("claudecode").alias("harness"), envelope(F.col("gitBranch")).alias("git_branch"),
        envelope(F.coalesce(F.nullif(F.col("sessionId"), F.lit("")), base_name(F.col("path")))).alias("session_id"), envelope(F.col("cwd")).alias("cwd"),
        F.when(F.col("record") == "assistant", m["model"]).alias("model"), envelope(F.col("uuid")).alias("event_id"), envelope(text.timestamp(F.col("timestamp"))).alias("ts"),
        envelope(F.coalesce("isSidechain", F.lit(False))).alias("is_subagent"), *(F.when(first, usage[k]).alias(k) for k in METRICS),
    ))


#: What dialect B's records carry forward, and the columns of steps_b() that set it.
CARRIED = {"session_id": "new_session", "cwd": "new_cwd", "git_branch": "new_branch", "model": "new_model", "turn_id": "new_turn"}
TOKENS = ["input_tokens", "output_tokens", "cache_read_input_tokens"]
#: Places of dialect B's events at the record by which they leave.
LET_GO, OWN, AT_END = 0, 1, 2


def steps_b(lines: DataFrame, salt: bytes) -> DataFrame:
    """What each of dialect B's records says by itself, hashed: its event if any, what it sets and counts, and whether it lets go of a held message."""
    _require(salt)
    r = _records(lines, RECORD_B, {"content": "payload.content", "arguments": "payload.arguments", "output": "payload.output"})
    p, raw = F.col("payload"), F.col("raw")
    meta, context = F.col("type") == "session_meta", F.col("type") == "turn_context"
    item, kind = F.col("type") == "response_item", F.col("payload.type")
    items = F.from_json(p["content"], "array<struct<text:string,input_text:string,output_text:string>>")
    first_text = lambda b: F.coalesce(F.nullif(b["text"], F.lit("")), F.nullif(b["input_text"], F.lit("")), F.nullif(b["output_text"], F.lit("")))
    texts = F.filter(F.transform(items, first_text), lambda t: t.isNotNull())
    blocky = F.ltrim(p["content"]).startswith("[") & (F.size(items) > 0)
    hashed = F.coalesce(F.when(blocky, hashing.salted_list(texts, salt)).otherwise(hashing.salted_json(raw["content"], salt)), F.lit(""))
    message, call, result = item & (kind == "message"), item & kind.isin(CALLS_B), item & kind.isin(RESULTS_B)
    user, assistant = message & (p["role"] == "user"), message & (p["role"] == "assistant")
    event = F.when(meta, "session_start").when(user, F.when(hashed != "", "user_prompt")).when(assistant, F.when(hashed != "", "assistant_message"))
    event = event.when(message, F.concat(F.lit("response_item.message."), F.coalesce(p["role"], F.lit("")))).when(call, "tool_call").when(result, "tool_result")
    event = event.when(item, F.when(kind != "reasoning", F.concat(F.lit("response_item."), kind))).when(context, F.lit(None))
    silent = ["task_started", "task_complete", "token_count", "agent_message", "user_message"]
    event = event.when(F.col("type") == "event_msg", F.when(~kind.isin(silent), F.concat(F.lit("event_msg."), kind))).otherwise(F.col("type"))
    used, zero = F.col("payload.info.last_token_usage"), F.lit(0)
    amounts = dict(zip(TOKENS, (F.coalesce(used["input_tokens"], zero), F.coalesce(used["output_tokens"], zero) + F.coalesce(used["reasoning_output_tokens"], zero), F.coalesce(used["cached_input_tokens"], zero)), strict=True))
    counted = (F.col("type") == "event_msg") & (kind == "token_count")
    unwrapped = F.when(raw["arguments"].startswith('"') & (text.json_type(p["arguments"]) == "object"), p["arguments"]).otherwise(raw["arguments"])
    is_assistant = F.coalesce(assistant & (hashed != ""), F.lit(False))
    return r.select(
        "path", "offset", event.alias("event"), F.when(user | assistant, hashed).alias("hash"), is_assistant.alias("is_assistant"), F.coalesce(user | meta, F.lit(False)).alias("is_boundary"),
        F.when(meta, p["id"]).alias("new_session"), F.when(meta | context, p["cwd"]).alias("new_cwd"), F.when(meta, p["git"]["branch"]).alias("new_branch"), F.when(context, p["model"]).alias("new_model"), p["turn_id"].alias("new_turn"),
        *(F.when(counted, a).cast("long").alias(n) for n, a in amounts.items()), F.when(meta, F.coalesce(F.nullif(p["timestamp"], F.lit("")), F.col("timestamp"))).otherwise(F.col("timestamp")).alias("stamp"),
        F.when(call | result, p["call_id"]).alias("tool_call_id"), F.when(call, p["name"]).alias("name"), F.when(call, sanitized_input(unwrapped, salt)).alias("arguments"),
        F.when(result, sanitized_result(raw["output"], F.lit(None).cast("boolean"), salt)).alias("result"),
    )


def finished_b(rows: DataFrame) -> DataFrame:
    """Events of steps that have turn_index, the carried columns, their own tokens, emitted and place."""
    known = F.col("event").isin("session_start", "user_prompt", "assistant_message", "tool_call", "tool_result")
    envelope = lambda c: F.when(known, c)
    session = F.coalesce(F.nullif(F.col("session_id"), F.lit("")), rollout_session(F.col("path")))
    own = F.when(F.col("event") == "session_start", session).otherwise(F.nullif(F.col("tool_call_id"), F.lit("")))
    return _finished(rows.select(
        "path", "offset", "emitted", "place", "turn_index", F.col("event").alias("type"), F.lit("codex").alias("harness"), envelope(F.col("git_branch")).alias("git_branch"), envelope(session).alias("session_id"),
        envelope(F.col("cwd")).alias("cwd"), envelope(F.col("model")).alias("model"), envelope(F.coalesce(own, F.concat_ws(":", "stamp", "event", F.col("turn_index").cast("string")))).alias("event_id"),
        envelope(text.timestamp(F.col("stamp"))).alias("ts"), envelope(F.lit(False)).alias("is_subagent"), *TOKENS, F.when(F.col("event") == "user_prompt", F.col("hash")).alias("prompt_hash"),
        F.when(F.col("event") == "assistant_message", F.col("hash")).alias("message_hash"), "tool_call_id", "name", "arguments", "result",
    ))


def events_b(lines: DataFrame, salt: bytes) -> DataFrame:
    """Normalized events of dialect B's lines.

    Token counts are summed on the assistant message they belong to: the one held, which a later message of
    the assistant, a user message or a session's start lets go of, else the next.  turn_index counts records.
    """
    r = steps_b(lines, salt)
    whole = Window.partitionBy("path").orderBy("offset")
    lets_go = F.when(F.col("is_assistant") | F.col("is_boundary"), F.col("offset"))
    r = r.withColumns({
        "turn_index": (F.row_number().over(whole) - 1).cast("int"), "let_go": F.min(lets_go).over(whole.rowsBetween(1, Window.unboundedFollowing)), "last": F.max("offset").over(whole.rowsBetween(0, Window.unboundedFollowing)),
    })
    r = forward_fill(r.withColumnsRenamed({v: k for k, v in CARRIED.items()}), list(CARRIED), ["path"], ["offset"])
    held = held_tokens(r, F.col("is_assistant"), F.col("is_boundary"), {n: F.col(n) for n in TOKENS}, ["path"], ["offset"]).drop("seq")
    rows = r.drop(*TOKENS).where("event is not null").join(held, ["path", "offset"], "left")
    message = F.col("event") == "assistant_message"
    place = F.when(message, F.when(F.col("let_go").isNull(), AT_END).otherwise(LET_GO)).otherwise(OWN)
    return finished_b(rows.withColumns({"emitted": F.when(message, F.coalesce("let_go", "last")).otherwise(F.col("offset")), "place": place}))


_VARIANT = {
    "type": "string", "prompt_hash": "string", "message_hash": "string", "tool_call_id": "string", "name": "string",
    "arguments": "struct<hash:string,keys:array<string>,json_type:string>", "result": "struct<hash:string,json_type:string,is_error:boolean>", "reason": "string",
}
_VARIANTS = "array<struct<" + ",".join(f"{k}:{t}" for k, t in _VARIANT.items()) + ">>"


def _require(salt: bytes) -> None:
    if len(salt or b"") < hashing.LEAST_SALT_BYTES:
        raise ValueError(f"a salt of {hashing.LEAST_SALT_BYTES} bytes or more is needed: without one no event may leave")


def by_dialect(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lines of dialect A's files and of dialect B's."""
    told = lines.join(dialect_of(lines), "path")
    return tuple(told.where(F.col("dialect") == d).drop("dialect") for d in ("a", "b"))


def events(lines: DataFrame, salt: bytes) -> DataFrame:
    """Normalized events of files of either dialect, told apart by their first lines."""
    a, b = by_dialect(lines)
    return events_a(a, salt).unionByName(events_b(b, salt))


def facts(lines: DataFrame) -> DataFrame:
    """What happened in sessions of either dialect."""
    a, b = by_dialect(lines)
    return facts_a(a).unionByName(facts_b(b))


def judge_turns(lines: DataFrame) -> DataFrame:
    """(path, offset, role, text): the turns a judge may see, of either dialect.

    Records that hold tool results and injected skills are left out, and so are texts without letters.
    """
    rows = facts(lines).where("kind in ('user', 'assistant')")
    text_ = F.coalesce("body", F.lit(""))
    return rows.where((text.strip(text_) != "") & skill_name(text_).isNull()).select("path", "offset", F.col("kind").alias("role"), text_.alias("text"))


FACT = ["path", "offset", "place", "kind", "id", "name", "body", "is_error"]


def facts_a(lines: DataFrame) -> DataFrame:
    """What happened in dialect A's sessions, in order.

    kind is user, assistant, call, result, pr_link, end or message; body is a text, a call's input or
    an end's subtype.  A record's own row comes before those of its blocks.
    """
    r = records_a(lines, inputs="message.content[].input").withColumn("blocks", blocks_of(F.col("message.content")))
    has_results = F.coalesce(F.exists("blocks", lambda b: b["type"] == "tool_result"), F.lit(False))
    kind = (
        F.when(F.col("type") == "pr-link", "pr_link").when(F.col("type") == "result", "end").when((F.col("type") == "user") & ~has_results, "user")
        .when(F.col("type") == "assistant", "assistant").when(F.col("message").isNotNull(), "message")
    )
    body = F.when(F.col("type") == "result", F.col("subtype")).otherwise(text.content_text(F.col("message.content")))
    own = r.select("path", "offset", F.lit(-1).alias("place"), kind.alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), body.alias("body"), F.lit(None).cast("boolean").alias("is_error"))
    parts = r.where("type in ('user', 'assistant') or message is not null").select("path", "offset", F.posexplode("blocks").alias("place", "b"), F.try_element_at("raw.inputs", F.col("place") + 1).alias("input")).where("b.type in ('tool_use', 'tool_result')")
    call = F.col("b.type") == "tool_use"
    inner = parts.select(
        "path", "offset", "place", F.when(call, "call").otherwise("result").alias("kind"), F.when(call, F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("id"), F.col("b.name").alias("name"),
        F.when(call, reencoded(F.col("b.input"), F.col("input"))).otherwise(text.content_text(F.col("b.content"))).alias("body"), F.when(~call, F.coalesce("b.is_error", F.lit(False))).alias("is_error"),
    )
    return own.where("kind is not null").unionByName(inner).select(FACT)


def facts_b(lines: DataFrame) -> DataFrame:
    """What happened in dialect B's sessions; a result's error flag is what its text says."""
    p = F.col("payload")
    r = _records(lines, RECORD_B, {"arguments": "payload.arguments"}).where("type = 'response_item'")
    kind = (
        F.when(p["type"] == "message", F.when(p["role"].isin("user", "assistant"), p["role"]).otherwise("message"))
        .when(p["type"].isin(CALLS_B), "call").when(p["type"].isin(RESULTS_B), "result")
    )
    body = F.when(p["type"] == "message", text.content_text(p["content"])).when(p["type"].isin(CALLS_B), reencoded(p["arguments"], F.col("raw.arguments"))).otherwise(p["output"])
    rows = r.select("path", "offset", F.lit(0).alias("place"), kind.alias("kind"), p["call_id"].alias("id"), p["name"].alias("name"), body.alias("body")).where("kind is not null")
    return rows.withColumn("is_error", F.when(F.col("kind") == "result", F.coalesce(output_failed(F.col("body")), F.lit(False)))).select(FACT)
