"""Queries over working sessions of both dialects: edits, tests, commits and their results, and events in order of emission.

Conversations give the sessions' shape: a user's turn is a prompt, an assistant's turn a call and mostly its
result.  The files' lines are put together from the same parts in Spark and in SQL; what they mean is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators import signals
from tracewell.sources import dialects

from .file_queries import SALT, conv_of, scanned_files
from .registry import query, table

#: Lines as texts with the names of columns between braces of their own: «n».
USER_A = '{"type":"user","message":{"role":"user","content":«js»}}'
USER_B = '{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":«js»}]}}'
CALL_A = '{"type":"assistant","message":{"role":"assistant","content":[{"type":"tool_use","id":"c«n»","name":"«tool»","input":«input»}]}}'
CALL_B = '{"type":"response_item","payload":{"type":"function_call","name":"«tool»","call_id":"c«n»","arguments":«input»}}'
RESULT_A = '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"c«n»","is_error":«bad»,"content":"«said»"}]}}'
RESULT_B = '{"type":"response_item","payload":{"type":"function_call_output","call_id":"c«n»","output":"«said»"}}'
END_A = '{"type":"result","subtype":"«reason»"}'
META = '{"timestamp":"2026-01-01T00:00:00Z","type":"session_meta","payload":{"id":"s«conv_id»","cwd":"/w«conv_id»","git":{"branch":"main"}}}'
CONTEXT = '{"timestamp":"2026-01-01T00:00:01Z","type":"turn_context","payload":{"turn_id":"t«n»","model":"m«n»"}}'
ANSWER = '{"timestamp":"2026-01-01T00:00:02Z","type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":«js»}]}}'
COUNT = '{"type":"event_msg","payload":{"type":"token_count","info":{"last_token_usage":{"input_tokens":«n»,"cached_input_tokens":1,"output_tokens":2,"reasoning_output_tokens":3}}}}'
#: An assistant's calls by (conv_id + n) % 5, and results by (3 * conv_id + n) % 4.
TOOLS = ["Bash", "Edit", "Bash", "Edit", "Bash"]
INPUTS = ['{"command":"go test ./..."}', '{"file_path":"src/f«n3».py"}', '{"command":"git commit -m x"}', '{"x":[{"path":"tests/t«n2»_test.py"}]}', '{"command":"ls"}']
SAID = ["ok", "exit code 1", "1 failed", "@@ -1 +1 @@\\nok"]


def spark_text(template: str) -> Column:
    parts = template.replace("»", "«").split("«")
    return F.concat(*(F.col(p).cast("string") if k % 2 else F.lit(p) for k, p in enumerate(parts) if p))


def sql_text(template: str) -> str:
    parts = template.replace("»", "«").split("«")
    return "concat(" + ", ".join(p if k % 2 else "'" + p.replace("'", "''") + "'" for k, p in enumerate(parts) if p) + ")"


def picked(options: list[Column], by: Column) -> Column:
    return F.element_at(F.array(*options), (by + 1).cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, n, role, text, js): turns by their number from 0, with their text as JSON."""
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return rows.select("conv_id", "n", "role", "text", F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1).alias("js"))


TURNS_SQL = "t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, role, coalesce(text, '') AS text, to_json(coalesce(text, ''))::VARCHAR AS js FROM conversations)"


def working_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of working sessions: of dialect A where conv_id is even, with an end for two of three, else of dialect B."""
    k = F.col("conv_id") + F.col("n")
    rows = turns(spark, sf_dir).withColumns({"n3": F.col("n") % 3, "n2": F.col("n") % 2, "bad": F.when(F.col("n") % 11 == 10, "true").otherwise("false")})
    rows = rows.withColumns({"tool": picked([F.lit(x) for x in TOOLS], k % 5), "input": picked([spark_text(x) for x in INPUTS], k % 5), "said": picked([F.lit(x) for x in SAID], (3 * F.col("conv_id") + F.col("n")) % 4)})
    a = F.col("conv_id") % 2 == 0
    either = lambda x, y: F.when(a, spark_text(x)).otherwise(spark_text(y))
    lines = F.when(F.col("role") == "user", F.array(either(USER_A, USER_B))).when(F.col("role") == "assistant", F.when(k % 7 == 6, F.array(either(CALL_A, CALL_B))).otherwise(F.array(either(CALL_A, CALL_B), either(RESULT_A, RESULT_B))))
    body = rows.select(F.col("conv_id").alias("conv"), "n", F.posexplode(lines).alias("k", "value")).select("conv", (2 * F.col("n") + F.col("k")).alias("at"), "value")
    ends = rows.where(a & (F.col("conv_id") % 3 < 2)).groupBy("conv_id").agg((2 * F.max("n") + 2).alias("at")).withColumn("reason", F.when(F.col("conv_id") % 3 == 0, "success").otherwise("error"))
    return scanned_files(body.union(ends.select("conv_id", "at", spark_text(END_A))))


def _pick_sql(options: list[str], by: str) -> str:
    return f"[{', '.join(options)}][({by})::INTEGER + 1]"


_SAID_SQL = _pick_sql(["'" + x + "'" for x in SAID], "(3 * conv_id + n) % 4")
WORKING_SQL = f"""{TURNS_SQL},
c AS (SELECT *, conv_id % 2 = 0 AS a, (conv_id + n) % 5 AS tool_no, (3 * conv_id + n) % 4 AS said_no, (conv_id + n) % 7 <> 6 AS answered, CASE WHEN n % 11 = 10 THEN 'true' ELSE 'false' END AS bad,
             {_pick_sql(["'" + x + "'" for x in TOOLS], "(conv_id + n) % 5")} AS tool, {_pick_sql([sql_text(x.replace("«n3»", "«n % 3»").replace("«n2»", "«n % 2»")) for x in INPUTS], "(conv_id + n) % 5")} AS input, {_SAID_SQL} AS said FROM t),
r AS (SELECT conv_id, n, 2 * n AS spot, CASE role WHEN 'user' THEN 'user' ELSE 'call' END AS kind, CASE WHEN role = 'user' THEN CASE WHEN a THEN {sql_text(USER_A)} ELSE {sql_text(USER_B)} END ELSE CASE WHEN a THEN {sql_text(CALL_A)} ELSE {sql_text(CALL_B)} END END AS line FROM c WHERE role IN ('user', 'assistant')
      UNION ALL SELECT conv_id, n, 2 * n + 1, 'result', CASE WHEN a THEN {sql_text(RESULT_A)} ELSE {sql_text(RESULT_B)} END FROM c WHERE role = 'assistant' AND answered
      UNION ALL SELECT conv_id, NULL, 2 * max(n) + 2, 'end', {sql_text(END_A.replace("«reason»", "«CASE conv_id % 3 WHEN 0 THEN 'success' ELSE 'error' END»"))} FROM c WHERE a AND conv_id % 3 < 2 GROUP BY conv_id),
p AS (SELECT conv_id, n, spot, kind, (sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY spot) - strlen(line) - 1)::BIGINT AS pos FROM r)"""


@query(f"""WITH {WORKING_SQL},
q AS (SELECT c.conv_id, c.n, c.a, tool_no = 0 AS verify, tool_no = 2 AS land, tool_no IN (1, 3) AS edit, answered, answered AND (said_no IN (1, 2) OR (a AND bad = 'true')) AS failed, said_no = 3 AS hunk, k.pos AS called, z.pos AS told,
             CASE tool_no WHEN 1 THEN concat('src/f', c.n % 3, '.py') WHEN 3 THEN concat('tests/t', c.n % 2, '_test.py') END AS file, coalesce(bool_or(tool_no IN (1, 3)) OVER (PARTITION BY c.conv_id ORDER BY c.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS edited,
             answered AND CASE WHEN a THEN bad = 'true' ELSE said_no IN (1, 2) END AS flagged
      FROM c JOIN p k ON k.conv_id = c.conv_id AND k.n = c.n AND k.kind = 'call' LEFT JOIN p z ON z.conv_id = c.conv_id AND z.n = c.n AND z.kind = 'result'),
v AS (SELECT conv_id, arg_max(CASE WHEN NOT answered THEN '' WHEN failed THEN 'failed' ELSE 'passed' END, n) FILTER (verify) AS verification, arg_max(told, n) FILTER (verify) AS verification_at, count(*) FILTER (land) AS lands,
             min(told) FILTER (land AND answered AND NOT failed) AS landed_at, min(told) FILTER (land AND answered) AS tried_at, bool_or(land AND NOT answered) AS land_open, min(told) FILTER (verify AND edited AND answered AND NOT failed) AS verified_after_edit_at,
             arg_max(flagged, n) FILTER (answered) AS last_flag, max(told) AS last_result, count(*) FILTER (edit) AS edit_count, count(*) FILTER (edit AND hunk AND answered) AS diff_hunks FROM q GROUP BY conv_id),
f AS (SELECT conv_id, file, count(*) AS k, list(called ORDER BY called)[2] AS again FROM q WHERE edit GROUP BY conv_id, file),
g AS (SELECT conv_id, count(*) AS files_touched, count(*) FILTER (file LIKE '%test%') AS test_files, sum(k - 1)::BIGINT AS rework, min(again) AS rework_at FROM f GROUP BY conv_id),
l AS (SELECT conv_id, arg_max(kind, spot) AS last_kind, max(pos) FILTER (kind = 'end') AS end_at FROM p GROUP BY conv_id),
h AS (SELECT conv_id, count(*) FILTER (role = 'user' AND trim(text) <> '') AS human_turns FROM t GROUP BY conv_id),
o AS (SELECT l.conv_id, coalesce(verification, '') AS verification, CASE WHEN coalesce(verification, '') <> '' THEN verification_at END AS verification_at,
             CASE WHEN coalesce(lands, 0) = 0 THEN 'none' WHEN landed_at IS NOT NULL THEN 'succeeded' WHEN land_open THEN 'attempted_unknown' ELSE 'failed' END AS landing_quality, coalesce(landed_at, tried_at) AS landing_at,
             CASE WHEN end_at IS NOT NULL THEN CASE l.conv_id % 3 WHEN 0 THEN 'clean' ELSE 'abandoned' END WHEN last_kind = 'call' OR last_flag THEN 'abandoned' WHEN last_result IS NULL THEN 'unknown' ELSE 'clean' END AS termination, coalesce(end_at, last_result) AS termination_at,
             human_turns, coalesce(rework, 0) AS rework, rework_at, verified_after_edit_at IS NOT NULL AS verified_after_edit, verified_after_edit_at, coalesce(files_touched, 0) AS files_touched, coalesce(test_files, 0) AS test_files, coalesce(edit_count, 0) AS edit_count, coalesce(diff_hunks, 0) AS diff_hunks
      FROM l LEFT JOIN v ON v.conv_id = l.conv_id LEFT JOIN g ON g.conv_id = l.conv_id JOIN h ON h.conv_id = l.conv_id),
e AS (SELECT conv_id, called AS spot, CASE WHEN verify THEN concat('verification=ran@', called) WHEN land THEN concat('landing_quality=attempted@', called) ELSE concat('scope=edit@', called) END AS s FROM q WHERE verify OR land OR edit
      UNION ALL SELECT conv_id, 1e15::BIGINT + x.i, x.s FROM (SELECT conv_id, unnest([{{'i': 0, 's': CASE WHEN verification <> '' THEN concat('verification=', verification, '@', verification_at) END}}, {{'i': 1, 's': CASE WHEN landing_quality <> 'none' THEN concat('landing_quality=', landing_quality, '@', coalesce(landing_at, 0)) END}},
        {{'i': 2, 's': CASE WHEN termination <> 'unknown' THEN concat('termination=', termination, '@', coalesce(termination_at, 0)) END}}, {{'i': 3, 's': CASE WHEN rework > 0 THEN concat('rework=true@', rework_at) END}}, {{'i': 4, 's': CASE WHEN verified_after_edit THEN concat('verified_after_edit=true@', verified_after_edit_at) END}}]) AS x FROM o) y WHERE x.s IS NOT NULL),
w AS (SELECT conv_id, string_agg(s, ',' ORDER BY spot) AS told FROM e GROUP BY conv_id)
SELECT o.*, coalesce(told, '') AS told FROM o LEFT JOIN w ON w.conv_id = o.conv_id""")
def working_session_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of working sessions and the places that tell them, with what was observed in order (but for reactions)."""
    facts = dialects.facts(working_sessions(spark, sf_dir))
    rows = signals.finalized(signals.outcome_signals(facts), signals.evidence(facts))
    kept = F.filter("evidence", lambda e: ~e["signal"].isin("human_correction", "human_acceptance"))
    told = F.array_join(F.transform(kept, lambda e: F.concat(e["signal"], F.lit("="), e["value"], F.lit("@"), e["offset"].cast("string"))), ",")
    return rows.select(
        conv_of(F.col("path")).alias("conv_id"), "verification", "verification_at", "landing_quality", "landing_at", "termination", "termination_at", "human_turns", "rework", "rework_at", "verified_after_edit", "verified_after_edit_at",
        "files_touched", "test_files", "edit_count", "diff_hunks", told.alias("told"),
    )


@query(f"""WITH {TURNS_SQL},
r AS (SELECT conv_id, -1 AS n, 0 AS k, 'meta' AS kind, 'x' AS text FROM t GROUP BY conv_id UNION ALL SELECT conv_id, n, 0, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'answer' ELSE 'context' END, text FROM t
      UNION ALL SELECT conv_id, n, 1, 'count', '' FROM t WHERE role = 'assistant' OR (role = 'user' AND n % 3 = 0) UNION ALL SELECT conv_id, n, 2, 'call', 'x' FROM t WHERE role = 'assistant'),
s AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY n, k) - 1)::INTEGER AS seq, kind = 'answer' AND text <> '' AS holds, kind IN ('user', 'meta') AS edge FROM r),
w AS (SELECT *, max(CASE WHEN holds THEN seq END) OVER b AS held, max(CASE WHEN edge THEN seq END) OVER b AS edged, min(CASE WHEN holds THEN seq END) OVER f AS later, min(CASE WHEN holds OR edge THEN seq END) OVER f AS freed, max(seq) OVER (PARTITION BY conv_id) AS last_seq,
             max(CASE WHEN kind = 'context' THEN n END) OVER (PARTITION BY conv_id ORDER BY seq) AS model
      FROM s WINDOW b AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
c AS (SELECT conv_id, CASE WHEN held > edged THEN held ELSE later END AS seq, sum(n)::BIGINT AS input_tokens, 5 * count(*) AS output_tokens, count(*) AS cached FROM w WHERE kind = 'count' GROUP BY ALL)
SELECT w.conv_id, row_number() OVER (PARTITION BY w.conv_id ORDER BY CASE WHEN holds THEN coalesce(freed, last_seq) ELSE w.seq END, CASE WHEN NOT holds THEN 1 WHEN freed IS NULL THEN 2 ELSE 0 END)::INTEGER AS place,
       CASE kind WHEN 'meta' THEN 'session_start' WHEN 'user' THEN 'user_prompt' WHEN 'answer' THEN 'assistant_message' ELSE 'tool_call' END AS type, w.seq AS turn_index, concat('s', w.conv_id) AS session_id, concat('/w', w.conv_id) AS cwd, 'm' || model AS model,
       CASE WHEN holds THEN coalesce(input_tokens, 0) ELSE 0 END AS input_tokens, CASE WHEN holds THEN coalesce(output_tokens, 0) ELSE 0 END AS output_tokens, CASE WHEN holds THEN coalesce(cached, 0) ELSE 0 END AS cache_read_input_tokens
FROM w LEFT JOIN c ON c.conv_id = w.conv_id AND c.seq = w.seq WHERE kind IN ('meta', 'call') OR (kind IN ('user', 'answer') AND text <> '')""")
def rollout_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of dialect B's files in order of emission, with what their records carry forward and the tokens of held messages."""
    rows = turns(spark, sf_dir)
    rows = rows.withColumns({"tool": F.lit("exec_command"), "input": F.lit('{"cmd":"ls"}')})
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    lines = F.when(user, F.when(F.col("n") % 3 == 0, F.array(spark_text(USER_B), spark_text(COUNT))).otherwise(F.array(spark_text(USER_B)))).when(assistant, F.array(spark_text(ANSWER), spark_text(COUNT), spark_text(CALL_B))).otherwise(F.array(spark_text(CONTEXT)))
    body = rows.select(F.col("conv_id").alias("conv"), "n", F.posexplode(lines).alias("k", "value")).select("conv", (3 * F.col("n") + F.col("k")).alias("at"), "value")
    metas = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).alias("at"), spark_text(META))
    events = dialects.events_b(scanned_files(body.union(metas)), SALT)
    order = Window.partitionBy("path").orderBy("emitted", "place")
    return events.select(conv_of(F.col("path")).alias("conv_id"), F.row_number().over(order).alias("place"), "type", "turn_index", "session_id", "cwd", "model", "input_tokens", "output_tokens", "cache_read_input_tokens")
