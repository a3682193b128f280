"""Queries over events, orders and conversations: leaderboards, sessions, state, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import scoring, text
from tracewell.operators import carry, conversation, jobs, latest

from .registry import micros, query, table

R1 = "sign({0}) * floor(abs({0}) * 10 + 0.5) / 10"
LATEST_EVENTS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) q WHERE rn = 1)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", micros("ts"))


@query(f"""
SELECT event_type, count(*) AS submissions, max(value) AS best_score, arg_max(value, event_id + epoch_us(ts) * 100000000::HUGEINT) AS latest_score,
       max(epoch_us(ts)) AS latest_at, {R1.format("avg(value)")} AS average_score
FROM {LATEST_EVENTS} l GROUP BY event_type""")
def model_stats_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-group statistics of each user's latest event (latest per task, then per model)."""
    last = latest.latest_per(events(spark, sf_dir).select("user_id", "us", "event_id", "event_type", "value"), ["user_id"], ["us", "event_id"])
    return latest.model_stats(last, ["event_type"], "value", "us", "event_id")


@query(f"SELECT user_id, event_id, event_type, value, epoch_us(ts) AS us FROM {LATEST_EVENTS} l WHERE event_type <> 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_feed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest of each user's latest event, failed ones left out."""
    last = latest.latest_per(events(spark, sf_dir).select("user_id", "event_id", "event_type", "value", "us"), ["user_id"], ["us", "event_id"])
    return latest.feed(last.where("event_type <> 'error'"), [F.desc("us"), F.desc("event_id")])


@query("""
SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 250""")
def feed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest joined rows under two equality filters, which reach the scans."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    newest = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    return latest.feed(rows, newest, 250, o_orderstatus="F", c_mktsegment="BUILDING").select("o_orderkey", "c_custkey", "c_mktsegment", "o_totalprice")


@query("""
SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (role = 'assistant') AS answers,
       sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS input_chars, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS output_chars,
       arg_max(role, turn * 1000 + length(role)) AS last_role, max(turn) - min(turn) AS span
FROM conversations GROUP BY conv_id""")
def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session fold: counts and sums by kind, the last kind, and the span."""
    chars = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0)).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("turns"), F.count_if(F.col("role") == "assistant").alias("answers"), chars("user").alias("input_chars"), chars("assistant").alias("output_chars"),
        F.max_by("role", F.struct("turn", F.length("role"))).alias("last_role"), (F.max("turn") - F.min("turn")).alias("span"),
    )


@query("SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1)::INTEGER AS ordinal, length(text) AS chars FROM conversations")
def kind_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns numbered from 0 within their kind."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))
    return carry.ordinals(rows, "ordinal", ["conv_id", "role"], ["turn"])


@query("""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS turn_index,
                  CASE role WHEN 'user' THEN 'developer' WHEN 'assistant' THEN 'assistant' ELSE 'tool_output' END AS kind FROM conversations),
     p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index, CASE kind WHEN 'developer' THEN 0 WHEN 'assistant' THEN 1 ELSE 3 END, turn)::INTEGER AS place
           FROM t WHERE trim(text, E' \\t\\n\\r') <> '')
SELECT conv_id, place, kind, turn, CASE WHEN length(text) > (CASE kind WHEN 'tool_output' THEN 6000 ELSE 16000 END)
       THEN (CASE kind WHEN 'tool_output' THEN 6000 ELSE 16000 END) + 14 ELSE length(text) END::BIGINT AS chars
FROM p WHERE place <= 600""")
def conversation_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in one stream, ordered by ordinal, kind and sequence, with their limits."""
    kind = F.when(F.col("role") == "user", "developer").when(F.col("role") == "assistant", "assistant").otherwise("tool_output")
    rows = carry.ordinals(table(spark, sf_dir, "conversations"), "turn_index", ["conv_id", "role"], ["turn"]).withColumn("kind", kind)
    return conversation.interleaved(rows, ["conv_id"], seq="turn").select("conv_id", "place", "kind", "turn", F.length("text").cast("long").alias("chars"))


@query("""
WITH p AS (SELECT conv_id, list(trim(text, E' \\t\\n\\r') ORDER BY turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
     f AS (SELECT conv_id, len(t) AS n, coalesce(list_filter(t, lambda x: x <> '' AND NOT (lower(x) LIKE '<%' OR lower(x) LIKE '# agents.md%' OR lower(x) LIKE 'agents.md%' OR lower(x) LIKE '%you are claude%'))[1], t[1], '') AS s FROM p),
     l AS (SELECT *, trim(ltrim(split_part(s, E'\\n', 1), '#> -*')) AS line FROM f)
SELECT conv_id, CASE WHEN s = '' THEN 'Untitled session' WHEN length(line) > 90 THEN trim(line[1:90]) || '…' ELSE line END AS title,
       CASE WHEN length(s) > 1600 THEN trim(s[1:1600]) || '…' ELSE s END AS statement, greatest(n - 1, 0)::INTEGER AS follow_ups FROM l""")
def title_statement_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, statement and follow-ups of each conversation's developer prompts."""
    return conversation.headlines(table(spark, sf_dir, "conversations").where("role = 'user'"), ["conv_id"], "turn", "text")


REACTION_SQL = r"""
WITH m AS (SELECT *, coalesce(bool_or(role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS spoken FROM conversations)
SELECT conv_id, turn, CASE WHEN NOT spoken THEN NULL WHEN regexp_matches(text, '(?i)\b(wrong|try again|fix|failed|failing|error|broken|revert|undo|not what|doesn''?t|didn''?t|actually)\b') THEN 'correction' WHEN regexp_matches(text, '(?i)\b(lgtm|looks good|works|thank|thanks|great|perfect|ship it|nice|done)\b') THEN 'acceptance' END AS reaction
FROM m WHERE role = 'user'"""


@query(REACTION_SQL)
def reaction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user message after the first answer says about it."""
    return conversation.reactions(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role"], "role", "text").select("conv_id", "turn", "reaction")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
     h AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_held,
                  coalesce(max(CASE WHEN event_type = 'error' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS edge,
                  min(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_held FROM e),
     c AS (SELECT user_id, CASE WHEN last_held > edge THEN last_held ELSE next_held END AS target, sum(floor(value)::BIGINT)::BIGINT AS tokens FROM h WHERE event_type = 'view' GROUP BY 1, 2)
SELECT h.user_id, h.event_id, h.us, h.seq::INTEGER AS seq, coalesce(c.tokens, 0)::BIGINT AS tokens FROM h LEFT JOIN c ON c.user_id = h.user_id AND c.target = h.seq WHERE h.event_type = 'signup'""")
def held_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views' values summed on the signup that holds them, errors letting go."""
    kind = F.col("event_type")
    return carry.held_tokens(events(spark, sf_dir), kind == "signup", kind == "error", F.when(kind == "view", F.floor("value")), ["user_id"], ["us", "event_id"])


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events""")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last purchase carried forward."""
    rows = events(spark, sf_dir).withColumn("carried", F.when(F.col("event_type") == "purchase", F.col("value")))
    return carry.forward_fill(rows, ["carried"], ["user_id"], ["us", "event_id"]).select("event_id", "user_id", "carried")


@query("""
WITH e AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
     l AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN seq END) AS c, max(CASE WHEN event_type = 'view' THEN seq END) AS v FROM e GROUP BY user_id)
SELECT e.user_id, e.us, e.event_id FROM e JOIN l ON e.user_id = l.user_id AND e.seq = l.c WHERE l.v IS NULL OR l.v < l.c""")
def pending_last_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last clicks that no view follows."""
    kind = F.col("event_type")
    return carry.pending_at_end(events(spark, sf_dir), kind == "click", kind == "view", ["user_id"], ["us", "event_id"])


@query("""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2),
     s AS (SELECT l_orderkey, l_linenumber, l_shipdate, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT s.l_orderkey, s.l_linenumber, d.o_orderkey AS last_order FROM s ASOF LEFT JOIN d ON s.o_custkey = d.o_custkey AND s.l_shipdate >= d.o_orderdate""")
def asof_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shipped line's customer's last order by then (the last commit at a session's start)."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", micros("o_orderdate").alias("stamp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", micros("l_shipdate").alias("at"))
    lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    found = carry.as_of(lines, orders.withColumnRenamed("o_orderkey", "last_order"), ["o_custkey"], "at", "stamp", "last_order")
    return found.select("l_orderkey", "l_linenumber", "last_order")


NOW_SQL = "(SELECT max(epoch_us(ts)) FROM events)"


def with_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events beside the table's last time, which stands for the present."""
    now = events(spark, sf_dir).agg(F.max("us").alias("now"))
    one = F.broadcast(now.withColumn("one", F.lit(1)))
    return events(spark, sf_dir).withColumn("one", F.lit(1)).join(one, "one").drop("one")


@query(f"SELECT user_id, count(*) AS released, max(epoch_us(ts)) AS newest FROM events WHERE {NOW_SQL} - epoch_us(ts) >= 86400000000 GROUP BY user_id")
def maturity_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records at least a day old, per user."""
    rows = with_now(spark, sf_dir)
    return rows.where(jobs.matured(F.col("us"), F.col("now"))).groupBy("user_id").agg(F.count("*").alias("released"), F.max("us").alias("newest"))


@query(f"""
WITH j AS (SELECT event_id, epoch_us(ts) AS locked, (event_id % 4)::INTEGER AS attempts, event_type FROM events)
SELECT event_id, locked <= {NOW_SQL} - 300000000 AS stale, CASE WHEN event_type = 'error' OR attempts >= 3 THEN 'fail' ELSE 'retry' END AS event,
       CASE WHEN event_type = 'error' OR attempts >= 3 THEN 'failed' ELSE 'queued' END AS status, {NOW_SQL} + attempts * 30000000 AS run_after FROM j""")
def visibility_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which locked jobs are stale, and what a failure makes of each."""
    rows = with_now(spark, sf_dir).withColumn("attempts", (F.col("event_id") % 4).cast("int"))
    event = jobs.failure_event(F.col("attempts"), F.col("event_type") == "error")
    return rows.select("event_id", jobs.is_stale(F.col("us"), F.col("now")).alias("stale"), event.alias("event"), jobs.next_status(F.lit("judging"), event).alias("status"), jobs.run_after(F.col("now"), F.col("attempts")).alias("run_after"))


@query(f"""SELECT event_id, epoch_us(ts) AS run_after FROM events WHERE event_type = 'signup' AND epoch_us(ts) <= {NOW_SQL} ORDER BY ts, event_id LIMIT 10""")
def due_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs that are due first."""
    rows = with_now(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "queued").otherwise("judging").alias("status"), F.col("us").alias("run_after"), "now")
    return jobs.due_jobs(rows, F.col("now"), 10).select(F.col("id").alias("event_id"), "run_after")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
     w AS (SELECT user_id, event_id, seq, us AS start, 1 AS n, true AS allowed FROM e WHERE seq = 1
           UNION ALL
           SELECT e.user_id, e.event_id, e.seq, CASE WHEN e.us - w.start >= 604800000000 THEN e.us ELSE w.start END,
                  CASE WHEN e.us - w.start >= 604800000000 THEN 1 ELSE least(w.n + 1, 2) END, e.us - w.start >= 604800000000 OR w.n < 2
           FROM w JOIN e ON e.user_id = w.user_id AND e.seq = w.seq + 1)
SELECT event_id, user_id, allowed FROM w""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two events a user in a window of a week that the user's first event opens."""
    return jobs.limited_requests(events(spark, sf_dir), "user_id", "us", "event_id", 2, 604_800).select("event_id", "user_id", "allowed")


@query("""
SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys, lower(json_type(props, '$.k')) IN ('ubigint', 'bigint') AS is_number, (props->>'$.k')::BIGINT AS k FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys, the type of a value and the value of JSON objects."""
    inner = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(text.json_keys(F.col("props")), ",").alias("keys"), (text.json_type(inner) == "number").alias("is_number"), inner.cast("long").alias("k")
    )


@query(r"""
WITH c AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS i, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS o,
                  ['opus-1', 'a-sonnet', 'haiku', 'GPT-x', 'other'][(conv_id % 5 + 1)::INTEGER] AS model FROM conversations GROUP BY conv_id),
     r AS (SELECT *, CASE conv_id % 5 WHEN 0 THEN [15.0, 75.0, 1.5] WHEN 1 THEN [3.0, 15.0, 0.3] WHEN 2 THEN [0.8, 4.0, 0.08] WHEN 3 THEN [2.5, 10.0, 0.25] ELSE [3.0, 15.0, 0.3] END::DOUBLE[] AS p FROM c)
SELECT conv_id, model, conv_id % 5 = 4 AS estimated, floor(((i * 100 * p[1] + o * 100 * p[2] + (i + o) * p[3]) / 1e6) * 100 + 0.5) / 100 AS cost_usd FROM r""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session costs by model name and token sums."""
    chars = lambda role: F.sum(F.when(F.col("role") == role, F.length("text")).otherwise(0)).cast("long")
    names = F.array(*map(F.lit, ["opus-1", "a-sonnet", "haiku", "GPT-x", "other"]))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(chars("user").alias("i"), chars("assistant").alias("o"))
    rows = rows.withColumn("model", F.element_at(names, (F.col("conv_id") % 5 + 1).cast("int")))
    cost = scoring.cost_usd(F.col("model"), F.col("i") * 100, F.col("o") * 100, F.col("i") + F.col("o"))
    return rows.select("conv_id", "model", (~scoring.model_known(F.col("model"))).alias("estimated"), cost.alias("cost_usd"))
