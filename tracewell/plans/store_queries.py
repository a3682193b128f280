"""Queries over stores and names: submissions in micro-batches, claims, published rows, payload keys, paths, categories, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import classify, consent, hashing, rawjson, verdict
from tracewell.operators import capture, jobs, survival
from tracewell.sources import lines, sinks
from tracewell.sources.scratch import scratch_path
from tracewell.streaming.store import ClaimLog, SubmissionStore

from .registry import micros, query, table


def text(*parts: Column | str) -> Column:
    return F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))


@query("""
WITH o AS (SELECT *, o_orderkey % 3 AS batch, o_orderpriority || '-' || o_custkey % 300 AS payload, 't' || o_custkey % 500 AS task FROM orders WHERE o_orderstatus <> 'P'),
     s AS (SELECT *, row_number() OVER (PARTITION BY payload ORDER BY batch, o_orderdate, task) AS k FROM o), t AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY batch, o_orderdate, payload) AS k FROM o)
SELECT 'submission' AS kind, sha256(payload) AS key, task AS value, batch FROM s WHERE k = 1 UNION ALL SELECT 'task', task, payload, batch FROM t WHERE k = 1""")
def stored_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three micro-batches of submissions leave in the store, the second of which runs twice."""
    payload = text(F.col("o_orderpriority"), "-", F.col("o_custkey") % 300)
    rows = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "P", text("t", F.col("o_custkey") % 500)).alias("task_id"), payload.alias("payload"), F.lit("c").alias("contributor"), F.col("o_orderdate").cast("timestamp").alias("received_at"),
        F.lit(None).cast("string").alias("_corrupt_record"), F.sha2(payload, 256).alias("payload_sha256"), (F.col("o_orderkey") % 3).alias("n"),
    )
    root = scratch_path(spark, "submissions")
    store = SubmissionStore(root, buckets=16)
    accept = store.accept(f"{root}-bad")
    for n in (0, 1, 1, 2):
        accept(rows.where(F.col("n") == n).drop("n"), n)
    kept = store.submissions(spark).select(F.lit("submission").alias("kind"), F.col("payload_sha256").alias("key"), F.col("task_id").alias("value"), "batch")
    return kept.union(store.tasks(spark).select(F.lit("task"), "task_id", "payload", "batch"))


@query("""
WITH j AS (SELECT event_id, row_number() OVER (ORDER BY epoch_us(ts), event_id::VARCHAR) - 1 AS k FROM events WHERE event_type = 'click')
SELECT event_id::VARCHAR AS id, CASE k // 40 WHEN 1 THEN 'b' ELSE 'a' END AS worker, 1 AS attempts FROM j WHERE k < 120""")
def claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of two workers' three batches of 40 due jobs, one of which runs twice."""
    rows = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("submission_id"), F.lit("queued").alias("status"), micros("ts").alias("run_after"), F.lit(0).alias("attempts"))
    log = ClaimLog(spark, scratch_path(spark, "claims"))
    for worker, batch in (("a", 0), ("b", 0), ("b", 0), ("a", 1)):
        log.claim(rows, 1 << 60, worker, batch, 40)
    return log.claims().select("id", F.col("locked_by").alias("worker"), "attempts")


@query("""
WITH j AS (SELECT event_id, user_id, epoch_us(ts) AS us, max(epoch_us(ts)) OVER () - 86400000000 AS now FROM events QUALIFY event_type = 'click')
SELECT j.event_id, j.user_id, 'judging' AS status, 2 AS attempts, 'w' AS locked_by FROM (SELECT * FROM j WHERE us <= now ORDER BY us, event_id LIMIT 50) j""")
def claimed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty due jobs that a worker takes, beside their submissions."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", micros("ts").alias("us"))
    now = events.agg(F.max("us")).first()[0] - 86_400_000_000
    rows = events.where("event_type = 'click'").select(F.col("event_id").alias("id"), F.col("user_id").alias("submission_id"), F.lit("queued").alias("status"), F.col("us").alias("run_after"), F.lit(1).alias("attempts"))
    submissions = events.select(F.col("user_id").alias("submission_id")).distinct().withColumn("status", F.lit("queued"))
    taken = jobs.claimed(rows, submissions, F.lit(now), "w", 50)
    return taken.select(F.col("id").alias("event_id"), F.col("submission_id").alias("user_id"), "status", "attempts", "locked_by")


@query("SELECT o_orderkey AS submission_id, 't' || o_custkey AS task_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 50000 AND c_nationkey % 2 = 0")
def published_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions that may be shown: published, scored and stored."""
    status = F.when(F.col("o_orderstatus") == "F", "published").otherwise("judging")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"), text("t", F.col("o_custkey")).alias("task_id"), status.alias("status"), F.when(F.col("o_totalprice") > 50000, "{}").alias("scorecard"))
    tasks = table(spark, sf_dir, "customer").select(text("t", F.col("c_custkey")).alias("task_id"), F.when(F.col("c_nationkey") % 2 == 0, "tasks/x.json").otherwise("").alias("github_path"))
    return jobs.published(rows, tasks).select("submission_id", "task_id")


@query("""SELECT o_orderkey, sha256(concat('{"o_orderkey":', o_orderkey, ',"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}')) AS payload_sha256 FROM orders""")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of rows for idempotent writes."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.payload_hash("o_orderkey", "o_custkey", "o_orderstatus").alias("payload_sha256"))


@query(r"""
SELECT page_id, sha256(url) AS cursor, regexp_replace(regexp_extract(url, '[^/]*$'), '\.jsonl$', '') AS base, page_id::VARCHAR AS session, concat('/home/u/', page_id) AS folder, page_id % 3 = 0 AS main FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths say: cursor keys, base names, sessions of rollout files, folders of slugs, and main transcripts."""
    k = F.col("page_id")
    slug = text("s", k % 7)
    path = F.when(k % 3 == 0, text("/r/projects/", slug, "/f.jsonl")).when(k % 3 == 1, text("/r/projects/", slug, "/sub/f.jsonl")).otherwise(text("/x/projects/", slug, "/f.jsonl"))
    rollout = text(F.col("url"), "/rollout-2026-01-02T03-04-05-", k, ".jsonl")
    return table(spark, sf_dir, "pages").select(
        "page_id", lines.cursor_key(F.col("url")).alias("cursor"), lines.base_name(F.col("url")).alias("base"), lines.rollout_session(rollout).alias("session"), lines.slug_path(text("-home-u-", k)).alias("folder"),
        classify.is_main_transcript(path, "/r/", slug).alias("main"),
    )


@query("""
WITH c AS (SELECT ['starting_prompt', 'all_prompts', 'assistant_msgs', 'tool_calls', 'tool_outputs', 'code_diffs', 'repo_linkage', 'full_transcript'] AS names),
     u AS (SELECT user_id, list(DISTINCT CASE WHEN event_id % 9 = 8 THEN 'other' ELSE names[(event_id % 9 + 1)::INTEGER] END) AS mine FROM events CROSS JOIN c GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(names, lambda x: list_contains(mine, x)), ',') AS categories, CASE WHEN user_id % 8 < 2 THEN 'prompts' WHEN user_id % 8 < 5 THEN 'actions' WHEN user_id % 8 < 7 THEN 'code' ELSE 'full' END AS tier FROM u CROSS JOIN c""")
def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known categories of each user's list in their fixed order, and the least tier for one of them."""
    names = F.array(*map(F.lit, [*consent.CATEGORIES, "other"]))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.element_at(names, (F.col("event_id") % 9 + 1).cast("int"))).alias("mine"))
    return rows.select("user_id", F.array_join(consent.in_order(F.col("mine")), ",").alias("categories"), consent.required_tier(F.element_at(names, (F.col("user_id") % 8 + 1).cast("int"))).alias("tier"))


@query("""
SELECT c_custkey, ['hashes_only', 'prompts', 'actions', 'code', 'full'][CASE WHEN c_nationkey % 2 = 0 THEN least(c_custkey % 5, 2) ELSE c_custkey % 5 END + 1] AS tier,
       CASE WHEN CASE WHEN c_nationkey % 2 = 0 THEN least(c_custkey % 5, 2) ELSE c_custkey % 5 END >= 2 THEN c_name ELSE '' END AS tool_call_text,
       CASE WHEN CASE WHEN c_nationkey % 2 = 0 THEN least(c_custkey % 5, 2) ELSE c_custkey % 5 END >= 3 THEN c_mktsegment ELSE '' END AS patch FROM customer""")
def purged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records after one repository's are brought down to the tier of actions."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", consent.tier_of(k % 5).alias("tier"), F.when(F.col("c_nationkey") % 2 == 0, "r0").otherwise("r1").alias("remote_url"), F.col("c_name").alias("tool_call_text"), F.col("c_mktsegment").alias("patch")
    )
    return capture.purge(rows, "actions", "r0").select("c_custkey", "tier", "tool_call_text", "patch")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('go=', p_brand, ',node=', p_name, ',rust=1') ELSE concat('go=', p_brand, ',node=', p_type) END AS toolchain FROM part")
def toolchains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool versions with those that override them."""
    base = F.create_map(F.lit("go"), F.col("p_brand"), F.lit("node"), F.col("p_type"))
    over = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("node"), F.col("p_name"), F.lit("rust"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>"))
    told = F.transform(F.array_sort(F.map_entries(capture.toolchain(base, over))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(told, ",").alias("toolchain"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(CASE WHEN o_orderkey % 4 = 0 THEN 'old' ELSE 'new' END, o_orderkey) AS source FROM orders GROUP BY o_custkey")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's last row of an existing table and a new one."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    old, new = rows.where("o_orderkey % 4 = 0").withColumn("source", F.lit("old")), rows.where("o_orderkey % 4 <> 0").withColumn("source", F.lit("new"))
    return sinks.upsert(old, new, ["o_custkey"], ["o_orderkey"])


@query("""
SELECT l_orderkey, count(*) AS lines_added, count(*) FILTER (l_returnflag = 'R') AS lines_survived, count(*) FILTER (l_linestatus = 'F') AS lines_committed, count(*) FILTER (l_linestatus = 'F') > 0 AS committed FROM lineitem GROUP BY l_orderkey""")
def resolved_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that survive in the working tree and in the last commit, a row a session."""
    rows = table(spark, sf_dir, "lineitem")
    scores = rows.groupBy("l_orderkey").agg(F.count("*").alias("lines_added"), F.count_if(F.col("l_returnflag") == "R").alias("lines_survived"))
    head = rows.where("l_linestatus = 'F'").groupBy("l_orderkey").agg(F.count("*").alias("lines_survived"))
    return survival.resolved(scores, head, ["l_orderkey"]).select("l_orderkey", "lines_added", "lines_survived", "lines_committed", "committed")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'accepted' END AS outcome, CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 ELSE 0 END AS corrections, CASE WHEN doc_id % 2 = 1 THEN 'decode verdict' END AS error FROM labels")
def canned_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a judge that answers from a table; half of the sessions have no answer."""
    sessions = table(spark, sf_dir, "labels").select("doc_id")
    replies = sessions.where("doc_id % 2 = 0").select("doc_id", text('{"outcome":"accepted","corrections":', F.col("doc_id") % 4, ',"sentiment":0.5}').alias("reply"))
    judged = verdict.table_judge(sessions, replies, "doc_id")
    return judged.select("doc_id", F.when(F.col("verdict.error").isNull(), F.col("verdict.outcome")).alias("outcome"), F.col("verdict.corrections").cast("long").alias("corrections"), F.col("verdict.error").alias("error"))


@query("SELECT 'rec-' || doc_id AS name FROM documents ORDER BY name LIMIT 25")
def pending_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pending files that a scan of 25 takes."""
    return jobs.pending_files(table(spark, sf_dir, "documents").select(text("rec-", F.col("doc_id")).alias("name")), 25)


@query(r"""SELECT c_custkey, concat('{"b":"\u003c', c_mktsegment, '\u0026\u003e","z":{"a":[', c_custkey, ',100],"n":"', c_name, '"}}') AS json FROM customer""")
def canonical_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON re-encoded with its keys in order at all depths."""
    raw = text('{"z": {"n":"', F.col("c_name"), '", "a":[', F.col("c_custkey"), '.0, 1e2]}, "b" : "<', F.col("c_mktsegment"), '&>"}')
    return table(spark, sf_dir, "customer").select("c_custkey", rawjson.canonical_json(raw).alias("json"))
