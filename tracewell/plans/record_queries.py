"""Queries over orders, events, labels and pages: grouping, batches, states, paths, tiers, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import consent, text, verdict
from tracewell.operators import capture, carry, jobs, latest

from .registry import micros, query, table


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS tools, count(*) AS calls FROM events WHERE event_type <> 'error' GROUP BY user_id")
def distinct_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct kinds of each user, failed ones left out."""
    rows = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("tools"), F.count("*").alias("calls"))


@query("""
SELECT o_custkey AS repository, o_orderkey AS path, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) / 10)::INTEGER AS batch FROM orders""")
def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in upload order, in batches of ten a repository."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), F.col("o_orderkey").alias("path"), micros("o_orderdate").alias("changed_at"))
    return capture.upload_batches(files).select("repository", "path", "batch")


@query("SELECT o_custkey AS repository, arg_max(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS path, max(epoch_us(o_orderdate)) AS changed_at FROM orders GROUP BY 1")
def newest_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each repository's file changed last."""
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), F.col("o_orderkey").alias("path"), micros("o_orderdate").alias("changed_at"))
    return capture.newest_transcript(files)


@query("""
SELECT o_custkey AS repository, count(*) AS files, count(*) FILTER (o_orderstatus = 'F') AS sent, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY 1""")
def upload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of uploads per repository."""
    status = F.when(F.col("o_orderstatus") == "F", "sent").when(F.col("o_orderstatus") == "O", "skipped").when(F.col("o_orderstatus") == "P", "failed")
    return capture.upload_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository"), status.alias("status")))


_STATES = ["judged", "judging", "published", "publishing", "queued"]
_EVENTS = ["claim", "fail", "noise", "retry", "scored", "stale", "success"]


@query(f"""
WITH e AS (SELECT event_id, {_STATES}[(event_id % {len(_STATES)} + 1)::INTEGER] AS status, {_EVENTS}[((event_id // {len(_STATES)}) % {len(_EVENTS)} + 1)::INTEGER] AS event FROM events)
SELECT event_id, status, event, CASE status || ' ' || event WHEN 'queued claim' THEN 'judging' WHEN 'judging scored' THEN 'judged' WHEN 'judging noise' THEN 'filtered' WHEN 'judging retry' THEN 'queued' WHEN 'judging fail' THEN 'failed' WHEN 'judging stale' THEN 'queued'
       WHEN 'judged claim' THEN 'publishing' WHEN 'publishing success' THEN 'published' WHEN 'publishing retry' THEN 'judged' WHEN 'publishing fail' THEN 'failed' WHEN 'publishing stale' THEN 'judged' END AS after FROM e""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status after every pair of status and event."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", pick(_STATES, F.col("event_id")).alias("status"), pick(_EVENTS, F.floor(F.col("event_id") / len(_STATES))).alias("event"))
    return rows.withColumn("after", jobs.next_status(F.col("status"), F.col("event")))


@query("SELECT doc_id, repeat('█', floor((n_chars % 1001) / 10.0 / 10 + 0.5)::INTEGER) || repeat('░', 10 - floor((n_chars % 1001) / 10.0 / 10 + 0.5)::INTEGER) AS bar FROM documents")
def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores as bars of ten cells."""
    return table(spark, sf_dir, "documents").select("doc_id", capture.score_bar((F.col("n_chars") % 1001) / 10.0).alias("bar"))


@query("SELECT doc_id, 'tasks/sha256/' || sha256(text)[1:2] || '/' || sha256(text) || '.json' AS path FROM documents")
def task_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where published tasks are stored."""
    return table(spark, sf_dir, "documents").select("doc_id", capture.corpus_path(F.concat(F.lit("sha256:"), F.sha2("text", 256))).alias("path"))


@query(r"SELECT page_id, replace(regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g'), '..', '__') AS component FROM pages")
def safe_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs as single path components."""
    return table(spark, sf_dir, "pages").select("page_id", text.safe_component(F.col("url")).alias("component"))


_TIERS = ["hashes_only", "prompts", "actions", "code", "full"]


@query(f"""
WITH t AS (SELECT doc_id, {[*_TIERS, ""]}[(doc_id % 6 + 1)::INTEGER] AS site, {[*_TIERS, ""]}[((doc_id // 6) % 6 + 1)::INTEGER] AS repo, {[*_TIERS, ""]}[((doc_id // 36) % 5 + 1)::INTEGER] AS most FROM documents),
     k AS (SELECT *, CASE WHEN repo <> '' THEN repo WHEN site <> '' THEN site ELSE 'hashes_only' END AS asked FROM t)
SELECT doc_id, {_TIERS}[least(list_position({_TIERS}, asked), list_position({_TIERS}, most))] AS tier FROM k""")
def effective_consent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier that settings and the most recorded grant come to."""
    names = F.array(*map(F.lit, [*_TIERS, ""]))
    pick = lambda n, k: F.element_at(names, (F.floor(F.col("doc_id") / n) % k + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", consent.effective(pick(36, 5), pick(1, 6), pick(6, 6)).alias("tier"))


@query("""
WITH v AS (SELECT doc_id, ['accepted', 'corrected', 'abandoned', 'odd'][(doc_id % 4 + 1)::INTEGER] AS o, ((doc_id % 7) - 2)::INTEGER AS c, ((doc_id % 11) - 5) / 4.0::DOUBLE AS s FROM labels),
     n AS (SELECT doc_id, o, greatest(c, 0) AS c, greatest(least(s, 1.0), -1.0)::DOUBLE AS s FROM v)
SELECT doc_id, o AS outcome, CASE WHEN o = 'odd' THEN 'invalid outcome' END AS error,
       CASE WHEN o <> 'odd' THEN greatest(least(sign(x) * floor(abs(x) * 10 + 0.5) / 10, 100.0), 0.0) END AS score
FROM (SELECT *, (CASE o WHEN 'accepted' THEN 100.0 WHEN 'corrected' THEN 60.0 ELSE 15.0 END)::DOUBLE - 8 * c::DOUBLE + 10 * s AS x FROM n) q""")
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up replies of a judge, parsed."""
    outcome = F.element_at(F.array(*map(F.lit, ["accepted", "corrected", "abandoned", "odd"])), (F.col("doc_id") % 4 + 1).cast("int"))
    reply = F.format_string('So: {"outcome":"%s","corrections":%d,"sentiment":%s}.', outcome, F.col("doc_id") % 7 - 2, (((F.col("doc_id") % 11) - 5) / 4.0).cast("string"))
    rows = table(spark, sf_dir, "labels").select("doc_id", verdict.parse(reply).alias("v"))
    return rows.select("doc_id", "v.outcome", "v.error", "v.score")


@query("""
SELECT user_id, event_type, arg_max(event_id, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS event_id, arg_max(value, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS value FROM events GROUP BY 1, 2""")
def last_result_per_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the results of one call the last."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", micros("ts").alias("us"), "event_id", "value")
    return carry.last_result_per_call(rows, ["user_id"], "event_type", ["us", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
SELECT s_nationkey AS nation, count(*) AS submissions, max(s_acctbal) AS best_score, arg_max(s_acctbal, s_suppkey) AS latest_score, max(s_suppkey) AS latest_at,
       sign(avg(s_acctbal)) * floor(abs(avg(s_acctbal)) * 10 + 0.5) / 10 AS average_score FROM supplier GROUP BY 1""")
def supplier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaderboard's statistics over another table."""
    rows = table(spark, sf_dir, "supplier").withColumn("nation", F.col("s_nationkey"))
    return latest.model_stats(rows, ["nation"], "s_acctbal", "s_suppkey", "s_suppkey").select("nation", "submissions", "best_score", "latest_score", "latest_at", "average_score")
