"""Queries over tasks and their files: records, evidence, patches, publishing, lookups, redaction reports."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import redact, scoring
from tracewell.operators import capture, records, signals, survival
from tracewell.sources import dialects

from .file_queries import LINES_SQL, SALT, conv_of, session_files
from .redaction_sql import REDACTION, redaction_sql
from .registry import micros, query, table
from .rule_queries import pick, picked

IPAD, OPAD = (bytes(b ^ k for b in SALT.ljust(64, b"\0")).hex() for k in (0x36, 0x5C))

@query(f"""WITH {redaction_sql()}, c AS (SELECT lang, unnest(found) AS category FROM r{len(REDACTION)}), n AS (SELECT lang, category, count(*) AS n FROM c GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS spans, string_agg(category || '=' || n, ',' ORDER BY category) AS by_category FROM n GROUP BY 1""")
def redaction_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction reports merged by language."""
    merged = redact.merge_reports(redact.scrub(table(spark, sf_dir, "documents").select("lang", "text")), ["lang"]).where("spans > 0")
    parts = F.transform(F.sort_array(F.map_entries("by_category")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return merged.select("lang", "spans", F.array_join(parts, ",").alias("by_category"))


@query(rf"""WITH {LINES_SQL},
b AS (SELECT *, (sum(strlen(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - strlen(line) - 1)::BIGINT AS pos, coalesce(bool_or(kind = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS spoken FROM l),
e AS (SELECT conv_id, pos, CASE WHEN kind = 'assistant' AND turn % 4 >= 2 THEN 'scope' WHEN kind <> 'user' OR NOT spoken THEN NULL
        WHEN regexp_matches(text, '(?i)\b(wrong|try again|fix|failed|failing|error|broken|revert|undo|not what|doesn''?t|didn''?t|actually)\b') THEN 'human_correction'
        WHEN regexp_matches(text, '(?i)\b(lgtm|looks good|works|thank|thanks|great|perfect|ship it|nice|done)\b') THEN 'human_acceptance' END AS signal FROM b)
SELECT conv_id, count(*) FILTER (signal = 'scope')::INTEGER AS edits, count(*) FILTER (signal = 'human_correction')::INTEGER AS corrections, string_agg(signal || '@' || pos, ',' ORDER BY pos) AS signals FROM e WHERE signal IS NOT NULL GROUP BY conv_id""")
def session_file_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observed signals of session files with their byte places."""
    rows = signals.evidence(dialects.facts(session_files(spark, sf_dir))).where(F.size("evidence") > 0)
    told = F.array_join(F.transform("evidence", lambda e: F.concat(e["signal"], F.lit("@"), e["offset"].cast("string"))), ",")
    return rows.select(conv_of(F.col("path")).alias("conv_id"), signals.evidence_count(F.col("evidence"), "scope").alias("edits"), signals.evidence_count(F.col("evidence"), "human_correction").alias("corrections"), told.alias("signals"))


@query(f"""WITH {LINES_SQL}
SELECT conv_id, count(*) FILTER (kind = 'user' AND trim(text) <> '')::INTEGER AS prompts, sha256(coalesce(string_agg(text, '|' ORDER BY turn) FILTER (kind = 'assistant' AND trim(text) <> ''), '')) AS answers,
       count(*) FILTER (kind = 'assistant')::INTEGER AS calls, array_to_string(list_sort(list_distinct(list(CASE WHEN turn % 4 < 2 THEN 'Bash' ELSE 'Edit' END) FILTER (kind = 'assistant'))), ',') AS tools
FROM l GROUP BY conv_id HAVING count(*) FILTER (kind = 'assistant' OR (kind = 'user' AND trim(text) <> '')) > 0""")
def session_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by kind and the tools of session files, as a task record keeps them."""
    rows = capture.texts_by_kind(dialects.facts(session_files(spark, sf_dir)))
    answers = F.array_join(F.transform("assistant_messages", lambda m: m["text"]), "|")
    tools = F.when(F.size("tools") > 0, F.array_join("tools", ","))
    return rows.select(conv_of(F.col("path")).alias("conv_id"), F.size("prompts").alias("prompts"), F.sha2(answers, 256).alias("answers"), F.size("tool_calls").alias("calls"), tools.alias("tools"))


PATCHED = ["src/a.go", "a_test.go", "lib/b.py", "tests/x.py", "go.sum"]


@query(f"""
WITH l AS (SELECT l_orderkey, {picked(PATCHED, "l_suppkey")} AS path, l_linenumber AS pos, l_linestatus || l_partkey AS line FROM lineitem), u AS (SELECT DISTINCT * FROM l),
     f AS (SELECT l_orderkey, path, min(pos) AS first, '+++ b/' || path || chr(10) || string_agg('+' || line, chr(10) ORDER BY pos, line) || chr(10) AS body FROM u GROUP BY 1, 2)
SELECT l_orderkey, coalesce(string_agg(body, '' ORDER BY first, body) FILTER (path NOT IN ('a_test.go', 'tests/x.py')), '') AS patch, coalesce(string_agg(body, '' ORDER BY first, body) FILTER (path IN ('a_test.go', 'tests/x.py')), '') AS test_patch FROM f GROUP BY 1""")
def patch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines as patches, tests apart."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", pick(PATCHED, F.col("l_suppkey")).alias("path"), F.col("l_linenumber").alias("at"), F.concat("l_linestatus", F.col("l_partkey").cast("string")).alias("line"))
    return capture.patches(lines.distinct(), ["l_orderkey"])


REMOTES = ["https://github.com/o/r", "git@gitlab.com:o/r", "https://corp.github.com/o/r", "", "https://example.org/o/r"]
LICENCES = ["MIT", "GPL-3.0", "Apache-2.0", "", "AGPL-3.0", "ISC", "0BSD"]


@query(f"""
WITH t AS (SELECT c_custkey AS k, c_name AS prompt, {picked(REMOTES, "c_custkey")} AS remote, {picked(LICENCES, "c_custkey // 2")} AS licence, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'c' || c_custkey END AS base, c_custkey % 3 = 0 AS bare, c_custkey % 2 = 0 AS from_start, c_custkey % 4 AS touched, c_custkey % 11 < 4 AS agreed FROM customer),
     p AS (SELECT *, remote IN ('https://github.com/o/r', 'git@gitlab.com:o/r') AS public FROM t),
     n AS (SELECT *, ((remote = '')::INTEGER + (NOT public)::INTEGER + (base = '')::INTEGER + (bare AND NOT from_start)::INTEGER + (bare AND touched = 0)::INTEGER) AS problems FROM p)
SELECT k AS c_custkey, 'sha256:' || sha256(concat(remote, chr(0), base, chr(0), prompt)) AS task_id, public AS is_public, problems, problems = 0 AND (bare OR agreed OR licence IN ('MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'Apache-2.0', 'ISC', 'Unlicense', '0BSD')) AS publish FROM n""")
def publishable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tasks may be published."""
    k = F.col("c_custkey")
    tasks = table(spark, sf_dir, "customer").select(
        k, pick(REMOTES, k).alias("remote_url"), pick(LICENCES, k / 2).alias("licence"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("c"), k.cast("string"))).alias("base_commit"),
        F.when(k % 3 != 0, "x").alias("patch"), F.lit("").alias("test_patch"), F.array("c_name").alias("prompts"), (k % 2 == 0).alias("base_from_start"), (k % 4).alias("files_touched"), (k % 11 < 4).alias("agreed"),
    )
    return capture.publishable(tasks).select("c_custkey", "task_id", "is_public", F.size("problems").alias("problems"), "publish")


@query("SELECT n_nationkey, n_nationkey + 1 IN (2, 5, 6, 7, 20) AS chosen, n_nationkey + 1 NOT IN (2, 5, 6, 7, 20) AS rest FROM nation")
def chosen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by a selection of their numbers, and those it leaves."""
    files = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 1).alias("number"))
    one = capture.chosen(files, "2, 5-7,20").select("n_nationkey", F.lit(True).alias("chosen"), F.lit(False).alias("rest"))
    return one.union(capture.not_chosen(files, "2, 5-7,20").select("n_nationkey", F.lit(False), F.lit(True)))


@query("SELECT c_custkey, c_name AS session_id FROM customer WHERE c_name = 'Customer#000000007'")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session by the salted hash of its name."""
    wanted = "sha256:" + hmac.new(SALT, b"Customer#000000007", hashlib.sha256).hexdigest()
    return records.find_session(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("session_id")), wanted, SALT)


@query("SELECT event_id, nullif(event_type, '') AS type, value FROM events WHERE event_id % 5 <> 0")
def event_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON lines and read back; broken lines and those without a type go."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 != 5, F.col("event_type")).alias("type"), "value")
    line = F.when(F.col("event_id") % 10 == 0, '{"event_id":').otherwise(records.event_line(["event_id", "type", "value"]))
    return records.read_events(rows.select(line.alias("line")), "event_id long, type string, value double")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN '2.2.2.2' WHEN 2 THEN '3.3.3.3' ELSE '10.0.0.' || c_custkey % 250 END AS client,
       CASE c_custkey % 3 WHEN 0 THEN 'https://github.com/o/r/blob/c1/tasks/' || c_custkey || '.json' ELSE '' END AS url FROM customer""")
def client_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients by their headers or connections, and where files can be read."""
    k, t = F.col("c_custkey"), lambda *kv: F.create_map(*map(F.lit, kv))
    headers = (
        F.when(k % 4 == 0, t("fly-client-ip", " 1.1.1.1", "x-real-ip", "2.2.2.2")).when(k % 4 == 1, t("fly-client-ip", " ", "x-real-ip", "2.2.2.2"))
        .when(k % 4 == 2, t("x-forwarded-for", " 3.3.3.3 , 4.4.4.4")).otherwise(t("accept", "*/*"))
    )
    pull = F.when(k % 3 == 0, "https://github.com/o/r/pull/9").when(k % 3 == 1, "https://example.org/o/r/pull/9").otherwise("")
    remote, path = F.format_string("10.0.0.%d:%d", k % 250, k + 1024), F.format_string("/tasks/%d.json", k)
    return table(spark, sf_dir, "customer").select("c_custkey", records.client_key(headers, remote).alias("client"), records.corpus_url(pull, F.lit("c1"), path).alias("url"))


LOCKS = ["go.sum", "go.mod", "README", "Cargo.lock", "cargo.lock", "poetry.lock", "requirements.txt", "Gemfile.lock"]


@query(f"""
WITH f AS (SELECT p_partkey // 8 AS repo, {picked(LOCKS, "p_partkey")} AS name, p_name AS content FROM part WHERE p_partkey % 8 <> 5 OR p_partkey % 3 <> 0),
     k AS (SELECT repo, name, 'sha256:' || sha256(unhex('{OPAD}' || sha256(unhex('{IPAD}' || hex(encode(content)))))) AS h FROM f WHERE name IN ('go.sum', 'go.mod', 'package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'Cargo.lock', 'poetry.lock', 'requirements.txt') AND content <> '')
SELECT repo, string_agg(name || '=' || h, ',' ORDER BY name) AS lockfiles FROM k GROUP BY 1""")
def lockfile_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted hashes of repositories' lockfiles."""
    k = F.col("p_partkey")
    files = table(spark, sf_dir, "part").where("p_partkey % 8 <> 5 or p_partkey % 3 <> 0").select(F.floor(k / 8).alias("repo"), pick(LOCKS, k).alias("name"), F.col("p_name").alias("content"))
    parts = F.transform(F.sort_array(F.map_entries("lockfiles")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return capture.lockfile_hashes(files, ["repo"], SALT).select("repo", F.array_join(parts, ",").alias("lockfiles"))


@query("""
WITH d AS (SELECT l_orderkey AS repo, 'f' || l_suppkey % 3 AS path, 'line ' || l_linenumber % 2 AS line FROM lineitem WHERE l_linenumber < 5),
     b AS (SELECT o_orderkey AS repo, 'new' AS path, unnest(['line 1', 'line 1']) AS line FROM orders WHERE o_orderkey % 2 = 0)
SELECT repo, path, line, count(*) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM b) u GROUP BY 1, 2, 3""")
def pending_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag of the lines that diffs and untracked files add."""
    diff = table(spark, sf_dir, "lineitem").where("l_linenumber < 5").select(F.col("l_orderkey").alias("repo"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("path"), F.concat(F.lit("line "), (F.col("l_linenumber") % 2).cast("string")).alias("line"))
    bodies = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("repo"), F.lit("new").alias("path"), F.lit(" line 1\n\nline 1\n").alias("content"))
    return survival.count_lines(survival.pending_lines(diff, bodies, ["repo", "path"], "content"), ["repo", "path"])


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us FROM orders), p AS (SELECT o_orderkey, us, lag(us) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS earlier FROM o)
SELECT o_orderkey, (us - earlier) / 3600000000.0::DOUBLE AS hours FROM p WHERE earlier IS NOT NULL""")
def hours_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since a customer's order before."""
    own = Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", micros("o_orderdate").alias("us")).withColumn("earlier", F.lag("us").over(own)).where("earlier is not null")
    return rows.select("o_orderkey", scoring.hours_between(F.timestamp_micros("us"), F.timestamp_micros("earlier")).alias("hours"))


@query("""
SELECT o_orderkey, concat_ws(' · ', CASE o_orderkey % 3 WHEN 0 THEN 'tests passed' WHEN 1 THEN 'tests failed' ELSE 'no tests run' END, CASE WHEN o_orderkey % 2 = 0 THEN 'changes landed' END,
       CASE o_orderkey % 5 WHEN 0 THEN 'clean finish' WHEN 1 THEN 'abandoned' END, CASE WHEN o_orderkey % 4 > 0 THEN concat(o_orderkey % 4, ' correction(s)') END) AS outcome,
       CASE WHEN o_orderkey % 3 = 0 THEN 'good; fast' WHEN o_orderkey % 3 = 1 THEN 'fast' ELSE 'note' END AS summary FROM orders""")
def outcome_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes and scorecards in words."""
    k = F.col("o_orderkey")
    outcome = capture.outcome_summary(F.when(k % 3 == 0, "passed").when(k % 3 == 1, "failed").otherwise(""), k % 2 == 0, F.when(k % 5 == 0, "clean").when(k % 5 == 1, "abandoned").otherwise("unknown"), k % 4)
    axis = lambda name, present, detail: F.struct(F.lit(name).alias("name"), present.alias("present"), F.lit(1.0).alias("score"), F.lit(detail).alias("detail"))
    axes = F.array(axis("efficiency", k % 3 < 2, " fast "), axis("success", k % 3 == 0, "good"), axis("autonomy", F.lit(True), " "), axis("friction", F.lit(True), "other"))
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.alias("outcome"), capture.scorecard_summary(axes, F.lit(" note ")).alias("summary"))
