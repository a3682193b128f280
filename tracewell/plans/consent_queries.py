"""Queries over settings files, judges' prompts, cut texts, tasks' files and failed publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import consent, text, verdict
from tracewell.operators import capture, jobs

from .file_queries import SALT
from .registry import query, table
from .rule_queries import pick, picked

IPAD, OPAD = (bytes(b ^ k for b in SALT.ljust(64, b"\0")).hex() for k in (0x36, 0x5C))
LINES = [
    "tier = full", "# tier = code", " tier=actions ", "repo.aa11.tier = code", "repo.aa11.tier = prompts", "repo.bb22.tier = full", "category.tool_calls = yes", "category.tool_calls = off",
    "category.full_transcript = ON", "category.code_diffs = 1", "declined = true", "declined = No", "no equals sign", "", "theme = dark", "declined = maybe", "category.emails = yes", "tier = Full",
]
WHICH = "CASE WHEN event_id % 6 < 4 THEN (event_id * 5 + user_id * 3 + event_id // 6) % 15 ELSE (event_id // 6 * 11 + event_id % 6 * 7 + user_id) % 18 END"
_CATEGORIES = "['starting_prompt', 'all_prompts', 'assistant_msgs', 'tool_calls', 'tool_outputs', 'code_diffs', 'repo_linkage', 'full_transcript']"
_TIERS = "['hashes_only', 'prompts', 'actions', 'code', 'full']"
#: CTE f: owner, tier, repository aa11's tier, categories asked for, declined, malformed.
SETTINGS_SQL = f"""
l AS (SELECT event_id // 6 AS owner, event_id AS pos, trim({picked(LINES, WHICH)}) AS line FROM events),
k AS (SELECT owner, pos, CASE WHEN line NOT LIKE '#%' AND contains(line, '=') THEN trim(split_part(line, '=', 1)) END AS key, trim(split_part(line, '=', 2)) AS value FROM l),
b AS (SELECT *, CASE WHEN key = 'tier' THEN NOT list_contains({_TIERS}, value) OR EXISTS (FROM k AS o WHERE o.owner = k.owner AND o.key = 'tier' AND o.pos < k.pos)
        WHEN key LIKE 'repo.%' THEN NOT list_contains({_TIERS}, value) OR EXISTS (FROM k AS o WHERE o.owner = k.owner AND o.key = k.key AND o.pos < k.pos AND o.value <> k.value)
        WHEN key LIKE 'category.%' THEN NOT list_contains({_CATEGORIES}, substr(key, 10)) OR EXISTS (FROM k AS o WHERE o.owner = k.owner AND o.key = k.key AND o.pos < k.pos AND (lower(o.value) IN ('yes', 'on', '1')) <> (lower(k.value) IN ('yes', 'on', '1')))
        WHEN key = 'declined' THEN lower(value) NOT IN ('true', 'no') ELSE false END AS bad FROM k),
m AS (SELECT owner, min(pos) FILTER (bad) AS broken FROM b GROUP BY owner),
f AS (SELECT owner, broken IS NOT NULL AS malformed,
        CASE WHEN broken IS NULL THEN coalesce(max(value) FILTER (key = 'tier'), 'hashes_only') ELSE 'hashes_only' END AS tier,
        CASE WHEN broken IS NULL THEN max(value) FILTER (key = 'repo.aa11.tier') END AS repo_tier,
        CASE WHEN broken IS NULL THEN list_filter({_CATEGORIES}, lambda c: list_contains(coalesce(list(substr(key, 10)) FILTER (key LIKE 'category.%' AND lower(value) IN ('yes', 'on', '1')), []), c)) ELSE [] END AS asked,
        coalesce(lower(max_by(value, pos) FILTER (key = 'declined' AND (broken IS NULL OR pos < broken))) = 'true', false) AS declined
      FROM b JOIN m USING (owner) GROUP BY owner, broken)"""


def settings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings files of six lines each, parsed."""
    lines = table(spark, sf_dir, "events").select(F.expr("event_id div 6").alias("owner"), "event_id", pick(LINES, F.expr(WHICH.replace("//", "div"))).alias("line"))
    return consent.settings(lines, "owner", "event_id", "line")


@query(f"""WITH {SETTINGS_SQL} SELECT owner, tier, repo_tier, array_to_string(asked, ',') AS asked, declined, malformed FROM f""")
def consent_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What settings files say: a file that breaks a rule grants nothing."""
    return settings_of(spark, sf_dir).select("owner", "tier", F.try_element_at("repo_tiers", F.lit("aa11")).alias("repo_tier"), F.array_join("categories", ",").alias("asked"), "declined", "malformed")


@query(f"""WITH {SETTINGS_SQL},
c AS (SELECT owner, asked, {_TIERS}[owner % 5 + 1] AS most, CASE WHEN owner % 7 = 1 THEN 'code' WHEN owner % 11 = 2 THEN 'everything' WHEN owner % 3 = 0 AND repo_tier IS NOT NULL THEN repo_tier ELSE tier END AS wanted FROM f),
r AS (SELECT owner, asked, owner % 5 AS cap, least(coalesce(list_position({_TIERS}, wanted), 1) - 1, owner % 5) AS rank FROM c)
SELECT owner, {_TIERS}[rank + 1] AS tier, array_to_string(list_filter({_CATEGORIES}, lambda x: list_position({_CATEGORIES}, x) <= [0, 2, 5, 7, 8][rank + 1] OR (list_contains(asked, x) AND list_position({_CATEGORIES}, x) <= [0, 2, 5, 7, 8][cap + 1])), ',') AS categories FROM r""")
def granted_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier in force and the categories it opens, those asked for beyond it as far as the most recorded tier goes."""
    owner = F.col("owner")
    most = F.element_at(F.array(*map(F.lit, consent.TIERS)), (owner % 5 + 1).cast("int"))
    environment = F.when(owner % 11 == 2, "everything").otherwise("")
    now = consent.granted(F.col("tier"), F.col("repo_tiers"), F.col("categories"), most, F.when(owner % 3 == 0, "aa11"), environment, F.when(owner % 7 == 1, "code"))
    return settings_of(spark, sf_dir).select("owner", now.alias("now")).select("owner", "now.tier", F.array_join("now.categories", ",").alias("categories"))


def _cut_sql(column: str, most: int) -> str:
    """column cut at most bytes: the most characters that fit, and a U+FFFD for each byte then left."""
    kept = f"list_max(list_filter(generate_series({most // 4}, {most}), lambda k: strlen(left({column}, k)) <= {most}))"
    return f"CASE WHEN strlen({column}) <= {most} THEN {column} ELSE left({column}, {kept}) || repeat(chr(65533), ({most} - strlen(left({column}, {kept})))::BIGINT) || '…' END"


@query(f"""SELECT doc_id, {_cut_sql("text", 201)} AS head FROM documents""")
def byte_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 201 bytes of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_bytes(F.col("text"), 201, text.CUT).alias("head"))


@query(f"""SELECT conv_id, sha256('Judge this.' || chr(10) || chr(10) || '--- transcript ---' || string_agg(chr(10) || chr(10) || CASE WHEN role = 'user' THEN 'developer' ELSE 'assistant' END || ': ' || {_cut_sql("text", 1500)}, '' ORDER BY turn)) AS prompt FROM conversations GROUP BY conv_id""")
def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the prompts that ask a judge about conversations."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    made = verdict.prompt("Judge this.", F.col("turns"), F.array().cast("array<string>"))
    return turns.select("conv_id", F.sha2(made, 256).alias("prompt"))


NAMES = ["src/a.go", "a_test.go", "lib/b.py", "tests/x.py", "go.sum", "", "docs/c.md"]


@query(f"""WITH p AS (SELECT DISTINCT l_orderkey, {picked(NAMES, "l_partkey")} AS path FROM lineitem),
h AS (SELECT l_orderkey, path, 'sha256:' || sha256(unhex('{OPAD}' || sha256(unhex('{IPAD}' || hex(encode(path)))))) AS h FROM p WHERE path <> '')
SELECT l_orderkey, string_agg(path, ',' ORDER BY h) AS files FROM h GROUP BY l_orderkey""")
def task_files_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of each order in order of their paths' salted hashes."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", pick(NAMES, F.col("l_partkey")).alias("path"))
    return capture.files_by_hash(rows, ["l_orderkey"], SALT).select("l_orderkey", F.array_join(F.transform("files", lambda f: f["path"]), ",").alias("files"))


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 4 AS attempts, o_custkey % 3 = 0 AND o_orderkey % 5 = 0 AS conflict, CASE o_custkey % 6 WHEN 0 THEN 400 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 500 END AS http FROM orders),
s AS (SELECT o_orderkey, CASE WHEN http IN (400, 401) OR conflict OR attempts >= 3 THEN 'failed' ELSE 'judged' END AS status FROM f)
SELECT o_orderkey, status, status <> 'failed' AS pending, status = 'failed' AS terminal FROM s""")
def publish_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where failed publications go: tried again, or given up when the store refuses them or another task has their id."""
    http = F.element_at(F.array(*(F.lit(x).cast("int") for x in (400, 401, 403, 500, None, None))), (F.col("o_custkey") % 6 + 1).cast("int"))
    permanent = jobs.permanent_publish_failure(http, (F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 5 == 0))
    status = jobs.next_status(F.lit("publishing"), jobs.failure_event(F.col("o_orderkey") % 4, permanent))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status")).select("*", jobs.is_pending(F.col("status")).alias("pending"), jobs.is_terminal(F.col("status")).alias("terminal"))
