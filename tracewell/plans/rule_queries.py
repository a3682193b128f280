"""Queries over made-up commands, outputs, prompts, paths, JSON values and times; their SQL spells every rule out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import classify, text
from tracewell.functions.regex import re2

from .registry import query, table


def listed(values: list[str]) -> str:
    """Values as a list in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(n) % len(values) + 1).cast("int"))


def picked(values: list[str], n: str) -> str:
    """pick() in SQL."""
    return f"{listed(values)}[(({n}) % {len(values)} + 1)::INTEGER]"


TOOLS = ["Bash", " zsh ", "EXEC_COMMAND", "a.exec_command", "b.Run_Command", "WebFetch", "mcp__web_search", "Browser.open", "Edit", "MultiEdit", "str_replace_editor", "apply_patch", "Read", "", "command", "bashful", "create_file", "Write", "exec"]


@query(f"""
WITH t AS (SELECT event_id, {picked(TOOLS, "event_id")} AS name FROM events)
SELECT event_id, name, regexp_matches(lower(name), 'webfetch|websearch|web_search|browser') AS web, lower(name) IN ('edit', 'write', 'multiedit', 'str_replace', 'str_replace_editor', 'apply_patch', 'create_file') AS edit,
       trim(lower(name)) IN ('bash', 'shell', 'sh', 'zsh', 'powershell', 'exec', 'exec_command', 'run_command', 'command') OR regexp_matches(trim(lower(name)), '\\.(exec|run)_command$') AS executes FROM t""")
def tool_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tools of a name do."""
    name = F.col("name")
    rows = table(spark, sf_dir, "events").select("event_id", pick(TOOLS, F.col("event_id")).alias("name"))
    return rows.select("event_id", "name", classify.is_web_tool(name).alias("web"), classify.is_edit_tool(name).alias("edit"), classify.is_exec_tool(name).alias("executes"))


COMMANDS = ["go test ./...", "npm run build", "npm build", "make", "make all", "makefile", "tsc", "tscx", "tsc -p .", "git commit -m x", "GIT PUSH", "gh pr create", "cat >x", "tee  a >b", "python a write_text", "ruff .", "echo hi", "cargo clippy", "gofmt -w .", "apply_patch <<E", "pnpm lint", "PyTest -q", "dotnet test"]
BEFORE = ["", "cd a && ", "x", "true; "]


@query(rf"""
WITH t AS (SELECT event_id, {picked(BEFORE, "event_id // " + str(len(COMMANDS)))} || {picked(COMMANDS, "event_id")} AS command FROM events)
SELECT event_id, command,
       regexp_matches(command, '(?i)(go test|go build|go vet|gotestsum|pytest|py\.test|npm (run )?(test|build)|yarn (test|build)|pnpm (test|build)|jest|vitest|mocha|cargo (test|build|clippy)|make( |$)|tsc(\s|$)|eslint|ruff|flake8|mypy|golangci-lint|rubocop|phpunit|gradle (test|build)|mvn (test|verify)|dotnet test|ctest)') AS verifies,
       regexp_matches(command, '(?i)(git commit|git push|gh pr create)') AS lands,
       regexp_matches(command, '(?i)\b(apply_patch|str_replace|cat >|tee .*>|python .*write_text|go fmt|gofmt -w|prettier --write)\b') AS edits FROM t""")
def command_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether commands verify, land or edit."""
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(pick(BEFORE, F.col("event_id") / len(COMMANDS)), pick(COMMANDS, F.col("event_id"))).alias("command"))
    says = lambda pattern: F.col("command").rlike(re2(pattern))
    return rows.select("event_id", "command", says(classify.VERIFY_COMMAND).alias("verifies"), says(classify.LAND_COMMAND).alias("lands"), says(classify.EDIT_BY_SHELL).alias("edits"))


OUTPUTS = ["exit status 1", "Exit code 0", "exited with code 0\nFAIL", "exit status 0 then exit code 2", "ok\nFAIL pkg", "FAILED", "failing", "3 failed", "0 failed", "12 failures", "Traceback (most)", "panic: x", "an error: y", "terror: z", "all good", "FAILURE", "exit code 12"]
AFTER = ["", "\nexit code 0", "\nok", " EXIT STATUS 3"]


@query(rf"""
WITH t AS (SELECT event_id, {picked(OUTPUTS, "event_id")} || {picked(AFTER, "event_id // " + str(len(OUTPUTS)))} AS t FROM events)
SELECT event_id, CASE WHEN regexp_matches(t, '(?i)(exit status|exit code|exited with code) [1-9]') THEN true WHEN regexp_matches(t, '(?i)(exit status|exit code|exited with code) 0') THEN false
       ELSE regexp_matches(t, '(?im)(^|\n)FAIL(\s|$)|(^|\n)FAILED(\s|$)|[1-9][0-9]*\s+(failed|failures?|failing)|Traceback|panic:|\berror:') END AS failed FROM t""")
def failed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a call's output tells of a failure."""
    return table(spark, sf_dir, "events").select("event_id", classify.output_failed(F.concat(pick(OUTPUTS, F.col("event_id")), pick(AFTER, F.col("event_id") / len(OUTPUTS)))).alias("failed"))


PROMPTS = ["Base directory for this skill: /a/skills/pdf-tools more", "base directory for this skill: C:\\skills\\xl.s\nx", "Base directory for this skill: /a/tools/pdf", "[Request interrupted by user]", "please go on", " <system-reminder> a", "# AGENTS.md", "read AGENTS.md instructions first", "You are Claude, a helper", "<instructions>", "see https://a.b", "as in the Screenshot", "see attached file", ""]


@query(rf"""
WITH t AS (SELECT event_id, {picked(PROMPTS, "event_id")} AS t FROM events), l AS (SELECT *, lower(trim(t)) AS low FROM t)
SELECT event_id, nullif(regexp_extract(t, '(?i)base directory for this skill:\s*[^\r\n]*[\\/]skills[\\/]([A-Za-z0-9._-]+)\b', 1), '') AS skill, regexp_matches(t, '(?i)\[request interrupted by user') AS interrupted,
       regexp_matches(low, '^(<environment_context|<user_instructions|<environment_details|<instructions|<system-reminder|# agents\.md|agents\.md)') OR regexp_matches(low, 'agents\.md instructions|base directory for this skill|claude\.md instructions|you are claude') AS instructs,
       regexp_matches(lower(t), 'https?://|see attached|screenshot') AS outside FROM l""")
def prompt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, interruptions, instructions and outside context of prompts."""
    p = pick(PROMPTS, F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        "event_id", classify.skill_name(p).alias("skill"), p.rlike(classify.INTERRUPTION).alias("interrupted"), classify.looks_like_instructions(p).alias("instructs"), classify.needs_outside_context(F.array(p)).alias("outside")
    )


INPUTS = ['{"command":"ls"}', '{"command":" ","cmd":"pwd"}', '{"cmd":5,"script":"x"}', '"{\\"script\\":\\"make\\"}"', "not json", "{}", "[1]", '{"command":"a","script":"b"}', '"plain"', '{"script":""}', '{"cmd":"c\\n d"}']


@query(f"""
WITH t AS (SELECT event_id, {picked(INPUTS, "event_id")} AS v FROM events), i AS (SELECT event_id, CASE WHEN starts_with(v, '"') THEN v::JSON->>'$' ELSE v END AS v FROM t), o AS (SELECT event_id, CASE WHEN json_valid(v) THEN v ELSE '{{}}' END AS v FROM i),
     k AS (SELECT event_id, {", ".join(f"CASE WHEN json_type(v, '$.{k}') = 'VARCHAR' AND trim(json_extract_string(v, '$.{k}')) <> '' THEN json_extract_string(v, '$.{k}') END AS {k}" for k in ("command", "cmd", "script"))} FROM o)
SELECT event_id, coalesce(command, cmd, script, '') AS command FROM k""")
def input_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command in a call's input."""
    return table(spark, sf_dir, "events").select("event_id", text.command_of(pick(INPUTS, F.col("event_id"))).alias("command"))


VALUES = ["", " ", "{", "[1]", '{"b":1,"a":{"c":2}}', '"s"', "1", "-1.5", "true", "null", "nul", "{}"]


@query(f"""
WITH t AS (SELECT event_id, {picked(VALUES, "event_id")} AS v FROM events)
SELECT event_id, CASE WHEN trim(v) = '' THEN '' WHEN NOT json_valid(v) THEN 'invalid' ELSE CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind,
       CASE WHEN v LIKE '{{%}}' THEN list_aggregate(list_sort(json_keys(v)), 'string_agg', ',') END AS keys FROM t""")
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of JSON values, and the keys of objects."""
    v = pick(VALUES, F.col("event_id"))
    keys = text.json_keys(v)
    return table(spark, sf_dir, "events").select("event_id", text.json_type(v).alias("kind"), F.when(F.size(keys) > 0, F.array_join(keys, ",")).alias("keys"))


ZONES = ["Z", "+02:00", ".25Z", "-05:30", ".123456Z"]


@query(f"""
WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (1700000000 + event_id * 997)::VARCHAR WHEN 1 THEN concat(1700000000 + event_id * 997, '.25') WHEN 2 THEN 'at noon'
              ELSE concat('2026-01-', lpad((event_id % 28 + 1)::VARCHAR, 2, '0'), 'T', lpad((event_id % 24)::VARCHAR, 2, '0'), ':', lpad((event_id % 60)::VARCHAR, 2, '0'), ':07', {picked(ZONES, "event_id // 4")}) END AS v FROM events)
SELECT event_id, CASE WHEN contains(v, 'T') THEN epoch_us(TRY_CAST(v AS TIMESTAMPTZ)) ELSE round(TRY_CAST(v AS DOUBLE) * 1000000)::BIGINT END AS us FROM t""")
def record_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of records in seconds or RFC 3339."""
    two = lambda n: F.lpad((F.col("event_id") % n).cast("string"), 2, "0")
    seconds = (F.col("event_id") * 997 + 1_700_000_000).cast("string")
    rfc = F.concat(F.lit("2026-01-"), F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0"), F.lit("T"), two(24), F.lit(":"), two(60), F.lit(":07"), pick(ZONES, F.col("event_id") / 4))
    k = F.col("event_id") % 4
    v = F.when(k == 0, seconds).when(k == 1, F.concat(seconds, F.lit(".25"))).when(k == 2, "at noon").otherwise(rfc)
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(text.timestamp(v)).alias("us"))


PATHS = ["./a//b/", "a\\b\\c.go", ".", "/abs//x", "http://h/x", " 'q.py' ", "a/./b", "././x", "", "dir/", "\t\"s p.txt\"\n", "/", "../up"]
_REPO = r"""CASE WHEN {0} = '.' THEN '' ELSE regexp_replace(regexp_replace({0}, '/{{2,}}', '/', 'g'), '(.)/$', '\1') END"""


@query(rf"""
WITH t AS (SELECT event_id, {picked(PATHS, "event_id")} AS p FROM events),
     q AS (SELECT event_id, p, regexp_replace(replace(p, '\', '/'), '(^|/)(\./)+', '\1', 'g') AS r, trim(p, chr(32) || chr(9) || chr(13) || chr(10) || '"''') AS e FROM t),
     f AS (SELECT *, regexp_replace(replace(e, '\', '/'), '(^|/)(\./)+', '\1', 'g') AS s FROM q)
SELECT event_id, {_REPO.format("r")} AS repo_path, CASE WHEN e = '' OR contains(e, '://') THEN '' WHEN starts_with(e, '/') THEN e ELSE {_REPO.format("s")} END AS evidence_path FROM f""")
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as a repository and as evidence spell them."""
    p = pick(PATHS, F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", text.repo_path(p).alias("repo_path"), text.evidence_path(p).alias("evidence_path"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN CASE WHEN coalesce(text, '') <> '' THEN text || chr(10) ELSE '' END || 'i' ELSE '[oops' END AS content FROM conversations""")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of messages whose content is a string, an array of blocks or neither."""
    said, k = F.coalesce("text", F.lit("")), F.col("turn") % 3
    blocks = F.to_json(F.array(F.struct(said.alias("text"), F.lit(None).cast("string").alias("input_text")), F.struct(F.lit(None).cast("string").alias("text"), F.lit("i").alias("input_text"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_text(F.when(k == 0, said).when(k == 1, blocks).otherwise("[oops")).alias("content"))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'https://github.com/o/r' WHEN 1 THEN '' ELSE 'git@host:x' END AS remote, CASE WHEN c_custkey % 3 = 0 THEN 'c1' END AS base, c_custkey % 5 < 3 AS public FROM customer)
SELECT c_custkey, coalesce(remote <> '' AND base <> '' AND public, false) AS allowed FROM t""")
def raw_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a task's code may be kept as it is."""
    k = F.col("c_custkey")
    remote = F.when(k % 4 == 0, "https://github.com/o/r").when(k % 4 == 1, "").otherwise("git@host:x")
    return table(spark, sf_dir, "customer").select("c_custkey", classify.raw_code_allowed(remote, F.when(k % 3 == 0, "c1"), k % 5 < 3).alias("allowed"))
