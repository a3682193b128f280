"""Queries over documents, labels and pages: redaction, hashes, lines, scores, consent, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import classify, consent, hashing, redact, scoring, text
from tracewell.functions.regex import re2
from tracewell.operators import jobs, survival

from .redaction_sql import REDACT_COUNTS_SQL, REDACT_HASH_SQL
from .registry import query, table

SALT = b"0123456789abcdef0123456789abcdef"
IPAD, OPAD = (bytes(b ^ k for b in SALT.ljust(64, b"\0")).hex() for k in (0x36, 0x5C))


@query(REDACT_COUNTS_SQL)
def redact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each redaction category in each document."""
    done = redact.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [*redact.categories(), redact.ENTROPY_CATEGORY]
    number = lambda k: F.coalesce(F.try_element_at("redactions.by_category", F.lit(k)), F.lit(0)).alias(k.replace(".", "_"))
    return done.select("doc_id", F.col("redactions.spans").alias("spans"), *map(number, kinds))


@query(REDACT_HASH_SQL)
def redact_text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of each document's scrubbed text."""
    return redact.scrub(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.sha2("text", 256).alias("sha256"))


@query(r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9+/]{16,}={0,2}\b')) AS token FROM documents),
     k AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY 1, 2),
     c AS (SELECT doc_id, token, n, unnest(string_split(token, '')) AS ch FROM k),
     p AS (SELECT doc_id, token, n, count(*)::DOUBLE / length(token) AS p FROM c GROUP BY doc_id, token, n, ch)
SELECT doc_id, token, n, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id, token, n""")
def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long base64-like tokens of documents with their entropy."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(re2(redact.ENTROPY_TOKEN)), F.lit(0))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n")).withColumn("entropy", F.round(redact.entropy(F.col("token")), 6))


@query(f"""SELECT doc_id, CASE WHEN text = '' THEN '' ELSE 'sha256:' || sha256(unhex('{OPAD}' || sha256(unhex('{IPAD}' || hex(encode(text)))))) END AS text_hash FROM documents""")
def hmac_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed hashes of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", hashing.salted(F.col("text"), SALT).alias("text_hash"))


@query("""
SELECT doc_id, 'sha256:' || sha256(encode(source) || unhex('00') || encode(lang) || unhex('00') || encode(text)) AS task_id,
       'task-' || sha256(encode(source) || unhex('00') || encode(lang) || unhex('00') || encode(text))[1:16] AS short_id FROM documents""")
def task_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishable identifiers from three fields."""
    whole = hashing.corpus_task_id(F.col("source"), F.col("lang"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", whole.alias("task_id"), hashing.short_task_id(whole).alias("short_id"))


@query("""
WITH l AS (SELECT doc_id, lower(text) AS t FROM documents),
     s AS (SELECT doc_id, CASE WHEN t LIKE '%apache license%' AND t LIKE '%version 2.0%' THEN 'Apache-2.0' WHEN t LIKE '%mit license%' THEN 'MIT' WHEN t LIKE '%bsd 2-clause%' THEN 'BSD-2-Clause'
       WHEN t LIKE '%bsd 3-clause%' THEN 'BSD-3-Clause' WHEN t LIKE '%isc license%' THEN 'ISC' WHEN t LIKE '%the unlicense%' THEN 'Unlicense' WHEN t LIKE '%0bsd%' THEN '0BSD'
       WHEN t LIKE '%gnu general public license%' AND t LIKE '%affero%' THEN 'AGPL-3.0' WHEN t LIKE '%gnu general public license%' THEN 'GPL-3.0' WHEN t LIKE '%mozilla public license%' THEN 'MPL-2.0' ELSE '' END AS spdx FROM l)
SELECT doc_id, spdx, spdx IN ('MIT', 'BSD-2-Clause', 'BSD-3-Clause', 'Apache-2.0', 'ISC', 'Unlicense', '0BSD') AS permissive FROM s""")
def license_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences by their texts, and which of them are permissive."""
    spdx = classify.licence(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", spdx.alias("spdx"), classify.permits_redistribution(spdx).alias("permissive"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INTEGER AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White-space separated words."""
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("SELECT doc_id, md5(translate(lower(text), ' -_./:=+''\"`' || chr(9) || chr(10) || chr(13), '')) AS normal FROM documents")
def leak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts normalized for the leak check, as hashes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redact.leak_normal(F.col("text"))).alias("normal"))


LINES_SQL = r"SELECT doc_id, source, trim(line, E' \t\r') AS line FROM (SELECT doc_id, source, unnest(string_split(text, E'\n')) AS line FROM documents) q WHERE trim(line, E' \t\r') <> ''"


@query(f"""
WITH l AS ({LINES_SQL}),
     p AS (SELECT doc_id, lang, line, count(*) AS n FROM (SELECT l.doc_id, d.lang, l.line FROM l JOIN documents d ON l.doc_id = d.doc_id) q GROUP BY 1, 2, 3),
     s AS (SELECT d.lang, l.line, l.source, count(*) AS n FROM l JOIN documents d ON l.doc_id = d.doc_id WHERE l.source IN ('src1', 'src2') GROUP BY 1, 2, 3),
     i AS (SELECT lang, line, max(n) AS n FROM s GROUP BY 1, 2)
SELECT p.doc_id, sum(p.n)::BIGINT AS lines_added, sum(least(p.n, coalesce(i.n, 0)))::BIGINT AS lines_survived, sum(least(p.n, coalesce(i.n, 0))) / sum(p.n) AS keeprate
FROM p LEFT JOIN i ON p.lang = i.lang AND p.line = i.line GROUP BY p.doc_id""")
def multiset_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each document's lines stand in an index, counted with their multiplicity.

    The index is the larger count of two sources' lines, as of a working tree and its last commit.
    """
    lines = survival.lines_of(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"], "text")
    one, two = (survival.count_lines(lines.where(F.col("source") == s), ["lang"]) for s in ("src1", "src2"))
    return survival.survived(lines, survival.larger_of(one, two, ["lang"]), ["lang"], ["doc_id"])


@query("SELECT doc_id, source, n_chars FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND l.toxic = 0)")
def wanted_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that another table asks for."""
    wanted = table(spark, sf_dir, "labels").where("toxic = 0").select("doc_id")
    return survival.wanted_rows(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), wanted, ["doc_id"])


@query("SELECT sha256(text) AS payload, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def payload_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each payload hash."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("payload"), "doc_id", "source")
    return jobs.first_per_payload(rows, "payload", ["doc_id"])


@query("""
SELECT sha256(text) AS payload, min(doc_id) AS doc_id FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY 1""")
def idempotent_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New payloads that a table doesn't have yet, one row each."""
    rows = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("payload"), "doc_id", "source")
    there, new = rows.where("source = 'src0'"), rows.where("source <> 'src0'").select("payload", "doc_id")
    return jobs.insert_new(there, new, "payload", ["doc_id"])


SIGNALS_SQL = """
SELECT d.doc_id, CASE d.n_chars % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE '' END AS v, d.n_chars % 2 = 0 AS vae, l.quality = 1 AS landed,
       CASE WHEN d.n_chars % 5 = 0 THEN NULL ELSE l.toxic = 0 END AS t, (d.n_chars % 4)::INTEGER AS edits, (d.n_chars % 7)::INTEGER AS corr, (d.n_chars % 6)::INTEGER AS intr,
       (d.n_chars % 8)::INTEGER AS rework, (d.n_chars % 2)::INTEGER AS acc, (d.n_chars % 40)::INTEGER AS calls, (d.n_chars % 11)::INTEGER AS errs, (d.n_chars % 30)::INTEGER AS turns,
       CASE WHEN d.n_chars % 3 = 1 THEN (d.n_chars % 101)::DOUBLE END AS judged, (d.n_chars % 500) / 100.0::DOUBLE AS cost
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of made-up sessions, one for each labelled document."""
    n = F.col("n_chars")
    rest = lambda k: (n % k).cast("int")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        "doc_id", F.when(n % 3 == 0, "passed").when(n % 3 == 1, "failed").otherwise("").alias("verification"), (n % 2 == 0).alias("verified_after_edit"), (F.col("quality") == 1).alias("landed"),
        F.when(n % 5 != 0, F.col("toxic") == 0).alias("terminated"), rest(4).alias("edits"), rest(7).alias("corrections"), rest(6).alias("interruptions"), rest(8).alias("rework"), rest(2).alias("acceptances"),
        rest(40).alias("tool_calls"), rest(11).alias("tool_errors"), rest(30).alias("turns"), F.when(n % 3 == 1, (n % 101).cast("double")).alias("judged"), ((n % 500) / 100.0).alias("cost"),
    )


def _r1(x: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * 10 + 0.5) / 10)"


UTILITY_SQL = f"""
WITH s AS ({SIGNALS_SQL}),
     g AS (SELECT *, -0.35::DOUBLE + (CASE v WHEN 'passed' THEN 1.7 WHEN 'failed' THEN -2.0 ELSE 0.0 END)::DOUBLE + (CASE WHEN vae THEN 0.7 ELSE 0.0 END)::DOUBLE + (CASE WHEN landed THEN 1.1 ELSE 0.0 END)::DOUBLE
           + (CASE WHEN t IS NULL THEN 0.0 WHEN t THEN 0.4 ELSE -1.5 END)::DOUBLE + (CASE WHEN edits > 0 THEN 0.25 ELSE 0.0 END)::DOUBLE - 0.35::DOUBLE * least(corr, 5) - 0.2::DOUBLE * least(intr, 4)
           - 0.2::DOUBLE * least(rework, 5) + (CASE WHEN acc > 0 THEN 0.8 ELSE 0.0 END)::DOUBLE - (CASE WHEN calls > 0 AND errs > 0 THEN 1.2::DOUBLE * least(errs::DOUBLE / calls, 1.0) ELSE 0.0 END)
           - 0.055::DOUBLE * least(greatest(turns - 8, 0), 16) AS logit FROM s),
     u AS (SELECT *, {_r1("(100 * (1 / (1 + exp(-logit))))")} AS base FROM g),
     d AS (SELECT *, greatest(least(CASE v WHEN 'passed' THEN 85.0 WHEN 'failed' THEN 30.0 ELSE 55.0 END + (CASE WHEN landed THEN 10.0 ELSE 0.0 END) - (CASE WHEN NOT t THEN 25.0 ELSE 0.0 END), 100.0), 0.0)::DOUBLE AS det FROM u)
SELECT doc_id, base AS deterministic, {_r1("logit")} AS logit,
       CASE WHEN judged IS NULL THEN base ELSE greatest(least({_r1(f"(base + {_r1('greatest(least((judged - base) * 0.25, 12.0), -12.0)')})")}, 100.0), 0.0) END AS utility,
       CASE WHEN v <> '' OR landed OR t IS NOT NULL THEN greatest(least({_r1(f"(CASE WHEN judged IS NULL THEN det ELSE det + {_r1('greatest(least((judged - det) * 0.25, 12.0), -12.0)')} END)")}, 100.0), 0.0)
            WHEN judged IS NOT NULL THEN judged END AS success,
       {_r1("(100 * (1.0 / (1.0 + cost) + 20.0 / (20.0 + calls)) / 2)")} AS efficiency, {_r1("(100 * (1 - CASE WHEN calls > 0 THEN least(errs::DOUBLE / calls, 1.0) ELSE 0.0 END))")} AS autonomy,
       {_r1("(100 * (8.0 / (8.0 + turns)))")} AS friction,
       CASE WHEN v <> '' AND (landed OR corr > 0 OR acc > 0 OR intr > 0 OR t IS NOT NULL) THEN 'high' WHEN v <> '' OR landed OR t IS NOT NULL OR corr > 0 OR acc > 0 OR intr > 0 OR judged IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence
FROM d"""


@query(UTILITY_SQL)
def utility_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the made-up sessions."""
    rows = signals(spark, sf_dir)
    s = {c: F.col(c) for c in rows.columns}
    return rows.select(
        "doc_id", scoring.deterministic_utility(s).alias("deterministic"), scoring.round1(scoring.utility_logit(s)).alias("logit"), scoring.utility(s, s["judged"]).alias("utility"),
        scoring.success(s["verification"], s["landed"], s["terminated"], s["judged"]).alias("success"), scoring.efficiency(s["cost"], s["tool_calls"]).alias("efficiency"),
        scoring.autonomy(s["tool_errors"], s["tool_calls"]).alias("autonomy"), scoring.friction(s["turns"]).alias("friction"), scoring.utility_confidence(s, s["judged"]).alias("confidence"),
    )


@query()
def utility_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utility's terms as text, and the success axis in words."""
    rows = signals(spark, sf_dir)
    s = {c: F.col(c) for c in rows.columns}
    detail = scoring.success_detail(s["verification"], s["landed"], s["terminated"], s["judged"], F.lit(""))
    return rows.select("doc_id", F.array_join(scoring.utility_evidence(s), "; ").alias("evidence"), detail.alias("detail"))


@query(f"""
WITH v AS (SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'accepted' WHEN toxic = 1 THEN 'abandoned' ELSE 'corrected' END AS outcome, (doc_id % 5)::INTEGER AS c, ((doc_id % 9) - 4) / 4.0::DOUBLE AS s FROM labels)
SELECT doc_id, greatest(least({_r1("((CASE outcome WHEN 'accepted' THEN 100.0 WHEN 'corrected' THEN 60.0 ELSE 15.0 END)::DOUBLE - 8 * c::DOUBLE + 10 * s)")}, 100.0), 0.0) AS score FROM v""")
def verdict_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts as scores."""
    outcome = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "accepted").when(F.col("toxic") == 1, "abandoned").otherwise("corrected")
    score = scoring.verdict_score(outcome, (F.col("doc_id") % 5).cast("int"), ((F.col("doc_id") % 9) - 4) / 4.0)
    return table(spark, sf_dir, "labels").select("doc_id", score.alias("score"))


@query("""
WITH t AS (SELECT d.*, ['hashes_only', 'prompts', 'actions', 'code', 'full', 'unheard of'][(d.doc_id % 6 + 1)::INTEGER] AS asked FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
     r AS (SELECT *, CASE WHEN asked = 'unheard of' THEN 0 ELSE doc_id % 6 END AS k FROM t)
SELECT doc_id, CASE WHEN k = 0 THEN 'hashes_only' ELSE asked END AS tier, sha256(text) AS text_sha256, CASE WHEN k >= 1 THEN lang ELSE '' END AS prompt1, CASE WHEN k >= 1 THEN source ELSE '' END AS prompt2,
       CASE WHEN k >= 2 THEN source ELSE '' END AS assistant_text, CASE WHEN k >= 3 THEN length(text) ELSE 0 END AS patch_chars, CASE WHEN k >= 3 THEN source ELSE '' END AS remote_url, CASE WHEN k >= 4 THEN lang ELSE '' END AS session_id
FROM r""")
def consent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records masked by tier; hashes stay."""
    tiers = F.array(*map(F.lit, [*consent.TIERS, "unheard of"]))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(
        "doc_id", F.element_at(tiers, (F.col("doc_id") % 6 + 1).cast("int")).alias("tier"), F.sha2("text", 256).alias("text_sha256"), F.array("lang", "source").alias("prompts"),
        F.col("source").alias("assistant_text"), F.col("text").alias("patch"), F.col("source").alias("remote_url"), F.col("lang").alias("session_id"),
    )
    return consent.project(rows).select(
        "doc_id", "tier", "text_sha256", F.get("prompts", F.lit(0)).alias("prompt1"), F.get("prompts", F.lit(1)).alias("prompt2"), "assistant_text", F.length("patch").cast("long").alias("patch_chars"), "remote_url", "session_id"
    )


PATH_SQL = r"regexp_replace(url, '^https?://', '')"


@query(rf"""
WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/abs' WHEN 1 THEN 'go.sum' WHEN 2 THEN 'a/tests/x.py' WHEN 3 THEN '../up' WHEN 4 THEN '.github/w.txt' WHEN 5 THEN 'conf/a.YAML' ELSE {PATH_SQL} END AS path FROM pages)
SELECT page_id, CASE WHEN page_id % 7 IN (0, 3) THEN 'unknown' WHEN page_id % 7 = 1 THEN 'lockfile' WHEN page_id % 7 = 2 THEN 'test' WHEN page_id % 7 IN (4, 5) THEN 'config'
       WHEN regexp_matches(lower(path), '\.(toml|yaml|yml)/?$') THEN 'config' WHEN regexp_matches(lower(path), '(^|/)(test|tests|spec)/') THEN 'test' ELSE 'solution' END AS role FROM p""")
def file_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of paths, some of them made up."""
    k = F.col("page_id") % 7
    path = F.when(k == 0, "/abs").when(k == 1, "go.sum").when(k == 2, "a/tests/x.py").when(k == 3, "../up").when(k == 4, ".github/w.txt").when(k == 5, "conf/a.YAML").otherwise(F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", classify.file_role(path).alias("role"))


@query(r"""
WITH r AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'git@github.com:team/' || page_id || '.git' ELSE 'https://me@gitlab.com:443/a/b.git' END AS remote FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(remote, '^https?://([^/:]*)', 1) WHEN 1 THEN 'github.com' ELSE 'gitlab.com' END AS host, page_id % 3 <> 0 AS is_public,
       CASE page_id % 3 WHEN 0 THEN remote WHEN 1 THEN 'team/' || page_id ELSE 'https://me@gitlab.com:443/a/b' END AS name FROM r""")
def remote_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, publicity and names of remotes."""
    k = F.col("page_id") % 3
    remote = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("git@github.com:team/"), "page_id", F.lit(".git"))).otherwise("https://me@gitlab.com:443/a/b.git")
    return table(spark, sf_dir, "pages").select("page_id", classify.remote_host(remote).alias("host"), classify.is_public_remote(remote).alias("is_public"), classify.public_repo_name(remote).alias("name"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM documents)
SELECT doc_id, 'src/' || doc_id || '.txt' AS path, i::INTEGER AS at, line FROM l WHERE NOT starts_with(line, '++')""")
def diff_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added lines of diffs made of documents' lines."""
    head = F.concat(F.lit("+++ b/src/"), F.col("doc_id").cast("string"), F.lit(".txt\n"))
    body = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("+"), x)), "\n")
    diffs = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, body).alias("diff"))
    return survival.diff_added_lines(diffs, ["doc_id"], "diff")


@query("""
SELECT d.doc_id, array_to_string(list_filter([
  CASE WHEN d.doc_id % 2 = 0 THEN 'no git remote (origin) — nothing to clone' END,
  CASE WHEN l.quality = 0 THEN 'remote is not a recognized public host (github.com / gitlab.com / codeberg.org)' END,
  CASE WHEN d.doc_id % 3 = 0 THEN 'no base commit — the starting state is unknown' END,
  CASE WHEN d.n_chars < 500 THEN 'no developer prompt — there is no task statement' END,
  CASE WHEN l.toxic = 1 AND d.doc_id % 5 <> 0 THEN 'no code patch and base commit was not inferred from the transcript start' END,
  CASE WHEN l.toxic = 1 AND d.n_chars % 4 = 0 THEN 'no code patch and no transcript edit evidence' END], lambda x: x IS NOT NULL), '; ') AS problems
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def reproducibility_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why made-up tasks can't be reproduced."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    found = classify.reproducibility_problems({
        "remote": F.when(F.col("doc_id") % 2 == 0, "").otherwise("x"), "is_public": F.col("quality") != 0, "base_commit": F.when(F.col("doc_id") % 3 == 0, "").otherwise("c"), "prompts": F.when(F.col("n_chars") < 500, 0).otherwise(1),
        "has_patch": F.col("toxic") != 1, "base_from_start": F.col("doc_id") % 5 == 0, "files_touched": F.col("n_chars") % 4,
    })
    return rows.select("doc_id", F.array_join(found, "; ").alias("problems"))
