"""Task records from session facts: texts by kind, masked copies, publishable tasks, uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import classify, consent, hashing, redact, text

from .carry import ordinals

#: Kinds of facts that a record keeps, by the record's own name for them.
KEPT = {"user": "prompts", "assistant": "assistant_messages", "call": "tool_calls", "result": "tool_outputs"}


def texts_by_kind(facts: DataFrame) -> DataFrame:
    """Per session file: arrays of (turn_index, name, text, text_hash-less) by kind, tools, and counts.

    Turn indexes count from 0 within each kind.  A file's texts are one row, as a task record is.
    """
    rows = facts.where(F.col("kind").isin(list(KEPT)) & (text.strip(F.coalesce("body", F.lit(""))) != ""))
    rows = ordinals(rows, "turn_index", ["path", "kind"], ["offset", "place"])
    entry = F.struct("turn_index", F.coalesce("name", F.lit("")).alias("name"), F.col("body").alias("text"))
    gathered = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, entry))).alias(v) for k, v in KEPT.items()]
    tools = F.array_sort(F.array_remove(F.collect_set(F.when(F.col("kind") == "call", F.coalesce("name", F.lit("")))), "")).alias("tools")
    return rows.groupBy("path").agg(*gathered, tools)


def scrubbed_texts(facts: DataFrame, salt: bytes) -> DataFrame:
    """facts with text_hash, of the text as it was, and body scrubbed, with its redactions."""
    hashed = facts.withColumn("text_hash", hashing.salted(F.coalesce("body", F.lit("")), salt))
    return redact.scrub(hashed, "body")


def patches(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the added lines (path, at, line) as patch texts, tests apart, files in first-seen order."""
    role = F.when(classify.file_role(F.col("path")) == "test", "test_patch").otherwise("patch")
    per_file = lines.groupBy(*keys, "path").agg(F.min("at").alias("first"), F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: F.concat(F.lit("+"), x["line"]))).alias("body"))
    whole = per_file.withColumn("part", role).withColumn("text", F.concat(F.lit("+++ b/"), "path", F.lit("\n"), "body", F.lit("\n")))
    joined = lambda part: F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("first", "text")))), lambda x: x["text"])).alias(part)
    return whole.groupBy(*keys).agg(joined("patch"), joined("test_patch"))


def publishable(tasks: DataFrame) -> DataFrame:
    """tasks with task_id, is_public, problems and publish: only a reproducible, agreed task is published."""
    remote, commit = F.coalesce("remote_url", F.lit("")), F.coalesce("base_commit", F.lit(""))
    public = classify.is_public_remote(remote)
    has_patch = (F.coalesce("patch", F.lit("")) != "") | (F.coalesce("test_patch", F.lit("")) != "")
    problems = classify.reproducibility_problems({
        "remote": remote, "is_public": public, "base_commit": commit, "prompts": F.size("prompts"), "has_patch": has_patch,
        "base_from_start": F.coalesce("base_from_start", F.lit(False)), "files_touched": F.coalesce("files_touched", F.lit(0)),
    })
    first = F.coalesce(F.try_element_at("prompts", F.lit(1)), F.lit(""))
    agreed = ~has_patch | classify.permits_redistribution(F.col("licence")) | F.coalesce("agreed", F.lit(False))
    return tasks.withColumns({"task_id": hashing.corpus_task_id(remote, commit, first), "is_public": public, "problems": problems}).withColumn("publish", (F.size("problems") == 0) & agreed)


def purge(stored: DataFrame, most: str, repository: str | None = None) -> DataFrame:
    """Stored records with no tier over the given one, of one repository or all."""
    mine = F.lit(True) if repository is None else F.col("remote_url") == repository
    lowered = stored.withColumn("tier", F.when(mine, consent.tier_of(F.least(consent.rank(F.col("tier")), consent.rank(F.lit(most))))).otherwise(F.col("tier")))
    return consent.project(lowered)


def newest_transcript(files: DataFrame, key: str = "repository") -> DataFrame:
    """Per repository the file changed last, the greater path on ties."""
    return files.groupBy(key).agg(F.max(F.struct("changed_at", "path")).alias("f")).select(key, "f.path", "f.changed_at")


def upload_batches(files: DataFrame, size: int = 10) -> DataFrame:
    """Files in upload order - repository, newest first, path - with their batch inside the repository."""
    order = Window.partitionBy("repository").orderBy(F.desc("changed_at"), "path")
    return files.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def upload_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("repository").agg(F.count("*").alias("files"), F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"))


def chosen(files: DataFrame, selection: str) -> DataFrame:
    """The files whose number, from 1, a selection such as '1,3-5' or 'all' names; 'q' and '' name none."""
    wanted = selection.strip().lower()
    if wanted == "all":
        return files
    if wanted in ("", "q"):
        return files.limit(0)
    spans = []
    for part in wanted.split(","):
        low, _, high = part.strip().partition("-")
        if not low.isdigit() or (high and not high.isdigit()) or (high and int(high) < int(low)) or int(low) < 1:
            raise ValueError(f"not a selection: {part!r}")
        spans.append(F.col("number").between(int(low), int(high or low)))
    return files.where(classify.any_of(spans))


def not_chosen(files: DataFrame, selection: str) -> DataFrame:
    """The files whose number a selection doesn't name."""
    return files.join(chosen(files, selection).select("number"), "number", "left_anti").select(files.columns)


def lockfile_hashes(files: DataFrame, keys: list[str], salt: bytes) -> DataFrame:
    """(keys, lockfiles): of files (keys, name, content) a map from the known lockfiles' names to their salted hashes; a repository has few of them."""
    known = files.where(F.col("name").isin(classify.HASHED_LOCKFILES) & (F.coalesce("content", F.lit("")) != ""))
    entries = F.sort_array(F.collect_set(F.struct("name", hashing.salted(F.col("content"), salt).alias("hash"))))
    return known.groupBy(*keys).agg(F.map_from_entries(entries).alias("lockfiles"))


def corpus_path(task_id: Column) -> Column:
    """Where a published task is stored."""
    digits = F.regexp_replace(task_id, "^sha256:", "")
    return F.concat(F.lit("tasks/sha256/"), F.substring(digits, 1, 2), F.lit("/"), digits, F.lit(".json"))


def scorecard(axes: Column) -> Column:
    """The axes (name, present, score, detail) that are present."""
    return F.filter(axes, lambda a: a["present"])


def scorecard_summary(axes: Column, note: Column) -> Column:
    """Details of success, efficiency and autonomy in that order, else the note."""
    details = []
    for name in ("success", "efficiency", "autonomy"):
        hit = F.filter(axes, lambda a: a["present"] & (a["name"] == name) & (text.strip(a["detail"]) != ""))  # noqa: B023
        details.append(text.strip(F.try_element_at(hit, F.lit(-1))["detail"]))
    joined = F.concat_ws("; ", *details)
    return F.when(joined != "", joined).otherwise(text.strip(F.coalesce(note, F.lit(""))))


def outcome_summary(verification: Column, landed: Column, termination: Column, corrections: Column) -> Column:
    return F.concat_ws(
        " · ", F.when(verification == "passed", "tests passed").when(verification == "failed", "tests failed").otherwise("no tests run"), F.when(landed, "changes landed"),
        F.when(termination == "clean", "clean finish").when(termination == "abandoned", "abandoned"), F.when(corrections > 0, F.format_string("%d correction(s)", corrections)),
    )


def score_bar(score: Column) -> Column:
    """Ten cells, filled by the score's tenth part."""
    n = F.least(F.greatest(F.floor(score / 10 + 0.5), F.lit(0)), F.lit(10)).cast("int")
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(10) - n))


def toolchain(base: Column, override: Column) -> Column:
    """Two maps as one, the second's values before the first's."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k)), override)


def files_by_hash(files: DataFrame, keys: list[str], salt: bytes) -> DataFrame:
    """(keys, files): of rows (keys, path) each path once, as structs (path_hash, path, role) in order of the salted hash.

    Null and empty paths are left out, and keys without others have no row.  A task names few files, which meet in one row.
    """
    named = files.where(F.coalesce("path", F.lit("")) != "").select(*keys, "path").distinct()
    entry = F.struct(hashing.salted(F.col("path"), salt).alias("path_hash"), "path", classify.file_role(F.col("path")).alias("role"))
    return named.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("files"))
