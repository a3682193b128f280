"""Consent tiers, the categories they open, and masking of a record by tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tiers from least to most open, categories in order, and how many of them a tier opens.
TIERS = ["hashes_only", "prompts", "actions", "code", "full"]
CATEGORIES = ["starting_prompt", "all_prompts", "assistant_msgs", "tool_calls", "tool_outputs", "code_diffs", "repo_linkage", "full_transcript"]
OPENED = [0, 2, 5, 7, 8]
#: How a settings file spells yes and no.
YES, NO = ["true", "1", "yes", "on"], ["false", "0", "no", "off"]


def rank(tier: Column) -> Column:
    """A tier's place; missing ones and those not spelled so are the least open."""
    out = F.lit(0)
    for k, name in enumerate(TIERS):
        out = F.when(tier == name, k).otherwise(out)
    return out


def tier_of(rank_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), (rank_ + 1).cast("int"))


def opened(tier: Column) -> Column:
    """The categories a tier opens, in order."""
    n = F.element_at(F.array(*map(F.lit, OPENED)), (rank(tier) + 1).cast("int"))
    return F.slice(F.array(*map(F.lit, CATEGORIES)), F.lit(1), n)


def most_recorded(grants: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tier): the most open tier among recorded grants (keys, tier)."""
    return grants.groupBy(*keys).agg(tier_of(F.max(rank(F.col("tier")))).alias("tier"))


def in_order(categories: Column) -> Column:
    """The known categories of a list, each once, in their fixed order."""
    return F.array_intersect(F.array(*map(F.lit, CATEGORIES)), categories)


def required_tier(category: Column) -> Column:
    """The least tier that opens a category."""
    out = F.lit(TIERS[-1])
    for k in range(len(TIERS) - 1, -1, -1):
        out = F.when(category.isin(CATEGORIES[: OPENED[k]]), TIERS[k]).otherwise(out) if OPENED[k] else out
    return out


def effective(recorded_max: Column, *wanted: Column) -> Column:
    """The last tier given of global, repository, environment and flag, not over the most recorded one."""
    asked = F.coalesce(*(F.nullif(w, F.lit("")) for w in reversed(wanted)), F.lit(TIERS[0]))
    return tier_of(F.least(rank(asked), rank(recorded_max)))


def settings(lines: DataFrame, owner: str, at: str, line: str) -> DataFrame:
    """(owner, tier, repo_tiers, categories, declined, malformed) of each owner's settings file, given as its lines in order of at.

    Lines are key = value: tier, repo.<hash>.tier, category.<name> and declined; empty lines, remarks (#), lines without =
    and other keys say nothing.  A file is malformed from its first line that gives an unknown tier, category or
    yes or no, the tier a second time, or another value for a repository or category than before: then it grants
    nothing, and declined is what the lines before that one say.  Owners without lines have no row; a null line says nothing.
    One shuffle by owner; an owner's lines are one file.
    """
    text = F.btrim(F.col(line), F.lit(_BLANK))
    rows = lines.select(F.col(owner).alias("owner"), F.col(at).alias("at"), text.alias("line")).repartition("owner")
    cut = F.instr("line", "=")
    told = (cut > 0) & ~F.col("line").startswith("#")
    key, value = F.btrim(F.substring("line", F.lit(1), cut - 1), F.lit(_BLANK)), F.btrim(F.substring("line", cut + 1, F.length("line")), F.lit(_BLANK))
    rows = rows.withColumns({"key": F.when(told, key), "value": F.when(told, value)})
    repo = F.col("key").startswith("repo.") & F.col("key").endswith(".tier")
    category = F.col("key").startswith("category.")
    kind = F.when(F.col("key").isin("tier", "declined"), F.col("key")).when(repo, "repo").when(category, "category")
    name = F.when(repo, F.regexp_replace(F.regexp_replace("key", r"^repo\.", ""), r"\.tier\z", "")).when(category, F.regexp_replace("key", r"^category\.", ""))
    yes = F.when(F.lower("value").isin(YES), True).when(F.lower("value").isin(NO), False)
    rows = rows.withColumns({"kind": kind, "name": name, "yes": yes})
    before = Window.partitionBy("owner", "kind", "name").orderBy("at")
    known = F.col("value").isin(TIERS)
    bad = (
        F.when(F.col("kind") == "tier", ~known | (F.row_number().over(before) > 1))
        .when(F.col("kind") == "repo", (F.col("name") == "") | ~known | F.coalesce(F.lag("value").over(before) != F.col("value"), F.lit(False)))
        .when(F.col("kind") == "category", ~F.col("name").isin(CATEGORIES) | F.col("yes").isNull() | F.coalesce(F.lag("yes").over(before) != F.col("yes"), F.lit(False)))
        .when(F.col("kind") == "declined", F.col("yes").isNull()).otherwise(False)
    )
    rows = rows.withColumn("bad", bad)
    rows = rows.withColumn("broken_at", F.min(F.when(F.col("bad"), F.col("at"))).over(Window.partitionBy("owner")))
    good = F.col("broken_at").isNull()
    pairs = F.array_distinct(F.collect_list(F.when(good & (F.col("kind") == "repo"), F.struct("name", "value"))))
    said = (F.col("kind") == "declined") & (good | (F.col("at") < F.col("broken_at")))
    return rows.groupBy("owner").agg(
        F.coalesce(F.max(F.when(good & (F.col("kind") == "tier"), F.col("value"))), F.lit(TIERS[0])).alias("tier"), F.map_from_entries(pairs).alias("repo_tiers"),
        in_order(F.collect_set(F.when(good & (F.col("kind") == "category") & F.col("yes"), F.col("name")))).alias("categories"),
        F.coalesce(F.max_by("yes", F.when(said, F.col("at"))), F.lit(False)).alias("declined"), F.max("bad").alias("malformed"),
    ).withColumnRenamed("owner", owner)


#: White space that a settings file's lines, keys and values are stripped of.
_BLANK = " \t\n\x0b\f\r\x85\xa0"


def granted(tier: Column, repo_tiers: Column, categories: Column, most: Column, repository: Column, environment: Column, flag: Column) -> Column:
    """Struct of the tier in force and the categories it opens, of a row of settings().

    The tier is the flag's, else the environment's, else the repository's, else the file's, not over the
    most recorded one; categories asked for are added as far as the most recorded tier would open them.
    """
    asked = F.coalesce(flag, F.nullif(environment, F.lit("")), F.try_element_at(repo_tiers, F.nullif(repository, F.lit(""))), tier)
    now = tier_of(F.least(rank(asked), rank(most)))
    extra = F.filter(categories, lambda c: rank(required_tier(c)) <= rank(most))
    return F.struct(now.alias("tier"), in_order(F.concat(opened(now), extra)).alias("categories"))


def shown(column: Column, category: str, allowed: Column) -> Column:
    """A text column blanked unless its category, or the full transcript, is open."""
    return F.when(F.array_contains(allowed, category) | F.array_contains(allowed, "full_transcript"), column).otherwise(F.lit(""))


#: The tasks table's columns by the category that shows them.
MASKED = {
    "assistant_text": "assistant_msgs", "tool_call_text": "tool_calls", "tool_output_text": "tool_outputs", "patch": "code_diffs", "test_patch": "code_diffs",
    "remote_url": "repo_linkage", "base_commit": "repo_linkage", "branch": "repo_linkage", "licence": "repo_linkage", "session_id": "full_transcript",
}


def project(tasks: DataFrame, tier: str = "tier") -> DataFrame:
    """tasks masked by each row's tier: texts and repository fields are blanked, hashes always stay.

    prompts is an array of texts of which the first needs less consent than the others; of the other
    columns those in MASKED are masked as far as the table has them.
    """
    allowed = opened(F.col(tier))
    whole = F.array_contains(allowed, "all_prompts") | F.array_contains(allowed, "full_transcript")
    first = F.array_contains(allowed, "starting_prompt") | whole
    columns = {c: shown(F.col(c), k, allowed) for c, k in MASKED.items() if c in tasks.columns}
    if "prompts" in tasks.columns:
        columns["prompts"] = F.transform("prompts", lambda p, i: F.when(whole | (first & (i == 0)), p).otherwise(F.lit("")))
    return tasks.withColumns(columns).withColumn(tier, tier_of(rank(F.col(tier))))
