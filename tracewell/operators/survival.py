"""Multisets of lines: how many of a session's added lines survive, per path and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import strip

DIFF_PATH = r"^\+\+\+ (?:b/)?([^\t\r]*)"


def lines_of(files: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, line): a row for each stripped non-empty line of each file without zero bytes."""
    text = files.where(~F.col(content).contains("\0")) if content in files.columns else files
    lines = text.select(*keys, F.explode(F.split(content, "\n")).alias("line")).withColumn("line", strip(F.col("line")))
    return lines.where("line <> ''")


def pending_lines(diff: DataFrame, untracked: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, line): the bag of a diff's added lines (keys, line) and of the lines of untracked files (keys, content)."""
    added = diff.select(*keys, strip(F.col("line")).alias("line")).where("line <> ''")
    return added.unionByName(lines_of(untracked, keys, content))


def wanted_rows(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys another table asks for; each once, however often it asks."""
    return rows.join(wanted.select(*keys), keys, "left_semi").select(rows.columns)


def count_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys, "line").agg(F.count("*").alias("n"))


def larger_of(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The union of two multisets (keys, line, n): of each line the larger count."""
    return a.unionByName(b).groupBy(*keys, "line").agg(F.max("n").alias("n"))


def survived(pending: DataFrame, index: DataFrame, keys: list[str], session: list[str]) -> DataFrame:
    """Per session: lines_added, lines_survived and keeprate.

    Each added line uses up one occurrence in the index, so a line counts as often as both sides
    have it.  Both sides are counted before they meet, so a very common line is one row each.
    """
    mine = pending.groupBy(*dict.fromkeys([*session, *keys]), "line").agg(F.count("*").alias("n"))
    theirs = index.withColumnRenamed("n", "there")
    met = mine.join(theirs, [*keys, "line"], "left")
    out = met.groupBy(*session).agg(
        F.sum("n").alias("lines_added"), F.sum(F.least("n", F.coalesce("there", F.lit(0)))).cast("long").alias("lines_survived")
    )
    rate = F.when(F.col("lines_added") > 0, F.col("lines_survived") / F.col("lines_added")).otherwise(0.0)
    return out.withColumn("keeprate", rate)


def resolved(scores: DataFrame, committed: DataFrame, session: list[str]) -> DataFrame:
    """survived() against the working tree, joined with that against HEAD, as one fact row a session."""
    head = committed.select(*session, F.col("lines_survived").alias("lines_committed"))
    out = scores.join(head, session, "left").withColumn("lines_committed", F.coalesce("lines_committed", F.lit(0)))
    return out.withColumn("committed", F.col("lines_committed") > 0)


def diff_added_lines(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, at, line): the added lines of unified diffs.

    A '+++ ' line names the file of the lines after it, and '/dev/null' none.  An added line whose
    own text begins with '++' reads as such a header, as in the diffs' format itself.  The path is
    carried forward by a window over each diff's own lines.
    """
    lines = F.split(text, "\n")
    header = F.col("line").startswith("+++ ")
    path = F.regexp_extract("line", DIFF_PATH, 1)
    rows = diffs.select(*keys, F.posexplode(lines).alias("at", "line"))
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.withColumn("path", F.last(F.when(header, F.when(path == "/dev/null", "").otherwise(path)), ignorenulls=True).over(before))
    added = F.col("line").startswith("+") & ~F.col("line").startswith("+++") & (F.coalesce("path", F.lit("")) != "")
    return named.where(added).select(*keys, "path", "at", F.substring("line", 2, 1 << 30).alias("line"))
