"""Conversations: interleaved turns, titles and statements, reactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import classify, text

from .carry import seen_before

#: The order of kinds inside a turn.
KINDS = ["developer", "assistant", "tool_call", "tool_output"]


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1


def interleaved(turns: DataFrame, keys: list[str], turn: str = "turn_index", kind: str = "kind", seq: str = "seq", body: str = "text") -> DataFrame:
    """Turns in one stream per key: by turn, kind and sequence, without blank ones, cut in length and number."""
    rows = turns.where(text.strip(F.coalesce(body, F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(turn, kind_rank(F.col(kind)), seq))
    rows = rows.withColumn("place", place).where(F.col("place") <= text.MOST_TURNS)
    cut = F.when(F.col(kind) == "tool_output", text.truncated(F.col(body), text.OUTPUT_CHARS)).otherwise(text.truncated(F.col(body), text.TURN_CHARS))
    return rows.withColumn(body, cut)


def judged_turns(turns: DataFrame, keys: list[str]) -> DataFrame:
    """turns (keys, turn_index, role, seq, text) in the order a judge reads them, as (keys, turns): blank ones go.

    Of one turn index prompts come before assistants' messages, each in their own order.
    """
    at = F.struct("turn_index", (F.col("role") != "user").alias("late"), "seq")
    rows = turns.where(text.strip(F.coalesce("text", F.lit(""))) != "").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "role", "text"))).alias("t"))
    return rows.select(*keys, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def headlines(prompts: DataFrame, keys: list[str], order: str, body: str) -> DataFrame:
    """Per key: title, statement and number of follow-ups, from its developer prompts in order."""
    gathered = prompts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, body))).alias("_p"))
    texts = F.col(f"_p.{body}")
    return gathered.select(*keys, text.title(texts).alias("title"), text.statement(texts).alias("statement"), F.greatest(F.size("_p") - 1, F.lit(0)).alias("follow_ups"))


def reactions(messages: DataFrame, keys: list[str], order: list[str], role: str, body: str) -> DataFrame:
    """User messages with a column reaction: correction or acceptance, once an assistant has spoken."""
    rows = seen_before(messages, "_spoken", F.col(role) == "assistant", keys, order)
    rows = rows.where(F.col(role) == "user").withColumn("reaction", F.when(F.col("_spoken"), classify.reaction(F.col(body))))
    return rows.drop("_spoken")
