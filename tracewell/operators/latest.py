"""Latest row per key, feeds and per-model statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.scoring import round1

#: Rows of a feed by default and at most.
FEED_ROWS, MOST_FEED_ROWS = 50, 250


def latest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key's rows the greatest by the order columns, which have to decide.

    A partially aggregated max_by: what is shuffled is a row for each key and map task, and no
    key's rows are sorted.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(df.columns)


def feed(df: DataFrame, newest: list[Column], limit: int | None = None, **equal: str) -> DataFrame:
    """The newest rows, with optional equality filters; limit is 1 to 250, 50 if not given."""
    limit = FEED_ROWS if limit is None else limit
    if not 1 <= limit <= MOST_FEED_ROWS:
        raise ValueError(f"limit has to be from 1 to {MOST_FEED_ROWS}")
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    return df.orderBy(*newest).limit(limit)


def model_stats(latest: DataFrame, group: list[str], score: str, updated: str, tie: str) -> DataFrame:
    """Per group: submissions, average (to a tenth), best and latest score, and the latest time; ranked."""
    stats = latest.groupBy(*group).agg(
        F.count("*").alias("submissions"), F.avg(score).alias("average"), F.max(score).alias("best_score"),
        F.max_by(score, F.struct(updated, tie)).alias("latest_score"), F.max(updated).alias("latest_at"),
    )
    ranked = stats.withColumn("average_score", round1(F.col("average"))).drop("average")
    return ranked.orderBy(F.desc("average_score"), F.desc("submissions"), *reversed(group))
