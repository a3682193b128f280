"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations.

Every source has a weight schedule over training time t in [0, 1], linear from a start to an
end factor.  Integrated and scaled to the source's target it is the source's cumulative token
demand; inverting it at the words a document's turn begins with gives that document's
training position, and documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE_CLASS, materialize

#: Fixed values of the mix: weights in turn by source order, share of all words, most repeats.
WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST_REPEATS = 2
#: Start and end factor of a source's schedule, in turn by source order.
SCHEDULES = ((1.0, 1.0), (0.5, 1.5), (1.5, 0.5))
#: Rows of a prefix-sum bucket, on average.
BUCKET_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words of a text, split at space and U+0009 to U+000D; null has none."""
    parts = F.split(text, SPACE_CLASS)
    empty = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.when(text.isNull(), 0).otherwise(F.size(parts) - empty).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, mix_words, target) from (source, source_size), one row a source.

    Water-filling in closed form: with sources in order of cap / weight, those up to some rank
    are at their cap and the others share what remains by weight.  The one window without keys
    sees a row for each source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    pick = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    caps = ranked.withColumn("weight", pick).withColumn("cap", F.col("source_size") * float(MOST_REPEATS))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.partitionBy(F.lit(0))
    levels = (
        caps.withColumn("filled", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything) * BUDGET)
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    )
    share = F.col("water") * F.col("weight")
    return levels.select(
        "source", "source_size", "rank", F.col("total").alias("mix_words"),
        F.when(F.col("water").isNull() | (share > F.col("cap")), F.col("cap")).otherwise(share).alias("target"),
    )


def invert_demand(u: Column, start: Column, end: Column) -> Column:
    """Time t at which a linear schedule from start to end has used the share u of its integral."""
    area = (start + end) / 2
    slope = end - start
    root = (F.sqrt(start * start + 2 * slope * area * u) - start) / slope
    return F.when(F.abs(slope) < 1e-12, u).otherwise(F.least(F.greatest(root, F.lit(0.0)), F.lit(1.0)))


def mix(docs: DataFrame, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, positions.

    A source's documents stand in seeded order and are gone through up to twice; a turn is taken
    if its middle word lies below the source's target, so a source misses its target by half
    a document at most.  positions has the training position, in words of the whole mix, of each
    turn taken.  Documents without words take part with size 0 and are never repeated.  Null
    sources are one source, the last.  Repeated rows each get their own turn.  The position in a
    source is a prefix sum over buckets of the seeded hash, then one inside the bucket, so a
    source with a third of all rows is still many tasks.  No rows: no rows.
    """
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("turn")
    )
    sized = materialize(sized, "mix-sizes")
    buckets = max(1, -(-sized.count() // bucket_rows))
    sized = sized.withColumn("bucket", F.shiftrightunsigned(F.col("turn"), 33).cast("long") * buckets / F.lit(float(1 << 31)))
    sized = sized.withColumn("bucket", F.floor("bucket").cast("int"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    plan = sums.join(targets, sums["source"].eqNullSafe(targets["source"])).select(
        sums["source"].alias("p_source"), sums["bucket"].alias("p_bucket"), "before", "source_size", "target", "rank", "mix_words"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    begun = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = begun.join(plan, begun["source"].eqNullSafe(plan["p_source"]) & (begun["bucket"] == plan["p_bucket"]))
    starts = [F.col("before") + F.col("inner") + k * F.col("source_size") for k in range(MOST_REPEATS)]

    def factor(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(s[i]) for s in SCHEDULES)), (F.col("rank") % len(SCHEDULES) + 1).cast("int"))

    turns = F.array(*(
        F.when(
            (s + F.col("size") / 2 <= F.col("target")) & ((F.col("size") > 0) | F.lit(k == 0)),
            invert_demand(F.least(s / F.greatest("target", F.lit(1.0)), F.lit(1.0)), factor(0), factor(1)) * F.col("mix_words"),
        )
        for k, s in enumerate(starts)
    ))
    return rows.withColumn("positions", F.array_compact(turns)).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions",
    )


def by_first_position(mixed: DataFrame) -> DataFrame:
    """mix()'s rows range-sorted by the position of their first turn, those never taken last."""
    first = mixed.withColumn("position", F.try_element_at("positions", F.lit(1)))
    keys = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return first.repartitionByRange(*keys).sortWithinPartitions(*keys)


def in_training_order(mixed: DataFrame) -> DataFrame:
    """A row for each turn of mix()'s documents with its position, range-sorted by position."""
    turns = mixed.withColumn("position", F.explode("positions")).drop("positions")
    return turns.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
