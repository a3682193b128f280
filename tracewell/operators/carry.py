"""Operators with state along an order: forward fill, running flags, held tokens, pending calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_fill(df: DataFrame, columns: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """Each column replaced by its latest non-empty value up to and with the row."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    empty = {c: F.nullif(F.col(c), F.lit("")) if t == "string" else F.col(c) for c, t in df.dtypes if c in columns}
    return df.withColumns({c: F.last(v, ignorenulls=True).over(upto) for c, v in empty.items()})


def seen_before(df: DataFrame, name: str, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """df with a column: whether the flag held on any earlier row of the key."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.max(flag).over(before), F.lit(False)))


def ordinals(df: DataFrame, name: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with each row's place, from 0, among those of its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def held_tokens(df: DataFrame, holder: Column, boundary: Column, tokens: Column | dict[str, Column], keys: list[str], order: list[str]) -> DataFrame:
    """(keys, order, seq of the holder, tokens): token counts summed on the holder they belong to, under the names given.

    A count goes to the last holder before it unless a boundary came since; then to the next
    holder, and nowhere if none follows.  A boundary is a row that lets go of what is held; a holder
    lets go of the holder before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    amounts = tokens if isinstance(tokens, dict) else {"tokens": tokens}
    counted = F.array_compact(F.array(*amounts.values()))
    rows = df.select(*keys, *order, holder.alias("_holder"), boundary.alias("_boundary"), F.when(F.size(counted) > 0, F.struct(*(c.alias(n) for n, c in amounts.items()))).alias("_tokens")).withColumn("_seq", F.row_number().over(w))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_last": F.max(F.when(F.col("_holder"), F.col("_seq"))).over(before),
        "_edge": F.max(F.when(F.col("_boundary"), F.col("_seq"))).over(before),
        "_next": F.min(F.when(F.col("_holder"), F.col("_seq"))).over(after),
    })
    target = F.when(F.col("_last") > F.coalesce("_edge", F.lit(0)), F.col("_last")).otherwise(F.col("_next"))
    counts = rows.where("_tokens is not null").withColumn("_target", target).where("_target is not null").groupBy(*keys, "_target").agg(*(F.sum(F.col("_tokens")[n]).alias(n) for n in amounts))
    holders = rows.where("_holder").drop("_holder", "_boundary", "_tokens", "_last", "_edge", "_next")
    joined = holders.join(counts.withColumnRenamed("_target", "_seq"), [*keys, "_seq"], "left")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in amounts}).withColumnRenamed("_seq", "seq")


def pending_at_end(df: DataFrame, call: Column, answer: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, seq) of keys whose last call is not followed by any answer."""
    last = df.groupBy(*keys).agg(F.max(F.when(call, F.struct(*order))).alias("_call"), F.max(F.when(answer, F.struct(*order))).alias("_answer"))
    return last.where("_call is not null and (_answer is null or _answer < _call)").select(*keys, "_call.*")


def last_result_per_call(results: DataFrame, keys: list[str], call_id: str, order: list[str]) -> DataFrame:
    """Of the results of one call id the last."""
    rest = [c for c in results.columns if c not in (*keys, call_id)]
    best = results.groupBy(*keys, call_id).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, call_id, "_row.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, stamp: str, value: str) -> DataFrame:
    """left with the value of right's last row of the same keys whose stamp isn't after left's.

    Both sides are laid in one order and the latest stamp carried forward, so a key costs its rows
    once, however many match.
    """
    names = left.columns
    one = left.select(*names, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_value"), F.lit(None).cast(dict(right.dtypes)[stamp]).alias("_stamp"))
    two = right.select(
        *(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in left.dtypes), F.col(stamp).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"), F.col(stamp).alias("_stamp")
    )
    upto = Window.partitionBy(*keys).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("_value", F.last("_value", ignorenulls=True).over(upto)).withColumn("_stamp", F.last("_stamp", ignorenulls=True).over(upto))
    return both.where("_side = 1").select(*names, F.col("_value").alias(value), F.col("_stamp").alias(stamp))
