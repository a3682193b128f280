"""Shuffled shards: a two-pass external shuffle of whole records in DataFrame operations.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash; pass two shuffles
each bucket with a seeded Fisher-Yates shuffle (Spark's ``shuffle``) and writes it.  The slot in
its shard is the bucket's offset, a prefix sum over bucket counts, plus the place in the bucket.

The shard follows the ``key`` law: rendezvous hashing, so a record's shard depends only on its
doc_id and the number of shards, and one more shard takes rows only into itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch_dir, sized

#: Bytes of text of a bucket, and its records, on average; a bucket has to fit in one task's memory.
BUCKET_BYTES = 8 << 20
BUCKET_RECORDS = 20_000
#: Buckets of a task, on average, and most tasks.
TASK_BUCKETS, MOST_TASKS = 4, 100_000


def rendezvous_shard(key: Column, shards: int, seed: int) -> Column:
    """The shard from 0 to shards - 1 whose seeded hash with the key is greatest."""
    scores = F.array(*(F.xxhash64(F.lit(seed), key, F.lit(i)) for i in range(shards)))
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text plus 1; null has none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 42, bucket_bytes: int = BUCKET_BYTES, bucket_records: int = BUCKET_RECORDS) -> None:
    """Write docs (doc_id, text, ...), whole rows with their slot, as one folder of Parquet files for each shard.

    Slots of a shard are gapless from 0; a file holds whole buckets, so its rows are sorted by slot.
    Rows of equal or null doc_id share a shard and have a slot each.  Rows that are equal in doc_id
    and text share a bucket, unless there are more of them than fit in one: those are dealt over
    several by their place in the input.  Columns shard and slot of docs are replaced, all others
    are written as they are.  The same input files give the same shards.
    """
    whole = docs.drop("shard", "slot")
    total, rows = docs.agg(F.sum(text_size(F.col("text"))), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // (shards * bucket_bytes)), -(-rows // (shards * bucket_records)))
    copies = docs.groupBy("doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("crc")).count()
    often = copies.where(F.greatest(F.col("count") / bucket_records, F.col("count") * F.col("size") / bucket_bytes) > 1)
    often = materialize(often.select("doc_id", "size", "crc", F.ceil(F.greatest(F.col("count") / bucket_records, F.col("count") * F.col("size") / bucket_bytes)).alias("parts")), "shard-copies")
    record = whole.select(F.struct(*(F.col(f"`{c}`") for c in whole.columns)).alias("record"))
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    placed = record.select("record", text_size(text).alias("size"), text_crc32(text).alias("crc"), rendezvous_shard(doc_id, shards, seed).alias("shard"))
    share = F.lit(0).cast("long")
    if not often.isEmpty():
        o = often.select(F.col("doc_id").alias("o_id"), F.col("size").alias("o_size"), F.col("crc").alias("o_crc"), "parts")
        placed = placed.withColumn("at", F.monotonically_increasing_id())
        placed = placed.join(sized(o, 32), doc_id.eqNullSafe(F.col("o_id")) & (F.col("size") == F.col("o_size")) & (F.col("crc") == F.col("o_crc")), "left")
        share = F.coalesce(F.pmod("at", "parts"), F.lit(0))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), doc_id, "crc", "size", share), F.lit(buckets)).cast("int")
    placed = placed.select("shard", bucket.alias("bucket"), "size", "crc", "record")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "shard-counts")
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # Which generator shuffles a bucket depends on its task and its place there, so both are fixed by the
    # data: buckets are dealt by hash over a number of tasks that follows from theirs, and sorted in each.
    tasks = min(max(shards, shards * buckets // TASK_BUCKETS), MOST_TASKS)
    scattered = placed.repartition(tasks, "shard", "bucket").sortWithinPartitions("shard", "bucket", "record.doc_id", "crc", "size")
    gathered = scattered.groupBy("shard", "bucket").agg(F.collect_list("record").alias("records")).sortWithinPartitions("shard", "bucket")
    shuffled = gathered.select("shard", "bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record"))
    slotted = shuffled.join(sized(offsets, 16), ["shard", "bucket"]).select("record.*", (F.col("offset") + F.col("at")).cast("long").alias("slot"), "shard")
    slotted.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_records: int = BUCKET_RECORDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text, ...).

    Read back from the shard files, which are written below the scratch folder.  size is the UTF-8
    length of the text plus 1 (null text: 1), text_crc32 that of the text's bytes (null text: 0).
    No rows: no rows.  Only doc_id and text of docs are written.
    """
    spark = docs.sparkSession
    path = f"{scratch_dir(spark)}/tracewell/shards-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text")
    write_shards(rows, path, shards, seed, bucket_records=bucket_records)
    types = dict(rows.dtypes)
    files = spark.read.schema(f"doc_id {types['doc_id']}, text string, slot long, shard int").parquet(path)
    return files.select(
        "doc_id", text_size(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        rendezvous_shard(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
