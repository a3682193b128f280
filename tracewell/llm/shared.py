"""Helpers the training-data operators share: scratch tables, tables by name, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a broadcast side up to which the operators broadcast; beyond it they shuffle.
BROADCAST_LIMIT_BYTES = 64 << 20

#: White space of the word contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared scratch folder, in a folder for each value of by if given, and read it back, which cuts its lineage.

    The files outlive the executors that wrote them, so a lost executor costs only its
    running tasks.  They stay until the checkpoint folder is cleaned.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing depends on any more, as their readers are written themselves."""
    for df in tables:
        spark = df.sparkSession
        folder = f"{scratch_dir(spark)}/tracewell/"
        for path in {re.sub(r"(/[^/=]+=[^/]*)*/[^/]+$", "", f) for f in df.inputFiles()}:
            if folder.removeprefix("file:").lstrip("/") in path:
                target = spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that Spark hands to a Python worker at a time; texts may be long, and both sides hold a batch.
ARROW_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session set to hand Python workers at most ARROW_ROWS rows at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name, "10000")) > ARROW_ROWS:
        df.sparkSession.conf.set(name, str(ARROW_ROWS))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first of name_1, name_2, ... that no column of df has (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(taken) + 2))) if n.lower() not in taken)


def with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """(rows, key): docs with a column of unique longs without nulls, and its name.

    That is doc_id itself where it serves.  Else rows are numbered, and written so that numbers stay.
    """
    total, named, different = docs.agg(F.count("*"), F.count("doc_id"), F.countDistinct("doc_id")).first()
    if total == named == different:
        return docs, "doc_id"
    key = fresh(docs, "row_key")
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "row-keys"), key


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its least node.

    Alternating large-star and small-star steps: each replaces edges by edges to the
    neighbourhood's minimum, so stars and chains shrink in a logarithmic number of rounds.
    The minimum of a neighbourhood is a partially aggregated group-by joined back, so a hub
    with very many edges is never gathered into one row.  Self-edges are ignored; an empty
    edge list gives an empty result.
    """
    current = edges.select(
        F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    ).where("hi <> lo").distinct()
    current = materialize(current, "cc")

    def step(df: DataFrame, larger: bool) -> DataFrame:
        pairs = df.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        if larger:
            pairs = pairs.union(df.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = pairs.join(least, "u")
        if larger:
            out = linked.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        else:
            out = linked.select(F.col("v").alias("hi"), F.col("m").alias("lo")).union(
                least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
            )
        return out.where("hi <> lo").distinct()

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        return tuple(row)

    before = mark(current)
    while True:
        current = materialize(step(step(current, True), False), "cc")
        after = mark(current)
        if after == before:
            break
        before = after
    nodes = current.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = current.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return nodes.union(roots)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast only if its counted rows, of about row_bytes each, are few enough."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_LIMIT_BYTES else df
