"""A corpus pipeline in five stages, each one of tracewell.llm's operators on all rows it is given.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, ngram_join, pieces, quality_classifier, suffix_dedup
from tracewell.llm.queries import tokenizer_file
from tracewell.llm.shared import discard, fresh, materialize, sized, table, with_row_key


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows whose texts the quality classifier rejects."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of least doc_id; null comes last, and of equal ones any one stays.

    Rows are told apart whatever their doc_id, so different texts of one doc_id stay.
    """
    rows, key = with_row_key(docs)
    similar = ngram_join.similar_documents(rows.select(F.col(key).alias("doc_id"), "text"))
    groups = materialize(similar, "pipeline-groups")
    discard(similar)  # its shingles are larger than the texts, and would lie there through the next stages
    surplus = groups.where("doc_id <> component_id").select("doc_id")
    if key != "doc_id":
        # Components are named by the least row, which needn't be that of the least doc_id.
        large = groups.join(groups.where("doc_id <> component_id").select("component_id").distinct(), "component_id")
        named = large.join(rows.select(F.col(key).alias("row"), F.col("doc_id").alias("name")), large["doc_id"] == F.col("row"))
        best = named.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("name").isNull(), "name", "row")).alias("stays"))
        surplus = large.join(best, "component_id").where("doc_id <> stays").select("doc_id")
    surplus = materialize(surplus.select(F.col("doc_id").alias("surplus_key")), "pipeline-surplus")
    return rows.join(sized(surplus, 16), rows[key] == surplus["surplus_key"], "left_anti").select(docs.columns)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated passages cut out of their texts; no row goes."""
    return suffix_dedup.without_repeats(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in training order over its files and their rows, each row as often as the mix takes it."""
    rows, key = with_row_key(docs)
    turns = mixing.mix(rows.select(F.col(key).alias("doc_id"), "source", "text")).where("size(positions) > 0")
    taken, at = fresh(rows, "taken"), fresh(rows, "position")
    turns = materialize(turns.select(F.col("doc_id").alias(taken), F.col("positions").alias(at)), "pipeline-turns")
    found = rows.join(sized(turns, 64), rows[key] == turns[taken]).select(*(rows[c] for c in docs.columns), F.explode(at).alias(at))
    return found.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(docs.columns)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(position, doc_id, lang, source, n_tokens, ids): each row's SentencePiece ids, packed in 32 bits each.

    The stage before writes files in training order.  position, which grows with it, is a row's file
    number and its place in the file; it is null where docs doesn't come from files.
    """
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).try_cast("long")
        docs = docs.withColumn("position", F.shiftleft(part, 40) + F.col("_metadata.row_index"))
    except AnalysisException:
        docs = docs.withColumn("position", F.lit(None).cast("long"))
    rows = docs.select("position", "doc_id", "lang", "source", "text")
    encoded = pieces.encode(rows, tokenizer_file(spark, "piece_bpe_32k.model"))
    return encoded.select("position", "doc_id", "lang", "source", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", no_repeated_passages),
    ("mixing sources", mixed_sources),
    ("SentencePiece", tokenized),
]

#: SQL can't express the classifier, the byte-wise passages and the tokenizer; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the stages make of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
