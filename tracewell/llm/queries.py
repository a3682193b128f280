"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table


def tokenizer_file(spark: SparkSession, name: str) -> str:
    """A public tokenizer's path: below spark.tracewell.tokenizers if that is set, else where the package has it."""
    folder = spark.conf.get("spark.tracewell.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import digest

    return digest(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import digest

    return digest(table(spark, sf_dir, "documents"), tokenizer_file(spark, "word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import linked_vectors

    return linked_vectors(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_first_position, mix

    mixed = by_first_position(mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import grouped

    return grouped(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest

    return digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_ngram_join, op3_suffix_dedup, op4_sharding, op5_token_files, op6_quality_rules, op7_quality_classifier, op8_embedding_dedup, op9_mixing, op10_html_extraction, op11_vector_codes, op12_spelling_variants, op13_line_dedup)}


def oracle_sql() -> dict:
    from .oracles import SQL

    return dict(SQL)
