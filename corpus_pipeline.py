"""From raw documents to token ids: quality, near duplicates, repeated substrings, mixing, encoding.

Each stage takes all rows that the one before kept and returns the columns of
`documents` (the last one: ids and counts of tokens).  SQL cannot express the
near-duplicate and substring stages; tests compare every stage with brute force.

Defined results of all stages: null and empty texts fail the quality rules and go;
a null doc_id is no near duplicate, is not cut, and is mixed and encoded like others;
repeated rows are judged one by one, and none of them is a near duplicate of another
row with its doc_id; long texts are taken whole; an empty table stays empty; extra
columns stay as they are, and n_chars is made anew only where it is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import _text, bpe, jaccard_join, mixing, quality, queries, suffix_dedup

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return jaccard_join.keep_first_of_group(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that a document with a smaller id holds are cut; n_chars follows."""
    cut = suffix_dedup.remove_substrings(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix; one that the mix takes twice is there twice."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes that they decode to."""
    return bpe.token_digests(docs, *queries.vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_substrings),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = _text.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
