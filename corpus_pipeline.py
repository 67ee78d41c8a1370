"""From raw documents to token files in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet into the shared folder
and reads again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelake.llm.common import delete, shared_path, table
from ratelake.llm.decontamination import decontaminate
from ratelake.llm.mixing import apply_mix
from ratelake.llm.quality_rules import keep_good
from ratelake.llm.simhash import drop_near_copies
from ratelake.llm.token_output import digest, write_tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio.

    Null, empty and short texts go, repeated rows stay or go together, rows with a null id are judged like any other.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Fingerprints by multi-index hashing first, bands of minima for pairs out of their reach, an exact comparison for both.
    Rows with a null id stay; rows that share an id are one document; texts without a word are near copies of nothing.
    """
    return drop_near_copies(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; rows are judged by id and text, also such without an id."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole; a null source is a source of its own."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files and returns, read back from them, doc_id, start, n_tokens and ids_crc32.

    A null or empty text is the end id alone; rows with a null id come first.
    """
    return digest(spark, write_tokens(docs, shared_path(spark, "tokens")))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontamination", clean_of_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Likelihoods, similarities by minima and tokenizers have no SQL; ``tests/llm/test_pipeline.py`` holds each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table; a stage's table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
