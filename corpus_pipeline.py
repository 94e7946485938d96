"""A training corpus from raw documents: language, near-duplicates, benchmark
passages, personal data, mixture.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows it keeps.  All but the last return the columns of documents.
``run`` writes each result as Parquet below the checkpoint folder and reads it
again as the input of the next, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logsleuth.llm import common, decontaminate, language, mixing, pii, simhash
from logsleuth.session import checkpoint_dir


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not identified: no letters, or no
    language reaches the posterior that is asked for."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints, the one with
    the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    common.prepare(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text; keeps every document."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mixture: one row for each copy taken, with copy, shard, place."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark_copies),
    ("personal_data", redact_personal_data),
    ("mixture", mix_sources),
]

# fingerprints, trained profiles and hash draws have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = common.documents(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4()}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
