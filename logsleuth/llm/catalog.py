"""The registered queries of the text operators, one ``opN_<name>`` for each,
applied with production parameters to their whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from logsleuth.llm import (common, decontaminate, language, licenses, merkle, mixing, ngram, phrases, pii, quality, simhash,
                           substrings, warc, wordpiece)


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(common.documents(spark, sf_dir))


def op2_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(common.documents(spark, sf_dir))


def op3_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(common.documents(spark, sf_dir))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.documents(spark, sf_dir))


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(common.documents(spark, sf_dir),
                                         spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    evidence = language.of_documents(docs)
    return language.identify(docs, evidence, language.fit(docs, evidence))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator where pages declare a language and have an address."""
    common.prepare(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    evidence = language.of_pages(pages)
    return language.identify(pages, evidence, language.fit(pages, evidence), keep=("page_id",))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(common.documents(spark, sf_dir))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op10_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.documents(spark, sf_dir))


def op11_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(common.documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(common.documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_frequency, op2_wordpiece_counts, op3_ngram_scores,
                            op4_licence_scan, op5_benchmark_containment, op6_substring_dedup,
                            op7_language_fusion, op8_source_mix,
                            op9_simhash_dedup, op10_pii_anchors, op11_warc_captures,
                            op12_collocations, op13_merkle_manifest, pipeline, page_language)}
# the other operators have no SQL form; their tests compare them with brute force
SQL: dict[str, str] = {"op1_line_frequency": quality.SQL, "op5_benchmark_containment": decontaminate.SQL,
                       "op6_substring_dedup": substrings.SQL,
                       "op8_source_mix": mixing.SQL, "op11_warc_captures": warc.SQL,
                       "op12_collocations": phrases.SQL, "op13_merkle_manifest": merkle.SQL}
