"""Corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result to the shared folder and reads it again as the next
stage's docs. All but the last return the columns of documents. The last stage's rows describe the token files: doc_id, start,
n_tokens, ids_crc32; a document that the mix repeats has a row for each time.

Nulls, ties and repeated rows are treated as the operators say. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textmatch.llm import leaks, mixing, quality, simhash, tokens
from textmatch.llm.common import drop, read, scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_similar(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.tokenized(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("token-ID / binary output", token_output),
]

#: Fingerprints, latent retrieval and tokenization have no SQL form; tests/llm holds the rows against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the token files. The tables of a stage are deleted when its result is written, and that result when the next one is."""
    docs, held = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        with scratch(spark) as keep:
            docs = keep(table(stage(spark, docs, sf_dir), "stage"))
        if held is not None:
            drop(held)
        held = docs
    return docs
