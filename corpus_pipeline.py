"""A training corpus from documents: rules, near copies, benchmark leaks, tokens.

Each stage works on all rows that its predecessor kept; ``run`` applies the
stages to the documents, with every stage's rows written and read again. The
last stage adds the tokens' digest to each document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventide.llm.op4_decontam import decontaminate
from eventide.llm.op7_quality import quality_filter
from eventide.llm.op8_simhash import simhash_filter
from eventide.llm.op10_bpe import bpe_encode, default_ranks
from eventide.sources.tables import discard, made, materialize, sweep


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_filter(docs, width=5, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_encode(docs, default_ranks())


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark_leaks), ("byte_bpe", tokens)]

#: SimHash, edit distance and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        before, since = docs, made()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
            # The stage is written: neither its own tables nor the rows it read are needed any more.
            sweep(spark, since, (docs,))
            discard(before)
    return docs
