"""The training-data pipeline over `documents`, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm import decontam, minhash, mixing, toxicity, wavelet
from chunkwell.llm._shared import discard, materialise
from chunkwell.llm.queries import END_ID, tokenizer_path

#: SQL expresses none of the classifiers, sketches or files; the stages are tested on small tables.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their rates until domain tokens meet their targets."""
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written, and their documents read back."""
    return wavelet.tokens(docs, tokenizer_path(), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_domains),
    ("token_ids", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage in order; each stage's rows are written before the next reads them, then those before go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs_before = docs
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, before = materialise(docs, name), docs_before
            discard(before)
            docs_before = docs
    return docs
