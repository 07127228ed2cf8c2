"""From raw documents to token files, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next one. All but the
last return the columns of ``docs``: the quality classifier drops what it rejects, one document of each near-duplicate class
stays, benchmark passages are cut out, sources are mixed (documents repeat as often as they are taken), and the mix is encoded
into token files. The last stage returns a row per document copy: its position, number of ids and checksum, read back from
the files. Empty input gives empty output at every stage; nulls, ties and repeated rows are treated as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depotlens.llm import decontamination, mixing, near_dedup, quality, token_files
from depotlens.llm.queries import END_ID, tokenizer_file
from depotlens.sources.scratch import materialise


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_per_class(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_digests(spark, token_files.write_documents(docs, tokenizer_file(), END_ID))


STAGES = [
    ("quality_classifier", filter_quality),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("token_files", write_token_files),
]
# A trained model and signatures decide which rows stay; SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
