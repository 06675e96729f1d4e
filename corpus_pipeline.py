"""A corpus pipeline: five of the numbered operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  Stages 1 to
4 return the columns of documents; the last adds the shard of each document.  run() applies
them to the documents table; between stages the rows are written to the shared folder and read
again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import table
from lexispark.llm.decontaminate import decontaminate
from lexispark.llm.langid import keep_known_languages
from lexispark.llm.minhash import keep_representatives
from lexispark.llm.mixing import mix_sources
from lexispark.llm.shards import shard_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _apply(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """step over docs, whose further columns travel in one struct so that no name can clash."""
    extra = [c for c in docs.columns if c not in COLUMNS]
    if not extra:
        return step(docs).select(*docs.columns)
    out = step(docs.select(*COLUMNS, F.struct(*(F.col(f"`{c}`") for c in extra)).alias("__extra")))
    return out.select(*(F.col("__extra").getField(c).alias(c) if c in extra else F.col(c) for c in docs.columns))


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows; it learns from this stage's own input."""
    return _apply(docs, keep_known_languages)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return _apply(docs, keep_representatives)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apply(docs, lambda d: decontaminate(d, items))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at target weights: a row for each time a document is taken."""
    return _apply(docs, mix_sources)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the shard they belong to."""
    return shard_documents(docs)


STAGES = [
    ("language_id", known_languages),
    ("minhash_near_dedup", distinct_documents),
    ("benchmark_decontamination", clean_of_benchmark),
    ("source_mixing", mixed_sources),
    ("sharding", sharded),
]

#: Language ID is learned and MinHash is hashed, so no SQL gives these rows; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = table(docs)
    return docs
