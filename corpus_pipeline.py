"""A training corpus from raw documents: five stages, each over all that the stage before kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of documents.  ``run`` writes what a stage keeps
and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import decontaminate, langid, pieces, pii, simhash
from trailweave.llm.scratch import discard, in_session, materialise, own_session


def _texts(docs: DataFrame) -> DataFrame:
    """The documents in a session of their own, which hands texts to Python workers in small batches."""
    return in_session(docs, own_session(docs.sparkSession))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts, texts without a letter and texts like nothing that was learned go."""
    return langid.keep_identified(_texts(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return simhash.one_of_each(_texts(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark of five words or more."""
    return decontaminate.without_benchmark(_texts(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced; ``n_chars`` follows the text."""
    clean = pii.sanitise(_texts(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return pieces.encode(_texts(docs), outputs=False).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("pii", sanitise_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table.

    Null and empty texts, texts without a letter, and all but one of each
    group of near copies go; null ids, repeated rows and ties are as the
    stages say; very long texts are taken whole; an empty table gives no
    rows; further columns stay until the last stage, whatever their names.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
