"""Corpus pipeline: toxicity, exact dedup, SimHash near-dedup on shingle sets, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
``run`` writes every stage's result to a table in the shared folder and reads it back as the next one's docs, so that
no stage depends on the executors of another.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyline.llm.common import shared_dir, table
from tallyline.llm.exact_dedup import drop_exact_copies
from tallyline.llm.packing import pack
from tallyline.llm.secrets import redact_secrets
from tallyline.llm.simhash_sets import keep_one_of_similar
from tallyline.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; fitted on the labels of the stage's own documents."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal without white space."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of texts whose five-word shingles are similar by 0.8 or more:
    the operator on SimHash fingerprints, in its form that confirms links on the shingle sets."""
    return keep_one_of_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars set anew where that changed a text."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids."""
    return pack(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("packing", packing)]

#: SQL can't express the classifier of the first stage; tests/llm hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
