"""The corpus pipeline: rules, exact and near dedup, mixing, encoding, each over what the stage before has kept.

Between stages the documents are written as Parquet into the shared folder and read
again, so that a lost executor costs one stage's tasks at most.  A stage's files are
removed when the next one's are written; the last ones stay, for the result reads them.

Defined cases, of every stage: an empty table gives no rows; null texts count as empty, null sources
as a source of their own, and rows with a null doc_id are handled like others except as said below;
very long texts are read whole; columns of any name are kept, but by the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from casframe.llm.common import remove_folder, shared_folder, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; empty texts go, repeated rows stay or go together."""
    forest = quality_rules.fit(*quality_rules.training_sample(docs, table(spark, sf_dir, "labels")))
    judged = quality_rules.judge(docs.withColumnsRenamed({c: f"__in_{c}" for c in docs.columns}).withColumn("text", F.col("__in_text")), forest, [f"__in_{c}" for c in docs.columns])
    return judged.where("kept").select(*(F.col(f"`__in_{c}`").alias(c) for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, a null one being the least; of repeated rows one."""
    return exact_dedup.keep_first_rows(docs, exact_dedup.exact_dedup(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates; rows with a null doc_id stay all or none."""
    return near_dedup.one_of_each(docs, near_dedup.near_dedup(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; repeated rows share their copies out."""
    return mixing.mixed_documents(docs, mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.encode_documents(docs, bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Trained trees and random rounding have no SQL; the tests compare run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove_folder(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
