"""From documents to token ids: five stages, each on what the one before kept, written as Parquet in between."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandspark.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from strandspark.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 stay; the model learns from labelled rows of ``docs`` that aren't held out.

    Null and empty texts and texts without words score as the model's bias alone says, repeated rows alike; rows without a
    doc_id have no label, but are scored. Without labels, or without one of the two, all rows score alike.
    """
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by 0.8 similarity of five-word shingles stays: the smallest doc_id.

    Texts without words and rows without a doc_id are linked with nothing and stay; rows that share a doc_id are one document.
    """
    return near_dedup.deduplicated(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark stay, null and empty texts among them; an empty benchmark drops nothing."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in their texts are masked, and n_chars follows. Texts without one stay as they are."""
    return secrets.redacted(docs, secrets.learned(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of every text that is left, none for null and empty texts.

    One row for each row, repeated or without a doc_id or not; other columns are left out, whatever their names.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("secrets", mask_secrets), ("bpe", tokenize)]

#: Minimum hashing, learned models and merges aren't SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in a row over ``documents``; what each returns is written to the shared folder and read again.

    An empty table gives an empty result. Columns of ``documents`` beside those that stages use stay as they are, whatever
    their names.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
