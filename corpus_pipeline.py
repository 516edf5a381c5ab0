"""A training corpus from raw documents: filter, de-duplicate, decontaminate, mix, write in training order.

Defined cases, for every stage: null doc_ids, texts, languages and sources are
values like others (a null text is an empty one); repeated rows are rows, until
the near-copy stage leaves one of each; further columns are carried along up to
the last stage, whatever they are called; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from emberframe.llm import decontam, mixing, quality, simhash, training_order
from emberframe.llm.common import table
from emberframe.operators.components import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels of both kinds all stay or all go by the labels' share."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays (five words, similarity 0.8), that of the least doc_id; an id of null comes last."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; an empty benchmark lets all stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them; without words nothing is taken."""
    return mixing.mixed_documents(docs)


def write_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order; no documents, no shards."""
    return training_order.shards(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing to target weights", mix_sources),
    ("token-ID / binary output", write_training_order),
]

#: The classifier's network has no SQL form; tests hold every stage against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for nth, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if nth < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{nth}")
            docs = spark.read.parquet(f"{folder}/{nth}")
    return docs
