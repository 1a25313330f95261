"""From raw documents to an encoded training mix: five stages, each written and read again as Parquet.

Null and empty texts are documents like others: the classifier judges them as texts of no words, and of those kept one
stays, as they are equal. Texts of any length go through whole. Rows with a null doc_id take part under that id, and of
equal texts one with an id stays before one without; rows repeated as they are count as equal texts. A null source is a
source of its own. Further columns, whatever their names, are kept up to the last stage. An empty table gives an
empty result. Of ties each stage's operator says which row stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe_codec, chunk_dedup, pfair, simhash, site_quality
from tidemark.llm.common import checkpoint_folder, remove, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return site_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return chunk_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources are interleaved to their target weights: as written files
    hold them, from first to last."""
    return pfair.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each document's place in it, its token ids, and digests of ids and decoded bytes."""
    return bpe_codec.encode_documents(pfair.written_position(docs), carry=["position"], keep_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: Tokenization and the classifier can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the checkpoint folder and read again.

    A result goes once the next one is written, so the folder holds two at most. The mix stays in it, as the
    result reads it: ``position`` orders that result, whatever the order of its files.
    """
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
