"""From raw documents to packed training sequences: five operators of plumbline.llm, one after the other.

Every stage reads what the one before it wrote. The first four return the columns of documents;
the last returns packed pieces with their token ids. Rows that a stage drops are gone for the
next; the mix repeats rows, and each repetition is packed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, mixing, near_dedup, packing, quality
from plumbline.llm.common import delete, read, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Near duplicates are not expressible in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents. Stages are written to the shared checkpoint folder and read again; one that is read is deleted."""
    docs, base = read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{number}")
            docs = spark.read.parquet(f"{base}/{number}")
            if number:
                delete(spark, f"{base}/{number - 1}")
    return docs
