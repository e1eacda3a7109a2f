"""From raw documents to packed training sequences, in five stages.

Every stage is a function (spark, docs, sf_dir) to a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.

1. toxicity: documents that the weighted lexicon calls toxic go.
2. line dedup: lines that an earlier line equals, or is one edit away from, go; a document left without lines stays.
3. SimHash near-dedup: one document of each group stays; texts link if their sets of word shingles of five have a
   similarity of 0.8 or more (fingerprints only say which texts to compare).
4. mixing: documents are repeated or left out so that sources come near their target weights.
5. packing: token sequences of at most 2048, by best-two-fit; ids holds a piece's tokens (little-endian, 32 bits each).

The stages take nulls, empty and very long texts, repeated rows, empty tables and extra columns as their operators'
docstrings say. SQL cannot express the stages, so ORACLE_SQL is None.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assetlens.llm.best_fit_packing import pack_documents
from assetlens.llm.common import remove_folder, shared_folder, table
from assetlens.llm.line_dedup import without_repeated_lines
from assetlens.llm.pivotal_mixing import mixed_documents
from assetlens.llm.simhash_dedup import one_of_each
from assetlens.llm.toxicity import without_toxic

#: Pieces that one task packs, with their tokens.
PACKED_AT_ONCE = 4_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, keep_ids=True, block=PACKED_AT_ONCE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mixing),
    ("best-fit packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them is in the folder of spark.checkpoint.dir until the next is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}")
    return docs
