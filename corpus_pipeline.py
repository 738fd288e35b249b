"""The corpus pipeline: from raw documents to packed training sequences.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last keep the columns of documents, extra ones too, whatever their names.

Defined results. A null text is the empty text: it is no better or worse than others without words, a copy of every other text without words, holds
no personal data, and packs as one end-of-text id. Rows without an id stay unless their text is a copy of another row's. Rows that repeat an
id and a text stay or go together; of ids with several texts each text is judged. Ties of quality go to the larger id, equal texts keep the largest
id, near copies the smallest. An empty table of documents gives no rows; without labels nothing is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, exact_dedup, importance, near_copies, packing, pii


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampler keeps."""
    return importance.keep_quality(docs, common.read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with a Jaccard similarity of 0.8 or more over five-word shingles, found by SimHash, the one of smallest doc_id."""
    return near_copies.drop_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence."""
    return packing.pack(docs, with_ids=False)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("personal data", private), ("packing", packed)]

ORACLE_SQL = None  # models and fingerprints are beyond SQL; tests hold the pipeline against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on the way is deleted once its result is there."""
    docs, folder = common.read(spark, sf_dir, "documents"), f"{common.session_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        before = common.mark()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        common.discard(spark, before)
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
