"""A corpus pipeline in five stages, each on what the one before it kept.

Toxicity (documents that it rejects go), exact dedup (one row of each group of equal texts stays), n-gram Jaccard join
(one document of each component stays), mixing sources to target weights (documents are drawn), packing (a row for each piece).
Every stage is written as Parquet in the shared folder and read again, so a lost executor costs no finished stage. What a stage has written is removed
when the next one is written; the last one's stays, with the token ids of each piece.

Cases: null, empty and white texts are copies of each other, of which one goes on, and are packed as their closing id alone; a null text's toxicity is
that of an empty one. Rows with null or repeated ids are told apart by their texts; rows equal in both are copies, though only one of them may
stay. Ties go to the smaller doc_id, a null one last, then to the smaller digest. Very long texts are read whole by every stage. Without labels nothing is
toxic. An empty table gives no rows. Further columns of documents go through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from storyloom.llm import exact_dedup, jaccard, mixing, packing, toxicity
from storyloom.llm.common import remove, shared_folder, table


#: Near copies of the stage: five words and a similarity of 0.8. The query op3_jaccard has a rule of its own.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, NEAR_SHINGLE, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]

#: Toxicity is a fitted model, and packing needs a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
