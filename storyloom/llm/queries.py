"""The queries of this subpackage, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.llm import change_points, chat, exact_dedup, jaccard, licenses, mixing, packing, phrases, quality, runs, sharding, suffix_dedup, toxicity
from storyloom.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.weigh(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *mixing.DIMENSIONS, "n_tokens", F.round("rate", 6).alias("rate"), F.round("prob", 6).alias("prob"), "sampled")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.withColumn("score", F.round("score", 6)).drop("blocks")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "place")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), passages=False)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair(table(spark, sf_dir, "conversations"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ids=False)


def op11_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points.change_points(table(spark, sf_dir, "sale_lines"), "vendor_id", "shipped_at", "quantity")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.find(runs.with_periods(table(spark, sf_dir, "documents"))))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(table(spark, sf_dir, "documents"), keep_text=False)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ablations of the two policies beyond the base."""
    return quality.ablations_of(quality.ledger(table(spark, sf_dir, "documents")), ["v1", "v2"])


_ALL = (
    op1_mixing, op2_exact_dedup, op3_jaccard, op4_quality, op5_licenses, op6_sharding, op7_suffix_dedup,
    op8_toxicity, op9_chat, op10_packing, op11_change_points, op12_runs, op13_phrases, quality_ablations,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

_ABLATIONS = [f"SELECT '{v}' AS policy, * FROM ({quality.ablations_sql(v)})" for v in ("v1", "v2")]
SQL: dict[str, str] = {
    "op1_mixing": mixing.sql(),
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_quality": quality.SQL,
    "op5_licenses": licenses.sql(),
    "op11_change_points": change_points.SQL,
    "quality_ablations": " UNION ALL ".join(_ABLATIONS),
}
