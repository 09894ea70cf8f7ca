"""Exact deduplication with a split of heavy hitters (operator 2, native).

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; null counts as empty. Of
equal texts the row with the most code points in the original text stays, then the one with the smallest doc_id (a
null doc_id is the largest), then the first row read.

Method. Each row is reduced once to (doc_id, code points, SHA-256), and that narrow table is kept in the shared folder.
A frequent-items sketch of the Misra-Gries family (``approx_top_k``: a bounded table of counters per task, merged
afterwards) names digests that may be frequent. Their exact counts and winners are computed with map-side combining, and those verified
to hold a part of ``1 / counters`` of all rows, and two rows at least, are broadcast: at most ``counters`` rows, whatever the input. Rows of these digests get their answer where they lie; all
others are dealt by digest. A digest that the sketch missed can hold only about ``3.5 / counters`` of all rows, so no task gets a
large group, and nothing depends on what the sketch finds but the route.

Cases: repeated rows form a group of which one row stays, even with one doc_id; empty and null texts are equal to each
other; an empty table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import SPACE, only_first, row_key, settle, text_of

COUNTERS = 4096


def digests(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select(
        "doc_id",
        row_key().alias("row_key"),
        F.length(text).cast("long").alias("n_points"),
        F.sha2(F.regexp_replace(text, f"{SPACE}+", ""), 256).alias("text_sha256"),
    )


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, counters).drop("row_key")


def _judged(docs: DataFrame, counters: int) -> DataFrame:
    """The rows of dedup() with their row_key."""
    rows = settle(digests(docs)).withColumn("row_id", F.monotonically_increasing_id())
    order = (F.col("n_points").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id"))
    best = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"))

    # At most `counters` rows: the sketch has no more counters.
    named = rows.agg(F.expr(f"approx_top_k(text_sha256, {counters}, {counters})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    winners = settle(
        rows.join(F.broadcast(named), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(best).alias("best"))
        .filter(F.col("group_size") >= max(2, rows.count() // counters))
        .select("text_sha256", "group_size", "best.keep_id", "best.keep_row")
    )
    heavy = rows.join(F.broadcast(winners), "text_sha256").withColumn("kept", F.col("row_id") == F.col("keep_row"))

    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    group = Window.partitionBy("text_sha256")
    light = (
        rest.withColumn("nth", F.row_number().over(group.orderBy(*order)))
        .withColumn("keep_id", F.first("doc_id").over(group.orderBy(*order)))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.col("nth") == 1)
    )
    out = ("doc_id", "keep_id", "group_size", "kept", "text_sha256", "row_key")
    return heavy.select(*out).unionByName(light.select(*out))


def keep_one(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    rows = settle(_judged(docs, counters).select("row_key", "kept"))
    return only_first(docs, rows.filter("kept"), rows)


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id)
"""
