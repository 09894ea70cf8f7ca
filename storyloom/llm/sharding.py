"""Sharding along a Hilbert curve (operator 6).

Several metadata dimensions are quantised to ``2 ** BITS`` steps of nearly equal numbers of rows, keeping their order: numbers by
quantiles, strings by the part of rows with a smaller string, whole strings compared. A row's steps give its place on the Hilbert curve; rows are sorted by that place and cut into runs
of equal counts. Neighbours on the curve are near in every dimension, so each shard spans a small range of each, and readers can skip
shards by the ranges of several columns at once. The law is ``rows``: shard sizes differ by one row at most.

The sort is by range over (place, CRC-32 of the text, doc_id), so a value that holds a third of all rows is dealt to
many tasks, and equal texts with equal metadata stand together. A row's rank is its partition's offset and its place
there; only a count for each partition is gathered. Quantiles come from mergeable sketches of fixed accuracy, and the smallest string of each step from a table of
the different strings, sorted by range: they alone come to the driver.

Cases: nulls are the smallest step of a dimension; a null text counts 0 bytes; ties are broken by doc_id, and repeated rows
take any order among themselves; with fewer rows than shards, some shards are empty; an empty table gives no rows; further columns are not read, but :func:`write` writes them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import columns_of, fresh, n_partitions, settle, text_of

SHARDS, BITS = 40, 5
DIMENSIONS = ("source", "lang", "size")


def hilbert(steps: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of steps (n rows, d dimensions), by Skilling's transposition."""
    x = steps.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """_part, _before and _all: the sums of amount in the partitions before, and in all. A row for each partition."""
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_n"))
    return sums.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(0)))).drop("_n")


def _sorted(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows sorted by range, with _part and _nth: their partition and place there."""
    rows = settle(rows.repartitionByRange(n_partitions(rows), *order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_nth", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")


def string_steps(rows: DataFrame, name: str, bits: int) -> list[tuple[str, int]]:
    """The smallest string of each step that occurs, and the step: the part of rows with smaller strings, in 2 ** bits steps."""
    values = _sorted(rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(F.count("*").alias("_c")), "_v")
    ahead = F.sum("_c").over(Window.partitionBy("_part").orderBy("_nth")) - F.col("_c")
    ranked = values.join(F.broadcast(_before(values, F.col("_c"))), "_part").withColumn("_step", ((F.col("_before") + ahead) * (1 << bits) / F.col("_all")).cast("int"))
    return sorted((r["_v"], r["_step"]) for r in ranked.groupBy("_step").agg(F.min("_v").alias("_v")).collect())  # 2 ** bits rows at most


def place(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """rows with ``place``, on the curve through the dimensions."""
    kinds = dict(rows.dtypes)
    numbers = [d for d in dimensions if kinds[d] != "string"]
    at = [k / 2**bits for k in range(1, 2**bits)]
    cuts = rows.agg(*(F.percentile_approx(F.col(d).cast("double"), at, 10_000).alias(d) for d in numbers)).first() if numbers else {}

    def step(d: str) -> Column:
        if d in numbers:
            bounds = [(float(v), k + 1) for k, v in enumerate(np.unique(np.array(cuts[d] if cuts[d] is not None else [], "float64")))]
        else:
            bounds = string_steps(rows, d, bits)
        if not bounds:
            return F.lit(0)
        held = F.col(d).cast("double") if d in numbers else F.col(d)
        many = F.size(F.filter(F.array(*(F.lit(v) for v, _ in bounds)), lambda v: v <= held))
        return F.coalesce(F.when(many > 0, F.element_at(F.array(*(F.lit(int(k)) for _, k in bounds)), many)), F.lit(0))

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack([c.to_numpy("int64") for c in columns], 1), bits))

    return rows.withColumn("place", curve(*(step(d) for d in dimensions)))


def _measures() -> list[Column]:
    return [F.col("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), (F.octet_length(text_of()) + 16).cast("long").alias("size"), F.crc32(F.encode(text_of(), "utf-8")).alias("text_crc32")]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the dimensions, size and text_crc32."""
    return docs.select(*_measures())


def _dealt(rows: DataFrame, shards: int, dimensions: Sequence[str], bits: int) -> DataFrame:
    """rows of measured(), and further columns, with place, shard and slot."""
    rows = _sorted(place(settle(rows), dimensions, bits), "place", "text_crc32", "doc_id")
    ranked = rows.join(F.broadcast(_before(rows, F.lit(1))), "_part").withColumn("_rank", F.col("_before") + F.col("_nth"))
    ranked = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div _all as int)"))
    return ranked.withColumn("slot", F.col("_rank") - F.expr(f"(cast(shard as long) * _all + {shards} - 1) div {shards}")).drop("_part", "_nth", "_before", "_all", "_rank")


def shard(docs: DataFrame, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """A row for each row of docs, without its text: doc_id, the dimensions, size, text_crc32, place, shard and slot."""
    return _dealt(measured(docs), shards, dimensions, bits)


def manifest(sharded: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Rows, bytes and the range of each dimension by shard: what a reader prunes by."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *(f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)))


def write(docs: DataFrame, path: str, shards: int = SHARDS, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Writes all rows of docs as Parquet in a folder for each shard, in the order of slots; returns the manifest. Folders are named by shard, or _shard if docs has such a column.

    Whole rows are sorted and kept in the shared folder until they are written, so rows with null or repeated ids are neither lost nor multiplied.
    """
    plan = settle(_dealt(docs.select(F.struct(*columns_of(docs)).alias("row"), *_measures()), shards, dimensions, bits))
    (name,) = fresh(docs, "shard")
    rows = plan.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias(name))
    rows.write.partitionBy(name).mode("errorifexists").parquet(path)
    return manifest(plan, dimensions)
