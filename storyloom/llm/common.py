"""What the operators of this subpackage share: reading tables, cutting lineage and null-safe columns."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of most operators: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only in local mode, where driver and executors are one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None and (known := sc._jsc.sc().getCheckpointDir()).isDefined():
        folder = known.get()
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="storyloom-")
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, by the file system that it is on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the shared folder: lost executors don't lose them, and their partitions are fixed."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def afresh(df: DataFrame) -> DataFrame:
    """:func:`settle` for what is joined turn by turn: a table that remembers nothing of its plan.

    A checkpoint keeps its plan's estimate of the size, and a join's estimate is the product of its inputs'. Over turns its digits double with each join, until
    numbers of megabytes fill the driver's heap whatever the rows. A table that is made anew of the rows has no estimate; it costs a conversion of each row that is read.
    """
    spark, rows = df.sparkSession, settle(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def n_partitions(df: DataFrame) -> int:
    """As many partitions as the session deals shuffles to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Bits of the filters of :func:`marks`: a table of 2 MB, whatever the input.
MARK_BITS = 1 << 24


def _mark(key: str) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(MARK_BITS))
    return (at / 32768).cast("long"), (at % 32768).cast("long")


def marks(ids: DataFrame, key: str) -> DataFrame:
    """A bitmap of the ids' hashes, in rows of 4 KB; at most MARK_BITS bits, so it may be broadcast. More ids only make it coarser."""
    bucket, bit = _mark(key)
    return settle(ids.select(bucket.alias("_bucket"), bit.alias("_bit")).groupBy("_bucket").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df, whatever its columns are called, doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def split_by_marks(df: DataFrame, key: str, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be among the marked ids, and those whose key isn't."""
    bucket, bit = _mark(key)
    at, of, bits, byte = fresh(df, "_bucket", "_bit", "_bits", "_byte")
    rows = df.withColumns({at: bucket, of: bit}).join(F.broadcast(marked.select(F.col("_bucket").alias(at), F.col("_bits").alias(bits))), at, "left")
    held = F.coalesce(F.expr(f"shiftright({byte}, cast({of} % 8 as int)) & 1") == 1, F.lit(False))
    rows = rows.withColumn(byte, F.conv(F.hex(F.expr(f"substring({bits}, cast({of} div 8 as int) + 1, 1)")), 16, 10).cast("int"))
    return rows.filter(held).select(*columns_of(df)), rows.filter(~held).select(*columns_of(df))


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df by their names, also names with dots."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_key() -> Column:
    """A digest of doc_id and text: rows that share it are repeated rows. Never null, so null ids don't gather."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\x00"), text_of()))


def only_first(df: DataFrame, kept: DataFrame, every: DataFrame) -> DataFrame:
    """The rows of df whose :func:`row_key` is in kept (row_key), one for each, with the columns of df; every: the row_key of each row of df.

    Keys that repeat or aren't kept are marked in a bitmap of fixed size, and rows that it doesn't name stay where they lie, so their texts aren't
    shuffled. Of the others, repeated rows are united within each task before they are dealt by key, so none of their keys is one task's.
    """
    key, one, n, held = fresh(df, "_row_key", "_one", "_n", "_held")
    kept = kept.select(F.col("row_key").alias(key)).distinct()
    keys = every.groupBy(F.col("row_key").alias(key)).agg(F.count("*").alias(n))
    doubtful = keys.join(kept.withColumn(held, F.lit(True)), key, "left").where(F.col(held).isNull() | (F.col(n) > 1)).select(key)
    some, whole = split_by_marks(df.withColumn(key, row_key()), key, marks(doubtful, key))
    ones = some.groupBy(key).agg(F.first(F.struct(*columns_of(df))).alias(one)).join(kept, key, "left_semi")
    return whole.select(*columns_of(df)).unionByName(ones.select(f"{one}.*"))


#: Bytes of an Arrow batch that goes to Python. Spark's own bound, 64 MB, is held several times by each task: in the JVM's buffers, in Arrow, as Python's strings.
BATCH_BYTES, _SPARKS_OWN = 4 << 20, 64 << 20


def light(df: DataFrame) -> DataFrame:
    """df; lowers its session's bound on Arrow batches, unless it was set, so that tasks over texts take less memory. It holds for all that the session runs."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(conf.get(key)).rstrip("bB") == str(_SPARKS_OWN):
        conf.set(key, BATCH_BYTES)
    return df


def free() -> None:
    """Gives memory that this Python process holds, but doesn't use, back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back after each task: Spark uses its Python processes again."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            free()

    return once
