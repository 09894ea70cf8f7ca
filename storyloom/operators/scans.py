"""Numbering, inheritance, segments and tracks of documents that are larger than a task.

The window versions (:mod:`events`, :mod:`segments`) deal rows by document, so a document is one task's work. Here it is cut in parts of
consecutive sentences, dealt by (doc_id, part), and what goes from event to event is a segmented prefix scan: each part is reduced to
what it leaves to the next ones (how many events, the last actors and anchor of its own, its first and last event, how many segments begin
in it), these carries, a row for each part, are composed in order, and the parts then run alone from what they are given. Results are
those of the window versions, whatever the size of the parts.

A carry is a row for PART sentences, so composing them is a window over 1/PART of the document. A single segment, and the list of a
document's distinct tracks, are not cut. Rows are read by several passes; pass a kept DataFrame if making them is dear, as
:class:`storyloom.plans.corpus.Corpus` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from storyloom.operators import events, segments

#: Sentences, or segments, of a part: small enough that each task gets many, so that tasks are even.
PART = 256


def _before() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def parted(rows: DataFrame, by: str, size: int) -> DataFrame:
    """rows with their part, dealt by document and part."""
    return rows.withColumn("part", F.expr(f"{by} div {size}")).repartition("doc_id", "part")


def _given(rows: DataFrame, left: DataFrame) -> DataFrame:
    """rows with what the parts before theirs left: a row of left for each part."""
    return rows.join(left, ["doc_id", "part"])


def numbered(rows: DataFrame, size: int = PART) -> DataFrame:
    """As :func:`events.numbered`: order, inherited actors and anchors; rows keep their part."""
    rows = parted(rows, "sent_no", size)
    place = F.struct("sent_no", "clause_no")
    own_actors, own_anchor = F.when(F.size("own_actors") > 0, F.col("own_actors")), F.when(F.col("own_anchor") != "", F.col("own_anchor"))
    latest = lambda c: F.max_by(c, F.when(c.isNotNull(), place))
    left = rows.groupBy("doc_id", "part").agg(F.count("*").alias("_n"), latest(own_actors).alias("_actors"), latest(own_anchor).alias("_anchor"))
    left = left.select(
        "doc_id",
        "part",
        F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_n"),
        *(F.last(c, ignorenulls=True).over(_before()).alias(c) for c in ("_actors", "_anchor")),
    )
    here = Window.partitionBy("doc_id", "part").orderBy("sent_no", "clause_no")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    inherited = lambda own, given, empty: F.coalesce(F.last(own, ignorenulls=True).over(so_far), F.col(given), F.col(empty))
    rows = _given(rows, left).withColumns(
        {
            "order": (F.col("_n") + F.row_number().over(here)).cast("int"),
            "actors": inherited(own_actors, "_actors", "own_actors"),
            "temporal_anchor": inherited(own_anchor, "_anchor", "own_anchor"),
        }
    )
    return events.with_cues(rows).drop("_n", "_actors", "_anchor", "own_actors", "own_anchor", "cue_later", "sent_no", "clause_no")


def segmented(rows: DataFrame) -> DataFrame:
    """As :func:`segments.segmented`: events of :func:`numbered`, which have a part, with seg_no."""
    state = F.struct("temporal_category", "actors", "temporal_anchor")
    here = Window.partitionBy("doc_id", "part").orderBy("order")
    now = F.struct(state.alias("s"), F.col("relation_cue").alias("cue"), F.col("relation_to_previous").alias("relation"))
    inner = rows.select("doc_id", "part", "order", now.alias("now"), F.lag(state).over(here).alias("before"))
    new = F.when(F.col("before").isNotNull() & ~_goes_on(F.col("before"), F.col("now")), 1).otherwise(0)
    left = inner.groupBy("doc_id", "part").agg(F.sum(new).alias("_new"), F.min_by("now", "order").alias("_head"), F.max_by("now", "order")["s"].alias("_tail"))
    left = left.withColumn("_tail", F.last("_tail").over(_before()))
    # A part's first event begins a segment or goes on with that of the part before.
    left = left.withColumn("_new", F.col("_new") + F.when(_goes_on(F.col("_tail"), F.col("_head")), 0).otherwise(1))
    left = left.select("doc_id", "part", "_tail", F.coalesce(F.sum("_new").over(_before()), F.lit(0)).alias("_segments"))
    rows = _given(rows, left)
    begins = F.when(_goes_on(F.coalesce(F.lag(state).over(here), F.col("_tail")), now), 0).otherwise(1)
    rows = rows.withColumn("_begins", begins)
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("seg_no", (F.col("_segments") + F.sum("_begins").over(so_far)).cast("int")).drop("_begins", "_tail", "_segments", "part")


def _goes_on(before: Column, now: Column) -> Column:
    return F.coalesce(segments.goes_on(before, now["s"], now["cue"], now["relation"]), F.lit(False))


def tracked(rows: DataFrame, size: int = PART) -> DataFrame:
    """As :func:`segments.tracked`: tracks are partial sums by key, and places in a track are counted part by part."""
    rows = parted(segments.with_track_key(rows), "seg_no", size)
    keys = rows.groupBy("doc_id", "track_key").agg(F.min("seg_no").alias("_first"), F.min_by(segments.track_name(F.col("entities"), "Narrative"), "seg_no").alias("track_name"))
    keys = keys.select("doc_id", "track_key", "track_name", F.row_number().over(Window.partitionBy("doc_id").orderBy("_first")).alias("track_no"))
    before = Window.partitionBy("doc_id", "track_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = rows.groupBy("doc_id", "part", "track_key").agg(F.count("*").alias("_n"))
    left = left.select("doc_id", "part", "track_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"))
    rows = rows.join(left, ["doc_id", "part", "track_key"]).join(keys, ["doc_id", "track_key"])
    nth = F.col("_n") + F.row_number().over(Window.partitionBy("doc_id", "part", "track_key").orderBy("seg_no"))
    return segments.with_track_ids(rows.withColumn("_nth", nth)).drop("_n", "_nth", "part", "track_key")


def segments_of(rows: DataFrame, model=None, size: int = PART, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """As :func:`segments.segments`, from events of :func:`numbered` that are classified and keep their part; hold keeps what is read more than once."""
    return tracked(hold(segments.typed(segments.candidates(segmented(rows)), model)), size).withColumn("text_order", F.col("seg_no"))
