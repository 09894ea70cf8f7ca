"""Relations, boundaries, endpoints and tracks, from segments in their document's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Evidence and reasons.
CROSS_PARALLEL = "Parallel cue triggered a cross-track relation."
CROSS = "Adjacent text segments belong to different time tracks."
REASONS = {
    "START": "First TS in text order.",
    "RUPTURE": "Adjacent text segments belong to different time tracks.",
    "COMMUTE": "Story remains on the same time track but changes temporal category, TS type, or perspective.",
    "JOIN": "Text indicates that separate developments meet and continue together.",
    "SPLIT": "Text indicates separation, disappearance, or an actor continuing alone.",
    "STOP": "Last TS in text order.",
}


def chained(segments: DataFrame) -> DataFrame:
    """segments with what the one before them was, and whether they are last."""
    by_doc = Window.partitionBy("doc_id").orderBy("seg_no")
    before = {f"prev_{c}": F.lag(c).over(by_doc) for c in ("id", "track_id", "track_name", "type", "perspective", "temporal_category")}
    return segments.withColumns(before | {"is_last": F.lead("id").over(by_doc).isNull()}).withColumn("ruptures", F.col("prev_track_id") != F.col("track_id"))


def unfolded(rows: DataFrame, items: Column, order: str) -> DataFrame:
    """rows with an ``r`` for each of their items, and ``ord``, its number in the document. Counted before the rows are exploded, in the order they lie in: what is exploded isn't sorted."""
    before = Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_r", items).withColumn("_before", F.coalesce(F.sum(F.size("_r")).over(before), F.lit(0)))
    return rows.select(*(c for c in rows.columns if c not in ("_r", "_before")), "_before", F.posexplode("_r").alias("_k", "r")).withColumn("ord", (F.col("_before") + F.col("_k") + 1).cast("int")).drop("_before", "_k")


def relations(chain: DataFrame) -> DataFrame:
    """doc_id, ord, from_id, rel, to_id, cue, evidence: between neighbours, and between their tracks if these differ."""
    cue = F.col("first_event")
    backward, same = cue["relation"] == "BEFORE", cue["relation"] == "SIMULTANEOUS"
    rel = F.when(backward, "BEFORE").when(same, "SIMULTANEOUS").when(cue["relation"] == "AFTER", "BEFORE").otherwise("IMMEDIATELY_BEFORE")
    row = lambda a, r, b, c, e: F.struct(a.alias("from_id"), r.alias("rel"), b.alias("to_id"), c.alias("cue"), e.alias("evidence"))
    one = row(F.when(backward, F.col("id")).otherwise(F.col("prev_id")), rel, F.when(backward, F.col("prev_id")).otherwise(F.col("id")), cue["cue"], cue["evidence"])
    par = F.col("parallel")
    two = row(F.col("prev_track_id"), F.when(par, "SIMULTANEOUS").otherwise("BEFORE"), F.col("track_id"), F.col("parallel_cue"), F.when(par, CROSS_PARALLEL).otherwise(CROSS))
    items = F.when(F.col("ruptures"), F.array(one, two)).otherwise(F.array(one))
    rows = unfolded(chain.filter("prev_id IS NOT NULL").select("doc_id", "seg_no", items.alias("items")), F.col("items"), "seg_no")
    return rows.select("doc_id", "ord", "r.from_id", "r.rel", "r.to_id", "r.cue", "r.evidence")


def _pair():
    """The tracks of the segment before and of this one, or this one's alone if they are the same."""
    return F.when(F.coalesce(F.col("ruptures"), F.lit(False)), F.array("prev_track_id", "track_id")).otherwise(F.array("track_id"))


def boundaries(chain: DataFrame) -> DataFrame:
    """doc_id, ord, id, type, from_segment_id, to_segment_id, track_ids, reason."""
    rupt = F.coalesce(F.col("ruptures"), F.lit(False))
    start = F.col("prev_id").isNull()
    commute = ~start & ~rupt & ((F.col("prev_type") != F.col("type")) | (F.col("prev_perspective") != F.col("perspective")) | (F.col("prev_temporal_category") != F.col("temporal_category")))
    own, none = F.array("track_id"), F.lit(None).cast("string")
    row = lambda kind, a, b, t, on: F.when(on, F.struct(F.lit(kind).alias("type"), a.alias("a"), b.alias("b"), t.alias("track_ids"), F.lit(REASONS[kind]).alias("reason")))
    here, before = F.col("id"), F.col("prev_id")
    rows = F.array(
        row("START", none, here, own, start), row("RUPTURE", before, here, _pair(), rupt), row("COMMUTE", before, here, own, commute),
        row("JOIN", before, here, _pair(), F.col("joins") & rupt), row("SPLIT", before, here, _pair(), F.col("splits")), row("STOP", here, none, own, F.col("is_last")),
    )
    out = unfolded(chain.select("doc_id", "seg_no", F.filter(rows, lambda x: x.isNotNull()).alias("items")), F.col("items"), "seg_no")
    return out.select("doc_id", "ord", F.concat(F.lit("B"), "ord").alias("id"), "r.type", F.col("r.a").alias("from_segment_id"), F.col("r.b").alias("to_segment_id"), "r.track_ids", "r.reason")


def endpoints(chain: DataFrame) -> DataFrame:
    """doc_id, ord, id, type, name, track_ids, segment_id."""
    rupt = F.coalesce(F.col("ruptures"), F.lit(False))
    row = lambda kind, name, on: F.when(on, F.struct(F.lit(kind).alias("type"), name.alias("name"), _pair().alias("track_ids")))
    rows = F.array(row("JOIN", F.concat_ws("+", "prev_track_name", "track_name"), F.col("joins") & rupt), row("SPLIT", F.concat(F.col("track_name"), F.lit(" split")), F.col("splits")))
    out = unfolded(chain.select("doc_id", "seg_no", F.col("id").alias("segment_id"), F.filter(rows, lambda x: x.isNotNull()).alias("items")), F.col("items"), "seg_no")
    return out.select("doc_id", "ord", F.concat(F.lit("EP"), "ord").alias("id"), "r.type", "r.name", "r.track_ids", "segment_id")


def tracks(chain: DataFrame) -> DataFrame:
    """doc_id, track_no, id, name, left_endpoint, right_endpoint: START and STOP unless endpoints say otherwise, the last of them. One pass over the chain."""
    rupt = F.coalesce(F.col("ruptures"), F.lit(False))
    n = (F.col("joins") & rupt).cast("int") + F.col("splits").cast("int")
    rows = chain.withColumn("_n", n).withColumn("_ep", F.sum("_n").over(Window.partitionBy("doc_id").orderBy("seg_no")))  # the last endpoint so far
    own = F.struct(F.col("track_id").alias("id"), F.col("track_no").alias("no"), F.struct(F.col("seg_no").cast("long").alias("seg_no"), F.col("track_name").alias("name")).alias("named"), F.lit(None).cast("string").alias("side"))
    write = lambda t, s: F.struct(t.alias("id"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("struct<seg_no:bigint,name:string>").alias("named"), F.lit(s).alias("side"))
    wrote = F.when(n == 0, F.array(own)).when(rupt, F.array(own, write(F.col("prev_track_id"), "right"), write(F.col("track_id"), "left"))).otherwise(F.array(own, write(F.col("track_id"), "right")))
    out = rows.select("doc_id", "_ep", F.explode(wrote).alias("w")).groupBy("doc_id", F.col("w.id").alias("id")).agg(
        F.max("w.no").alias("track_no"), F.min("w.named").alias("named"), *(F.max(F.when(F.col("w.side") == s, F.col("_ep"))).alias(s) for s in ("left", "right"))
    )
    end = lambda s, none: F.coalesce(F.concat(F.lit("EP"), s), F.lit(none)).alias(f"{s}_endpoint")
    return out.select("doc_id", "track_no", "id", F.col("named.name").alias("name"), end("left", "START"), end("right", "STOP"))
