"""Time segments and tracks: sessions of events by their document's order, and tracks by what segments have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators.dimensions import unknown_id

BREAKS = ("BEFORE", "AFTER", "SIMULTANEOUS")


def goes_on(before: Column, now: Column, cue: Column, relation: Column) -> Column:
    """Whether an event goes on with the segment of the one before: of both, structs of temporal_category, actors and temporal_anchor."""
    a, b = now["temporal_anchor"], before["temporal_anchor"]
    return (
        (before["temporal_category"] == now["temporal_category"])
        & X.same_set(before["actors"], now["actors"])
        & ~((cue != "") & relation.isin(*BREAKS))
        & ((a == "") | (b == "") | (F.upper(a) == F.upper(b)))
    )


def segmented(events: DataFrame) -> DataFrame:
    """events with seg_no: an event goes on with the segment of the one before if category and actors are the same, no cue sets it apart, and anchors don't differ."""
    by_doc = Window.partitionBy("doc_id").orderBy("order")
    state = F.struct("temporal_category", "actors", "temporal_anchor")
    stays = goes_on(F.lag(state).over(by_doc), state, F.col("relation_cue"), F.col("relation_to_previous"))
    rows = events.withColumn("_new", F.when(F.coalesce(stays, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("seg_no", F.sum("_new").over(by_doc).cast("int")).drop("_new")


def candidates(seg_events: DataFrame) -> DataFrame:
    """A row for each segment, from its events in order; with location_id, empty for none, if they have place_id, and with actor_ids if they have them."""
    known = [c for c in ("place_id", "actor_ids") if c in seg_events.columns]
    item = F.struct(
        "order", "text", "actors", "temporal_anchor", "location", "id", "temporal_category", "relation_to_previous", "relation_cue", "relation_evidence", *known
    )
    rows = seg_events.groupBy("doc_id", "lang", "seg_no").agg(F.sort_array(F.collect_list(item)).alias("e"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
    first_of = lambda c, default: F.coalesce(F.get(F.filter(F.transform("e", lambda x: x[c]), lambda v: v != ""), 0), F.lit(default))
    return rows.select(
        "doc_id", "lang", "seg_no", F.concat_ws(" ", F.transform("e", lambda x: x["text"])).alias("text"), X.distinct_ci(F.flatten(F.transform("e", lambda x: x["actors"]))).alias("actors"),
        first_of("temporal_anchor", "").alias("temporal_anchor"), first_of("location", "unknown").alias("location"), F.col("e")[0]["temporal_category"].alias("temporal_category"),
        "span_start", "span_end", F.transform("e", lambda x: x["id"]).alias("event_ids"),
        F.struct(F.col("e")[0]["relation_to_previous"].alias("relation"), F.col("e")[0]["relation_cue"].alias("cue"), F.col("e")[0]["relation_evidence"].alias("evidence")).alias("first_event"),
        *([_place_of(first_of("location", "unknown"))] if "place_id" in known else []),
        # A name has one id in its document, so distinct ids are those of distinct names.
        *([F.array_distinct(F.flatten(F.transform("e", lambda x: x["actor_ids"]))).alias("actor_ids")] if "actor_ids" in known else []),
    )


def _place_of(location: Column) -> Column:
    """The id of the first place that the events e name, or of the unknown place."""
    named = F.get(F.filter("e", lambda x: x["location"] != ""), 0)
    return F.coalesce(named["place_id"], F.when(named.isNull(), unknown_id(location, F.col("lang"))), F.lit("")).alias("location_id")


def typed(rows: DataFrame, model=None) -> DataFrame:
    """rows with type, perspective, entities, confidence and classifier."""
    t, lang, ro = F.col("text"), F.col("lang"), F.col("lang") == "ro"
    rows = rows.withColumn("rule_type", X.segment_type(t, lang))
    if model is None:
        kind, score, source = F.col("rule_type"), F.lit(0.0), F.lit("heuristic_fallback")
    else:
        from storyloom.operators.models import segment_gate

        rows = model(rows)
        gate = segment_gate(F.col("predicted"), F.col("score"), F.col("rule_type"))
        kind, score, source = gate["label"], gate["confidence"], gate["source"]
    rows = rows.withColumns({"type": F.when(ro, F.col("rule_type")).otherwise(kind), "confidence": F.when(ro, F.lit(0.75)).otherwise(score), "classifier": F.when(ro, F.lit("romanian_rule_segment_type")).otherwise(source)})
    rows = rows.withColumn("entities", F.when(F.size("actors") > 0, F.col("actors")).otherwise(X.entities(t, lang)))
    return rows.withColumn("perspective", X.perspective(F.col("type"), t, F.col("entities"), lang)).drop("rule_type", "predicted", "score")


def track_name(names, default: str):
    return F.when(F.size(names) > 0, F.concat_ws("&", F.slice(names, 1, 3))).otherwise(default)


def with_track_key(rows: DataFrame) -> DataFrame:
    """rows with the cues of their texts and track_key. A track is a key of kind, name, category and perspective."""
    t, lang, names = F.col("text"), F.col("lang"), F.col("entities")
    rows = rows.withColumns({"parallel": X.has(t, "parallel", lang), "parallel_cue": X.first(t, "parallel", lang), "joins": X.has(t, "join", lang), "splits": X.has(t, "split", lang)})
    memory = F.col("type") == "REM"
    key = F.concat_ws(
        ":", F.when(F.col("parallel"), "parallel").when(memory, "memory").otherwise("main"),
        F.when(memory & ~F.col("parallel"), track_name(names, "Past")).otherwise(track_name(names, "Narrative")), F.col("temporal_category"), F.col("perspective"),
    )
    return rows.withColumn("track_key", F.upper(key))


def with_track_ids(rows: DataFrame) -> DataFrame:
    """rows, of track_no and their place in the track, with story_order, id and track_id."""
    order = F.col("_nth") - F.when(F.col("type") == "REM", 0.35).otherwise(0.0)
    return rows.withColumns({"story_order": order, "id": F.concat(F.lit("TS"), F.col("seg_no")), "track_id": F.concat(F.lit("TT"), F.col("track_no"))})


def tracked(rows: DataFrame) -> DataFrame:
    """rows with track_no, track_name, story_order and whether a parallel cue is heard. Tracks are numbered by first appearance."""
    by_key = Window.partitionBy("doc_id", "track_key")
    so_far = by_key.orderBy("seg_no")
    name = F.first(track_name(F.col("entities"), "Narrative")).over(so_far)
    rows = with_track_key(rows).withColumns({"_first": F.first("seg_no").over(so_far), "_nth": F.row_number().over(so_far), "track_name": name})
    rows = rows.withColumn("track_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first")))
    return with_track_ids(rows).drop("_first", "_nth", "track_key")


def segments(events: DataFrame, model=None) -> DataFrame:
    """Segments with all that links are made of; text_order is seg_no."""
    return tracked(typed(candidates(segmented(events)), model)).withColumn("text_order", F.col("seg_no"))
