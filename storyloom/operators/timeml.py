"""The TimeML layer over events: events, instances, time expressions, signals and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X


def _span(part, text="text"):
    """(start, end, found) of part in an event's text."""
    at = X.index_ci(F.col(text), part)
    start = F.when(at >= 0, F.col("span_start") + at).otherwise(F.col("span_start"))
    return start, at


def tml_events(events: DataFrame) -> DataFrame:
    act = F.when(F.col("action") != "", F.col("action")).otherwise(F.col("text"))
    start, at = _span(F.col("action"))
    held = (F.col("action") != "") & (at >= 0)
    return events.select(
        "doc_id", "order", F.concat(F.lit("e"), "order").alias("eid"), X.event_class(F.col("text"), F.col("action"), F.col("lang")).alias("class"), act.alias("text"),
        F.when(held, start).otherwise(F.col("span_start")).alias("span_start"), F.when(held, start + F.length("action")).otherwise(F.col("span_end")).alias("span_end"), F.col("id").alias("source_event_id"),
    )


def makeinstances(events: DataFrame) -> DataFrame:
    t, lang = F.col("text"), F.col("lang")
    return events.select(
        "doc_id", "order", F.concat(F.lit("ei"), "order").alias("eiid"), F.concat(F.lit("e"), "order").alias("event_id"), X.tense(F.col("temporal_category")).alias("tense"), X.aspect(t, lang).alias("aspect"),
        X.polarity(t, lang).alias("polarity"), F.when(F.col("action") != "", "VERB").otherwise("UNKNOWN").alias("pos"), F.col("id").alias("source_event_id"),
    )


def with_timex(events: DataFrame) -> DataFrame:
    """Events that have an anchor, with tid and whether they are its first."""
    key = F.upper(X.trim(F.col("temporal_anchor")))
    rows = events.filter("temporal_anchor <> ''").withColumn("_key", key).withColumn("_first", F.min("order").over(Window.partitionBy("doc_id", "_key")))
    return rows.withColumn("tid_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_first"))).withColumn("makes", F.col("order") == F.col("_first")).drop("_key", "_first")


def timex3(events: DataFrame) -> DataFrame:
    rows = with_timex(events).filter("makes")
    a = F.col("temporal_anchor")
    start, at = _span(a)
    return rows.select(
        "doc_id", "tid_no", F.concat(F.lit("t"), "tid_no").alias("tid"), X.timex_type(a, F.col("lang")).alias("type"), X.timex_value(a, F.col("temporal_category")).alias("value"), a.alias("text"),
        start.alias("span_start"), F.when(at >= 0, start + F.length(a)).otherwise(start).alias("span_end"),
        F.when(at >= 0, "explicit_temporal_expression").otherwise("inherited_temporal_anchor").alias("source"), F.lit("NONE").alias("function_in_document"),
    )


def signals(events: DataFrame) -> DataFrame:
    rows = events.filter("order > 1 AND relation_cue <> ''").withColumn("sid_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("order")))
    c = F.col("relation_cue")
    start, at = _span(c)
    return rows.select("doc_id", "sid_no", F.concat(F.lit("s"), "sid_no").alias("sid"), c.alias("text"), start.alias("span_start"), F.when(at >= 0, start + F.length(c)).otherwise(start).alias("span_end"), F.col("id").alias("event_id"), F.col("relation_to_previous").alias("relation_hint"))


def tlinks(events: DataFrame) -> DataFrame:
    """Links of events to their time expression, and to the event before, in one sequence."""
    by_doc = Window.partitionBy("doc_id").orderBy("order")
    by_time = Window.partitionBy("doc_id", "_key")
    rows = events.select("doc_id", "order", "relation_to_previous", "relation_cue", F.when(F.col("temporal_anchor") != "", F.upper(X.trim(F.col("temporal_anchor")))).alias("_key"))
    # An expression's number is that of the expressions that began up to its first event.
    rows = rows.withColumn("_first", F.min("order").over(by_time)).withColumn("_begun", F.count_if(F.col("_key").isNotNull() & (F.col("order") == F.col("_first"))).over(by_doc))
    rows = rows.withColumn("tid", F.when(F.col("_key").isNotNull(), F.concat(F.lit("t"), F.min("_begun").over(by_time))))
    marked = (F.col("order") > 1) & (F.col("relation_cue") != "")
    rows = rows.withColumn("sid", F.when(marked, F.concat(F.lit("s"), F.count_if(marked).over(by_doc))))
    here, before, none = F.concat(F.lit("ei"), F.col("order")), F.concat(F.lit("ei"), F.col("order") - 1), F.lit(None).cast("string")
    back = F.col("relation_to_previous") == "BEFORE"
    rel = F.when(F.col("relation_to_previous").isin("BEFORE", "AFTER"), "BEFORE").when(F.col("relation_to_previous") == "SIMULTANEOUS", "SIMULTANEOUS").otherwise("IBEFORE")
    row = lambda k, r, a, b, t, s, o: F.struct(F.lit(k).alias("k"), r.alias("rel_type"), a.alias("event_instance_id"), b.alias("related_to_event_instance"), none.alias("time_id"), t.alias("related_to_time"), s.alias("signal_id"), o.alias("origin"))
    two = F.array(
        F.when(F.col("tid").isNotNull(), row(0, F.lit("IS_INCLUDED"), here, none, F.col("tid"), none, F.lit("event_temporal_anchor"))),
        F.when(F.col("order") > 1, row(1, rel, F.when(back, here).otherwise(before), F.when(back, before).otherwise(here), none, F.col("sid"), F.when(F.col("sid").isNull(), "event_text_order").otherwise("event_relation_signal"))),
    )
    out = rows.select("doc_id", "order", F.explode(F.filter(two, lambda x: x.isNotNull())).alias("l"))
    lid = F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "l.k"))
    return out.select("doc_id", lid.alias("ord"), F.concat(F.lit("l"), lid).alias("lid"), *(f"l.{c}" for c in ("rel_type", "event_instance_id", "related_to_event_instance", "time_id", "related_to_time", "signal_id", "origin")))
