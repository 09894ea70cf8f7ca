"""Reports by document: counts, averages, distributions, issues and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X

LOW_EVENT, LOW_SEGMENT = 0.55, 0.60

# Issues in order (severity, code, message, evidence).
ISSUES = [
    ("warning", "NO_EVENTS", "No event-like clauses were extracted.", "The input did not match the configured verb and sentence patterns."),
    ("info", "EVENTS_WITHOUT_ACTORS", "{} event(s) do not have an explicit or carried actor.", "Actor extraction uses named-entity candidates and previous-actor carry-forward."),
    ("info", "SEGMENTS_WITHOUT_TIMEX", "{} segment(s) have no explicit temporal anchor.", "Temporal anchors are optional; use TIMEX3 annotations when exact time evidence is needed."),
    ("warning", "NO_SEGMENT_RELATIONS", "Multiple segments were produced without temporal relations.", "The relation layer depends on adjacency and lexical cue detection."),
    ("warning", "LOW_EVENT_CONFIDENCE", "Average event temporal-category confidence is below 0.55.", "Use more temporal cues or train the classifier on an annotated corpus."),
    ("warning", "LOW_SEGMENT_CONFIDENCE", "Average segment type confidence is below 0.60.", "Segment labels fall back to rules when the seed classifier is uncertain."),
]


def count_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """doc_id, key, cnt, rank: values that aren't empty, whatever their case (the first spelling by order stays), most frequent first, then by name."""
    some = rows.filter(F.col(key) != "").groupBy("doc_id", F.upper(key).alias("_k")).agg(F.count("*").cast("int").alias("cnt"), F.min_by(key, order).alias("key"))
    return some.select("doc_id", "key", "cnt", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("cnt").desc(), "_k")).alias("rank"))


def as_map(counts: DataFrame, name: str) -> DataFrame:
    item = F.sort_array(F.collect_list(F.struct("rank", "key", "cnt")))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.transform(item, lambda x: F.struct(x["key"], x["cnt"]))).alias(name))


def _counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.count("*").cast("int").alias(name))


def analysis(docs: DataFrame, events: DataFrame, segments: DataFrame, tracks: DataFrame, relations: DataFrame, mentions: DataFrame, tml_events: DataFrame, timex3: DataFrame, tlinks: DataFrame) -> DataFrame:
    """A row for each document. Averages are rounded to 3 places, halves to even; 0 where there is nothing."""
    out = docs.select("doc_id", X.utf16_length(F.col("text")).alias("character_count"))
    parts = [
        events.groupBy("doc_id").agg(F.count("*").cast("int").alias("event_count"), F.bround(F.avg("confidence"), 3).alias("average_event_confidence"), F.count_if(F.size("actors") == 0).cast("int").alias("events_without_actors")),
        segments.groupBy("doc_id").agg(F.count("*").cast("int").alias("segment_count"), F.bround(F.avg("confidence"), 3).alias("average_segment_confidence"), F.count_if(F.col("temporal_anchor") == "").cast("int").alias("segments_without_anchor")),
        _counts(tracks, "track_count"), _counts(relations, "relation_count"), _counts(tml_events, "time_ml_event_count"), _counts(timex3, "time_ml_timex_count"), _counts(tlinks, "time_ml_tlink_count"),
    ]
    for p in parts:
        out = out.join(p, "doc_id", "left")
    out = out.fillna(0)
    for rows, key, order, name in ((segments, "type", "seg_no", "segment_types"), (events, "temporal_category", "order", "temporal_categories"), (relations, "rel", "ord", "relation_types"), (mentions, "label", "ord", "entity_mention_labels")):
        out = out.join(as_map(count_by(rows, key, order), name), "doc_id", "left").withColumn(name, F.coalesce(name, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))))
    sources = events.select("doc_id", F.col("classifier").alias("s")).unionByName(segments.select("doc_id", F.col("classifier").alias("s"))).unionByName(mentions.select("doc_id", F.col("source").alias("s")))
    sources = sources.filter("s <> ''").groupBy("doc_id", F.upper("s").alias("_k")).agg(F.min("s").alias("s")).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "s"))), lambda x: x["s"]).alias("extraction_sources"))
    return out.join(sources, "doc_id", "left").withColumn("extraction_sources", F.coalesce("extraction_sources", F.array().cast("array<string>")))


def issues(report: DataFrame) -> DataFrame:
    """doc_id, ord, severity, code, message, evidence."""
    low = lambda c, x: (F.col(c) > 0) & (F.col(c) < x)
    when = [
        F.col("event_count") == 0, F.col("events_without_actors") > 0, F.col("segments_without_anchor") > 0, (F.col("segment_count") > 1) & (F.col("relation_count") == 0),
        low("average_event_confidence", LOW_EVENT), low("average_segment_confidence", LOW_SEGMENT),
    ]
    number = {1: "events_without_actors", 2: "segments_without_anchor"}
    rows = []
    for k, (severity, code, message, evidence) in enumerate(ISSUES):
        said = F.concat(F.col(number[k]), F.lit(message[2:])) if k in number else F.lit(message)
        rows.append(F.when(when[k], F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), said.alias("message"), F.lit(evidence).alias("evidence"))))
    return report.select("doc_id", F.posexplode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("ord", "i")).select("doc_id", "ord", "i.*")


# What is said of a text without segments, and notes that every result carries; those of one language come last.
NO_SEGMENTS = "No text segments were detected."
NOTES = [
    "Time segment types follow the paper labels: NAR, REM, SUP, GEN, and FIC.",
    "The XML output follows the paper notation: TT-SECTION, TIME-SECTION, EP-SECTION, and inline TS tags.",
    "The diagram includes a TimeML-style layer with EVENT, TIMEX3, SIGNAL, MAKEINSTANCE, and TLINK annotations.",
]
NOTES_BY = {
    "ro": ["Romanian extraction uses non-LLM rule profiles for Romanian entities, temporal cues, tense, and TimeML-like annotations.", "Romanian mode intentionally avoids the English seed classifiers; train on Romanian annotated data for production use."],
    "en": ["English extraction uses non-LLM rules plus optional seed classifiers for event temporal category and TS type.", "Seed classifiers learn from bundled examples; replace these with an annotated corpus for production use."],
}


def warnings(docs: DataFrame, report: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, warnings: the notes, what is missing, and issues that are more than information."""
    said = found.filter("severity <> 'info'").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.concat_ws(": ", "code", "message").alias("m")))), lambda x: x["m"]).alias("said"))
    notes = lambda k: F.array(*(F.lit(x) for x in NOTES + NOTES_BY[k]))
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", "lang").join(report.select("doc_id", "segment_count"), "doc_id").join(said, "doc_id", "left")
    return rows.select("doc_id", F.concat(F.when(F.col("lang") == "ro", notes("ro")).otherwise(notes("en")), F.when(F.col("segment_count") == 0, F.array(F.lit(NO_SEGMENTS))).otherwise(none), F.coalesce("said", none)).alias("warnings"))


def percent(score):
    """A score as a whole percentage, halves up; n/a if there is none."""
    return F.when(score > 0, F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))).otherwise("n/a")


def event_table(events: DataFrame) -> DataFrame:
    return events.select("doc_id", "order", "id", "temporal_category", "relation_to_previous", F.when(F.col("relation_cue") == "", "-").otherwise(F.col("relation_cue")).alias("cue"), percent(F.col("confidence")).alias("confidence"), "text")


def segment_table(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", "seg_no", "id", "type", "track_id", F.concat_ws(", ", "actors").alias("actors"), F.when(F.col("temporal_anchor") == "", "-").otherwise(F.col("temporal_anchor")).alias("anchor"), F.concat_ws(", ", "event_ids").alias("events"), percent(F.col("confidence")).alias("confidence"))


def timeml_listing(tml_events: DataFrame, timex3: DataFrame, tlinks: DataFrame) -> DataFrame:
    """doc_id, listing: a line for each event, time expression and link."""
    line = lambda *c: F.concat_ws("  ", *c)
    to = F.coalesce("related_to_event_instance", "related_to_time", F.lit(""))
    rows = tml_events.select("doc_id", F.lit(0).alias("s"), F.col("order").alias("o"), line("eid", "text", "class").alias("l"))
    rows = rows.unionByName(timex3.select("doc_id", F.lit(1).alias("s"), F.col("tid_no").alias("o"), line("tid", "text", "type", "value").alias("l")))
    rows = rows.unionByName(tlinks.select("doc_id", F.lit(2).alias("s"), F.col("ord").alias("o"), line("lid", F.concat_ws(" -> ", F.coalesce("event_instance_id", F.lit("")), to), "rel_type").alias("l")))
    all_ = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("s", "o", "l"))).alias("x"))
    part = lambda k: F.transform(F.filter("x", lambda r: r["s"] == k), lambda r: r["l"])
    return all_.select("doc_id", F.rtrim(F.concat_ws("\n", F.concat(F.array(F.lit("EVENT")), part(0), F.array(F.lit(""), F.lit("TIMEX3")), part(1), F.array(F.lit(""), F.lit("TLINK")), part(2)))).alias("listing"))
