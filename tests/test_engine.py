"""The narrative engine on fixtures with known relations."""

import json
import xml.etree.ElementTree as ET

import pytest

from storyloom import queries
from storyloom.functions import text as X
from storyloom.operators import comparison, events, models, report
from storyloom.plans import render
from storyloom.plans.corpus import Corpus
from storyloom.sources import requests
from storyloom.streaming import batches

ENGLISH = (
    "Adam and Johan grew up in the same house. Years earlier, Karl had carried Adam through the rain. Margaret remembered her mother in Jakarta. "
    "Meanwhile, Karl traveled alone across the island. Adam searched for Margaret after the storm. Margaret found Adam at the doorway. Adam disappeared before dawn."
)
ROMANIAN = (
    "Adam și Johan au crescut în aceeași casă. Cu ani în urmă, Karl l-a dus pe Adam prin ploaie. Margaret și-a amintit de mama ei în Jakarta. "
    "Între timp, Karl a călătorit singur pe insulă. Adam a căutat-o pe Margaret după furtună. Margaret l-a găsit pe Adam la ușă. Adam a dispărut înainte de zori."
)
ARTICLE = "This is Adam. He came to live in this house when he was five years old. Now he is sixteen and he has no memory of his life before he came here."
MIXED = (
    "Last week, John played tennis with Bill. He won by three to two. While Sarah waited in the kitchen, Mark called from London. "
    "Tomorrow, Sarah will meet Mark at the station before they leave for Paris."
)


EMOJI = "😀 Adam left. The end, at last, he waited, once more."


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, ENGLISH, "en"), (2, ROMANIAN, " Romanian "), (3, "Silence here", "en"), (4, ARTICLE, None), (5, MIXED, "xx"), (6, None, "en"), (7, "...", "en"), (8, EMOJI, "en")]
    return Corpus(spark.createDataFrame(rows, "doc_id long, text string, language string"), keep=True)


def rows_of(df, doc, order, *columns):
    return [tuple(r[c] for c in columns) for r in df.filter(f"doc_id = {doc}").orderBy(order).collect()]


def test_events(corpus):
    assert rows_of(corpus.events, 1, "order", "span_start", "span_end", "actors", "location", "temporal_anchor", "action", "relation_to_previous", "relation_cue", "temporal_category") == [
        (0, 41, ["Adam", "Johan"], "the same house", "", "grew", "NONE", "", "Past"),
        (42, 96, ["Karl", "Adam"], "", "Years earlier", "had", "BEFORE", "Years earlier", "Past"),
        (97, 139, ["Margaret"], "Jakarta", "Years earlier", "remembered", "IMMEDIATELY_AFTER", "", "Past"),
        (140, 189, ["Karl"], "", "Years earlier", "traveled", "SIMULTANEOUS", "Meanwhile", "Past"),
        (190, 233, ["Adam", "Margaret"], "", "after the storm", "searched", "AFTER", "after the storm", "Past"),
        (234, 269, ["Margaret", "Adam"], "the doorway", "after the storm", "found", "IMMEDIATELY_AFTER", "", "Past"),
        (270, 299, ["Adam"], "", "before dawn", "disappeared", "IMMEDIATELY_AFTER", "", "Past"),
    ]
    assert rows_of(corpus.events, 1, "order", "text")[1] == ("Years earlier, Karl had carried Adam through the rain.",)


def test_segments_and_tracks(corpus):
    assert rows_of(corpus.located_segments, 1, "seg_no", "id", "track_id", "track_name", "type", "perspective", "event_ids", "location_id") == [
        ("TS1", "TT1", "Adam&Johan", "NAR", "narrator", ["EV1"], "L2"), ("TS2", "TT2", "Karl&Adam", "REM", "Karl", ["EV2"], "L1"), ("TS3", "TT3", "Margaret", "REM", "Margaret", ["EV3"], "L3"),
        ("TS4", "TT4", "Karl", "NAR", "narrator", ["EV4"], "L1"), ("TS5", "TT5", "Adam&Margaret", "NAR", "narrator", ["EV5", "EV6"], "L4"), ("TS6", "TT6", "Adam", "NAR", "narrator", ["EV7"], "L1"),
    ]
    assert rows_of(corpus.tracks, 1, "track_no", "id", "left_endpoint", "right_endpoint") == [("TT1", "START", "STOP"), ("TT2", "START", "STOP"), ("TT3", "START", "EP1"), ("TT4", "EP1", "EP2"), ("TT5", "EP2", "EP3"), ("TT6", "EP3", "STOP")]
    assert rows_of(corpus.segments, 4, "seg_no", "story_order") == [(1.0,), (1.0,), (2.0,), (2.0,)]


def test_links(corpus):
    assert rows_of(corpus.relations, 1, "ord", "from_id", "rel", "to_id", "cue") == [
        ("TS2", "BEFORE", "TS1", "Years earlier"), ("TT1", "BEFORE", "TT2", ""), ("TS2", "IMMEDIATELY_BEFORE", "TS3", ""), ("TT2", "BEFORE", "TT3", ""), ("TS3", "SIMULTANEOUS", "TS4", "Meanwhile"),
        ("TT3", "SIMULTANEOUS", "TT4", "Meanwhile"), ("TS4", "BEFORE", "TS5", "after the storm"), ("TT4", "BEFORE", "TT5", ""), ("TS5", "IMMEDIATELY_BEFORE", "TS6", ""), ("TT5", "BEFORE", "TT6", ""),
    ]
    assert rows_of(corpus.endpoints, 1, "ord", "id", "type", "name", "segment_id") == [("EP1", "SPLIT", "Karl split", "TS4"), ("EP2", "JOIN", "Karl+Adam&Margaret", "TS5"), ("EP3", "SPLIT", "Adam split", "TS6")]
    assert [r[0] for r in rows_of(corpus.boundaries, 1, "ord", "type")] == ["START", "RUPTURE", "RUPTURE", "RUPTURE", "SPLIT", "RUPTURE", "JOIN", "RUPTURE", "SPLIT", "STOP"]
    assert [r[0] for r in rows_of(corpus.boundaries, 4, "ord", "type")] == ["START", "RUPTURE", "RUPTURE", "RUPTURE", "STOP"]


def test_timeml(corpus):
    assert [r[0] for r in rows_of(corpus.tml_events, 1, "order", "class")] == ["OCCURRENCE", "I_STATE", "I_STATE", "OCCURRENCE", "OCCURRENCE", "OCCURRENCE", "OCCURRENCE"]
    assert rows_of(corpus.timex3, 1, "tid_no", "tid", "type", "value", "span_start", "span_end") == [("t1", "DATE", "PAST_REF", 42, 55), ("t2", "DATE", "PAST_REF", 217, 232), ("t3", "TIME", "PAST_REF", 287, 298)]
    assert [r[0] for r in rows_of(corpus.makeinstances, 1, "order", "aspect")] == ["NONE", "PERFECTIVE"] + ["NONE"] * 5
    assert rows_of(corpus.signals, 1, "sid_no", "sid", "event_id", "relation_hint") == [("s1", "EV2", "BEFORE"), ("s2", "EV4", "SIMULTANEOUS"), ("s3", "EV5", "AFTER")]
    assert len(rows_of(corpus.tlinks, 1, "ord", "lid")) == 12
    assert rows_of(corpus.tlinks, 1, "ord", "rel_type", "event_instance_id", "related_to_event_instance", "related_to_time", "signal_id")[:2] == [("IS_INCLUDED", "ei2", None, "t1", None), ("BEFORE", "ei2", "ei1", None, "s1")]


def test_dimensions(corpus):
    assert rows_of(corpus.actors, 1, "n", "id", "name") == [("A0", "Narrator"), ("A1", "Adam"), ("A2", "Johan"), ("A3", "Karl"), ("A4", "Margaret")]
    assert [r[0] for r in rows_of(corpus.locations, 1, "n", "name")] == ["unknown", "the same house", "Jakarta", "the doorway"]
    assert len(rows_of(corpus.mentions, 1, "ord", "id")) == 24
    assert rows_of(corpus.mentions, 1, "ord", "text", "label", "span_start")[6] == ("Years earlier", "DATE_TIME", 42)


def test_romanian(corpus):
    assert rows_of(corpus.events, 2, "order", "actors", "location", "action", "relation_to_previous", "confidence") == [
        (["Adam", "Johan"], "aceeași casă", "crescut", "NONE", 0.75), (["Karl", "Adam"], "urmă", "dus", "BEFORE", 0.75), (["Margaret"], "Jakarta", "amintit", "IMMEDIATELY_AFTER", 0.75),
        (["Karl"], "insulă", "călătorit", "SIMULTANEOUS", 0.75), (["Adam", "Margaret"], "Margaret după", "căutat", "AFTER", 0.75), (["Margaret", "Adam"], "ușă", "găsit", "IMMEDIATELY_AFTER", 0.75),
        (["Adam"], "", "dispărut", "BEFORE", 0.75),
    ]
    assert [r[0] for r in rows_of(corpus.segments, 2, "seg_no", "type")] == ["NAR", "NAR", "REM", "NAR", "NAR", "NAR"]
    assert rows_of(corpus.actors, 2, "n", "name")[0] == ("Narator",) and rows_of(corpus.locations, 2, "n", "name")[0] == ("necunoscut",)
    assert rows_of(corpus.located_segments, 2, "seg_no", "location_id")[-1] == ("",)


def test_other_texts(corpus):
    assert [r[0] for r in rows_of(corpus.events, 4, "order", "text")] == ["This is Adam.", "He came to live in this house", "he was five years old.", "Now he is sixteen", "he has no memory of his life before he came here."]
    assert [r[0] for r in rows_of(corpus.events, 5, "order", "actors")] == [["John", "Bill"], ["While Sarah"], ["Mark"], ["Sarah", "Mark", "Paris"]]
    assert [r[0] for r in rows_of(corpus.events, 5, "order", "temporal_category")] == ["Past", "Past", "Past", "Future"]
    for empty in (3, 6, 7):
        assert rows_of(corpus.events, empty, "order", "id") == []
    assert rows_of(corpus.events, 8, "order", "text", "span_start") == [("😀 Adam left.", 0), ("The end, at last, he waited, once more.", 13)]


def test_report(corpus):
    r = corpus.analysis.filter("doc_id = 1").first()
    assert (r.character_count, r.event_count, r.segment_count, r.track_count, r.relation_count, r.time_ml_timex_count, r.time_ml_tlink_count) == (299, 7, 6, 6, 10, 3, 12)
    assert list(r.segment_types.items()) == [("NAR", 4), ("REM", 2)] and r.entity_mention_labels == {"PERSON": 11, "EVENT_ACTION": 7, "DATE_TIME": 3, "LOCATION": 3}
    assert corpus.analysis.filter("doc_id = 8").first().character_count == len(EMOJI) + 1
    assert [x[0] for x in rows_of(corpus.issues, 3, "ord", "code")] == ["NO_EVENTS"]
    assert corpus.warnings.filter("doc_id = 3").first().warnings[-2:] == ["No text segments were detected.", "NO_EVENTS: No event-like clauses were extracted."]
    listing = report.timeml_listing(corpus.tml_events, corpus.timex3, corpus.tlinks).filter("doc_id = 1").first().listing
    assert listing.startswith("EVENT\ne1  grew  OCCURRENCE\n") and "\n\nTIMEX3\nt1  Years earlier  DATE  PAST_REF\n" in listing and "l2  ei2 -> ei1  BEFORE" in listing


def test_invariants(corpus):
    for doc in (1, 2, 4, 5, 8):
        n_seg, n_ev = corpus.segments.filter(f"doc_id = {doc}").count(), corpus.events.filter(f"doc_id = {doc}").count()
        assert corpus.relations.filter(f"doc_id = {doc} AND from_id LIKE 'TS%'").count() == n_seg - 1
        assert corpus.boundaries.filter(f"doc_id = {doc}").count() >= 2
        anchored = corpus.events.filter(f"doc_id = {doc} AND temporal_anchor <> ''").count()
        assert corpus.tlinks.filter(f"doc_id = {doc}").count() == anchored + n_ev - 1


def test_xml(corpus):
    text = render.xml(corpus, "STORY", "ref").filter("doc_id = 1").first().xml
    root = ET.fromstring(text.encode())
    assert root.tag == "STORY" and {c.tag: len(c) for c in root} == {
        "TA-SECTION": 5, "TL-SECTION": 4, "ENTITY-MENTION-SECTION": 24, "EVENT-SECTION": 7, "TIMEML-SECTION": 32, "TT-SECTION": 6, "TIME-SECTION": 10, "EP-SECTION": 3, "POINT-SECTION": 10, "BODY": 6,
    }
    lines = text.split("\n")
    assert lines[:4] == ['<?xml version="1.0" encoding="utf-8"?>', "<STORY>", "  <TA-SECTION>", '    <TA ID="A0" NAME="Narrator" />'] and text.endswith("</STORY>\n")
    assert '    <TREL ID="TI3" FROM="TS2" REL="IMMEDIATELY-BEFORE" TO="TS3" CUE="" EVIDENCE="No explicit cue; defaulting to text-order adjacency." />' in lines
    assert '    <TT ID="TT1" NAME="Adam&amp;Johan" LEFT-EP="START" RIGHT-EP="STOP" />' in lines


def test_svg_and_layout(corpus):
    drawn = {r.doc_id: r for r in render.svg(corpus, highlight=("adam",)).collect()}
    assert (drawn[1].width, drawn[1].height) == (1200, 864)
    ET.fromstring(drawn[1].svg)
    assert 'stroke-width="5"' in drawn[1].svg and "No segments detected" in drawn[3].svg
    assert {(r.width, r.height) for r in render.svg(corpus, "text_order", 100).filter("doc_id = 1").collect()} == {(720, 322)}
    assert [r.y for r in render.layout(corpus).filter("doc_id = 1").orderBy("row").collect()] == [158.0 + 86 * k for k in range(6)]


def test_json(corpus):
    r = {x.doc_id: json.loads(x.json) for x in render.json(corpus).collect()}
    assert list(r[1]) == ["id", "model_version", "diagram", "analysis", "render", "xml", "warnings"]
    assert len(r[1]["diagram"]["events"]) == 7 and len(r[1]["diagram"]["time_ml"]["tlinks"]) == 12 and "time_id" not in r[1]["diagram"]["time_ml"]["tlinks"][0]
    assert r[1]["analysis"]["segment_types"] == {"NAR": 4, "REM": 2} and list(r[1]["analysis"]["entity_mention_labels"]) == ["PERSON", "EVENT_ACTION", "DATE_TIME", "LOCATION"] and r[3]["analysis"]["issues"][0]["code"] == "NO_EVENTS" and r[3]["diagram"]["events"] == []


def test_validation(spark):
    rows = [(1, " \n", None, None), (2, "x", "circle", None), (3, "x", "both", "fr"), (4, "x", " ", "Română"), (5, None, "both", "en"), (6, "x", None, "")]
    got = requests.validate(spark.createDataFrame(rows, "doc_id long, text string, layout string, language string"))
    assert {r.doc_id: r.error for r in got.collect()} == {1: requests.NO_TEXT, 2: requests.BAD_LAYOUT, 3: requests.BAD_LANGUAGE, 4: None, 5: requests.NO_TEXT, 6: None}
    valid, rejected = requests.split_valid(got)
    assert (valid.count(), rejected.count()) == (2, 4)
    bodies = spark.createDataFrame([(1, '{"text": "Adam left.", "options": {"language": "ro"}}'), (2, "[1]"), (3, None)], "doc_id long, body string")
    assert {r.doc_id: (r.error, r.language) for r in requests.parse(bodies).collect()} == {1: (None, "ro"), 2: (requests.NO_BODY, "en"), 3: (requests.NO_BODY, "en")}


def test_reading(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"text": ENGLISH, "options": {"width": 900}}))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "x", "text": ARTICLE}]))
    r = requests.read_requests(spark, str(tmp_path / "a.json")).first()
    assert (r.text, r.width, r.layout, r.language) == (ENGLISH, 900, "both", "en")
    assert requests.read_corpus(spark, str(tmp_path / "c.json")).first().doc_id == "x"


def test_saved_counts(corpus):
    r = requests.saved_counts(render.json(corpus)).filter("doc_id = 1").first()
    assert (r.events, r.person_entities, r.location_entities, r.temporal_anchors, r.temporal_relations, r.time_segments, r.time_tracks) == (7, 4, 3, 6, 10, 6, 6)


def test_comparison(spark):
    docs = spark.createDataFrame([("a", ENGLISH), ("b", ARTICLE), ("c", MIXED)], "doc_id string, text string")
    assert {r.doc_id: tuple(r)[1:] for r in comparison.counts(docs).collect()} == {"a": (7, 57, 11, 5, 3, 3, 3, 7, 6, 6, 6), "b": (3, 35, 5, 1, 1, 3, 2, 4, 3, 2, 2), "c": (4, 43, 14, 6, 4, 4, 3, 5, 4, 4, 4)}
    assert {r.status for r in comparison.java_tool_runs(docs, "heideltime").collect()} == {"unavailable"}
    assert "article_rules_no_llm | a |" in comparison.report(comparison.rule_runs(docs))


def test_gates(spark):
    from pyspark.sql import functions as F

    rows = [("Past", 0.9, "Present"), ("Past", 0.5, "Present"), ("Future", 0.99, "Past"), ("Odd", 0.9, "Past"), (None, None, "Past")]
    df = spark.createDataFrame(rows, "p string, s double, r string")
    got = [tuple(x[0]) for x in df.select(models.category_gate(F.col("p"), F.col("s"), F.col("r"))).collect()]
    assert got == [
        ("Past", 0.9, "mlnet_event_temporal_model"), ("Present", 0.0, "heuristic_fallback_low_ml_confidence"), ("Past", 0.0, "heuristic_fallback_explicit_tense"),
        ("Past", 0.0, "heuristic_fallback_unknown_ml_label"), ("Past", 0.0, "heuristic_fallback"),
    ]
    df = spark.createDataFrame([("GEN", 0.95, "REM"), ("GEN", 0.8, "REM"), ("GEN", 0.7, "NAR")], "p string, s double, r string")
    assert [tuple(x[0])[::2] for x in df.select(models.segment_gate(F.col("p"), F.col("s"), F.col("r"))).collect()] == [("GEN", "mlnet_seed_model"), ("REM", "heuristic_fallback_conflict"), ("GEN", "mlnet_seed_model")]


def test_models(spark):
    for make, seeds in ((models.category_model, models.CATEGORY_SEEDS), (models.type_model, models.TYPE_SEEDS)):
        got = make(spark)(models.seeds(spark, seeds)).collect()
        assert sum(r.predicted == r.label for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_text_functions(spark):
    from pyspark.sql import functions as F

    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.label(F.lit("a" * 44))) == "a" * 44 and one(X.label(F.lit("a" * 45))) == "a" * 43 + "..."
    assert one(X.escape(F.lit("<â & ș\"'>"))) == "&lt;&#226; &amp; ș&quot;&#39;&gt;"
    assert one(X.timex_value(F.lit("before snow"), F.lit("Past"))) == "PRESENT_REF" and one(X.timex_value(F.lit("in 1999"), F.lit("Past"))) == "1999"
    assert one(X.polarity(F.lit("He didn't go"))) == "POS" and one(X.polarity(F.lit("He did not go"))) == "NEG"
    assert one(X.distinct_ci(F.array(F.lit("A"), F.lit("a"), F.lit("b")))) == ["A", "b"]
    assert one(events.sentence_split(F.lit(" One.  Two! Three"))) == ["One.", "Two!", "Three"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, ENGLISH), (2, ARTICLE)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    batches.write_relations(stream, str(tmp_path / "out"), str(tmp_path / "check"), ("events", "segments"), once=True, make=lambda df: Corpus(df, language=None)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "events")).count() == 12


def test_entry_points():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


def test_distinct_lists_and_starts_match_plain_loops(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(31)
    rows = [(k, [rnd.choice(["a", "A", "b", "Éa", "éA", "", "c d", "C d"]) for _ in range(rnd.choice([0, 1, 2, 7, 300, 700]))]) for k in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "k int, x array<string>")
    for r in df.select("x", X.distinct_ci(F.col("x")).alias("d"), X.starts("x").alias("s")).collect():
        if r.x is None:
            assert r.d is None
            continue
        seen, first, at, begins = set(), [], 0, []
        for x in r.x:
            if x.upper() not in seen:
                first.append(x)
            seen.add(x.upper())
            begins.append(at)
            at += len(x)
        assert r.d == first and r.s == begins


def test_sentences_of_a_long_text(spark):
    text = "".join(f"Adam left {'x' * (k % 5)}. " for k in range(3000))
    got = events.sentences(events.documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), language=None)).orderBy("sent_no").collect()
    assert len(got) == 3000 and all(text[r.start :].startswith(r.sentence) for r in got) and [r.start for r in got] == sorted({r.start for r in got})


def test_what_a_corpus_holds_is_freed(spark):
    docs = spark.createDataFrame([(1, ENGLISH, "en")], "doc_id long, text string, language string")
    with Corpus(docs, keep=True) as c:
        assert c.segments.count() == 6 and c.events.is_cached and c.segments.is_cached
    assert not c.events.is_cached and not c.segments.is_cached and c.segments.count() == 6


def test_toolkits_fall_back_to_patterns():
    from storyloom.operators import toolkits as T

    rows = [
        T.Sentence("Adam met Karl in the house yesterday.", ["meet"], [("Adam", "PERSON"), ("ADAM", "PERSON"), ("Karl", "PERSON")]),
        T.Sentence("A house.", [], [("house", "FAC")]),
        T.Sentence("Then karl and Adam left Paris on Monday.", ["leave"], [("karl", "PERSON"), ("Adam", "PERSON"), ("Paris", "GPE"), ("Monday", "DATE")]),
        T.Sentence("Karl will return.", ["return"], [("Karl", "PER")]),
    ]
    counts, shown = T.tally(rows, 23, [label for s in rows for _, label in s.entities])
    assert counts == [4, 23, 9, 6, 2, 1, 2, 3, 2, 2, 2]
    assert [(e["locations"], e["temporal_anchors"], e["temporal_category"], e["relation_to_previous"]) for e in shown["events"]] == [
        (["the house yesterday"], ["yesterday"], "Past", None), (["Paris"], ["Monday"], "Past", "AFTER"), ([], [], "Future", "IMMEDIATELY_BEFORE"),
    ]
    assert shown["segments"] == [["Adam met Karl in the house yesterday.", "Then karl and Adam left Paris on Monday."], ["Karl will return."]]


def test_runs_carry_examples_and_times(spark):
    docs = events.documents(spark.createDataFrame([("a", ARTICLE), ("b", "")], "doc_id string, text string"), language=None)
    runs = {r.sample_id: r for r in comparison.rule_runs(docs).collect()}
    shown = json.loads(runs["a"].examples)
    assert len(shown["events"]) == runs["a"].events == 4 and sum(map(len, shown["segments"])) == 4 and shown["events"][0]["relation_to_previous"] is None
    assert json.loads(runs["b"].examples) == {"events": [], "segments": []} and runs["a"].runtime_ms > 0
    assert comparison.report(comparison.rule_runs(docs, 1.5)).count("| 1.50 |") == 2
