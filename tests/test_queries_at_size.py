"""Queries on stories: what a task holds doesn't grow with the table, and shared relations are made once."""

import random
import re

import pytest
from pyspark.sql import functions as F

from storyloom import queries as Q
from storyloom.functions import lexicon as L
from storyloom.operators import dimensions
from storyloom.plans import render
from storyloom.plans.corpus import Corpus


def test_stories_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    """Partitions grow with the events, and no user is torn apart."""
    monkeypatch.setattr(Q, "EVENTS_A_TASK", 50)
    for n in (400, 1600):
        rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 97).alias("user_id"))
        rows.write.parquet(f"{tmp_path}/{n}/events.parquet")
        docs = Q.stories(spark, f"{tmp_path}/{n}")
        assert docs.rdd.getNumPartitions() == n // 50 + 1
        assert docs.count() == 97 and docs.agg(F.sum(F.length("text"))).first()[0] > 10 * n


def test_held_relations_are_kept_until_release(spark):
    docs = spark.createDataFrame([(1, "Adam went to London. Sarah came.")], "doc_id long, text string")
    c = Corpus(docs, language=None).hold("events", "segments")
    assert c.events.storageLevel.useMemory and c.segments.storageLevel.useMemory and c.segments.count() == 2
    c.release()
    assert not c.events.storageLevel.useMemory and not c.segments.storageLevel.useMemory


def test_grouped_vocabularies_match_alike():
    """Every match of a vocabulary is the same whether its entries are grouped by first letter or not."""
    rnd = random.Random(1)
    for lang, words in (("en", L.EN), ("ro", L.RO), ("compared", L.COMPARED)):
        plain = [re.sub(r"\\s\+", " ", re.sub(r"\\w\+", "walk", re.sub(r"\\d\S*", "12", w))).replace("?", "").replace("\\b", "") for v in words.values() for w in v]
        for name in words:
            a, b = (re.compile("(?i)" + x) for x in (L.cue(name, lang).body, L.cue(name, lang).grouped))
            for _ in range(60):
                text = " ".join(rnd.choice([*plain, "the", "Going to", "before"]) for _ in range(8))
                assert [m.span() for m in a.finditer(text)] == [m.span() for m in b.finditer(text)], (name, text)
    assert L.grouped(["am", "is", "are", r"\w+ed", "as"]) == r"(?:a(?:m|re)|is|\w+ed|as)"


def _above_generate(df):
    """The lines of a plan above the first row generator from the top."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return lines[: next(i for i, line in enumerate(lines) if "Generate" in line)]


def test_links_are_numbered_without_sorting_what_is_exploded(spark):
    """F18, F19, F21."""
    c = Corpus(spark.createDataFrame([(1, "Adam went to London. Meanwhile, Sarah left. Adam met Sarah.")], "doc_id long, text string"), language=None)
    for name in ("relations", "boundaries", "endpoints"):
        df = getattr(c, name)
        assert not [line for line in _above_generate(df) if "Sort" in line or "Window" in line], name
        assert [r.ord for r in df.orderBy("ord").collect()] == list(range(1, df.count() + 1)), name


def test_mentions_are_numbered_without_sorting_what_is_exploded(spark):
    """and persons that are alike in place and text whatever its case are one."""
    row = ("e", "Adam met ADAM and Karl", ["Karl", "Adam", "ADAM", "Eve"], "", "", "met", 1, 10)
    events = spark.createDataFrame([(1, *row)], "doc_id long, id string, text string, actors array<string>, location string, temporal_anchor string, action string, `order` int, span_start int")
    df = dimensions.mentions(events)
    assert not [line for line in _above_generate(df) if "Sort" in line or "Window" in line]
    got = [(r.id, r.text, r.label, r.source[:11], r.span_start, r.span_end) for r in df.orderBy("ord").collect()]
    assert got == [("EM1", "Karl", "PERSON", "capitalized", 28, 32), ("EM2", "Adam", "PERSON", "capitalized", 10, 14), ("EM3", "Eve", "PERSON", "carried_act", 10, 10), ("EM4", "met", "EVENT_ACTION", "verb_patter", 15, 18)]


def test_actor_ids_take_along_only_what_is_asked_for(spark, tmp_path):
    """F15."""
    spark.range(50).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), (F.col("id") % 3).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    df = Q.story_event_actor_ids(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "own_anchor" not in plan and "relation_evidence" not in plan and "cue_later" not in plan
    assert df.count() > 20


def test_kept_events_are_held_once(spark):
    """with their ids, not a second time without them."""
    c = Corpus(spark.createDataFrame([(1, "Adam went to London.")], "doc_id long, text string"), language=None, keep=True)
    assert "place_id" not in c.events.columns and c.identified_segments is c.segments
    assert len(c._kept) == 2
    c.release()


def test_lines_and_items_are_made_of_one_pass(spark):
    """of each part, one row for a document goes on."""
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (None, 1, "c")], "doc_id long, o int, t string")
    df = render._texts([("p", rows, F.col("o"), {"xml": (F.col("t"), "-"), "json": (F.upper("t"), ",")}), ("q", rows.filter("t = 'a'"), F.col("o"), {"json": (F.col("t"), ",")})])
    assert {r.doc_id: r.x for r in df.collect()} == {1: {"xml:p": "a-b", "json:p": "A,B", "json:q": "a"}, None: {"xml:p": "c", "json:p": "C"}}


def reads(df):
    """Whether the plan, with what is cached in it, goes back to files."""
    return "parquet" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("parts", [None, 2])
def test_a_settled_corpus_has_the_same_relations_without_their_plans(spark, tmp_path, parts):
    """each of the fifteen lists of story_json repeated the plan of the events, which took longer to analyse than to run."""
    texts = [(1, "Adam left Paris in 1990. Later Eve met Adam in Rome. They will return tomorrow.", "en"), (2, "Eva a plecat din Iași ieri. Apoi a revenit.", "ro"), (3, "", "en")]
    spark.createDataFrame(texts, "doc_id long, text string, language string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    with Corpus(docs, parts=parts) as plain, Corpus(docs, parts=parts) as settled:
        settled.settled()
        for name in ("documents", "events", "identified_events", "segments", "located_segments", "identified_segments", "relations", "mentions", "analysis"):
            a, b = getattr(plain, name), getattr(settled, name)
            assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name
            assert not reads(b), name


def test_story_json_is_made_of_settled_relations(spark, monkeypatch):
    """F2."""
    monkeypatch.setattr(render, "json", lambda c: c.relations)
    assert not reads(Q.QUERIES["story_json"](spark, "/root/testdata/sf0.001"))
