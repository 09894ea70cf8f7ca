"""Documents cut in parts give the relations of whole ones; long sentences fold in linear time."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.plans.corpus import Corpus

NAMES = ["Adam", "Sarah", "Karl and Johan", "He", "They", "Maria", "ADAM"]
TEMPLATES = [
    "{n} walked in London.", "Years earlier, {n} had carried the lamp.", "Meanwhile, {n} met Paul at the station.", "It was raining.", "Tomorrow {n} will go.", "Rain and wind.",
    "{n} remembered the old house, and then opened the door.", "{n} left before dawn, but Sarah waited in Jakarta.", "In 1999 they lived near the river.", "Later {n} found the key.",
]
RELATIONS = ["events", "segments", "located_segments", "identified_events", "identified_segments"]


@pytest.fixture(scope="module")
def docs(spark):
    rnd = random.Random(51)
    rows = [(k, " ".join(rnd.choice(TEMPLATES).format(n=rnd.choice(NAMES)) for _ in range(n)), rnd.choice(["en", "ro", None])) for k, n in enumerate([0, 1, 2, 3, 7, 40, 150])]
    return spark.createDataFrame([*rows, (None, "Adam went. Sarah came.", "en"), (99, None, "en")], "doc_id long, text string, language string").where("doc_id IS NOT NULL")


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("size", [1, 3, 256])
def test_parts_give_the_same_relations(docs, size):
    whole = Corpus(docs)
    with Corpus(docs, parts=size) as cut:
        for name in RELATIONS:
            a, b = getattr(whole, name), getattr(cut, name)
            columns = sorted(a.columns)
            assert columns == sorted(b.columns)
            assert rows_of(a, columns) == rows_of(b, columns), name


def test_kept_relations_are_the_same(docs):
    """keep=True takes segments from events with ids; what others read of them doesn't change."""
    whole = Corpus(docs)
    for options in ({"keep": True}, {"keep": True, "parts": 2}):
        with Corpus(docs, **options) as kept:
            for name in (*RELATIONS, "relations", "tracks"):
                columns = sorted(getattr(whole, name).columns)
                assert rows_of(getattr(whole, name), columns) == rows_of(getattr(kept, name), columns), name


def test_a_long_document_is_dealt_evenly(spark):
    """Of one document's events no task gets more than twice the median."""
    sents = spark.range(40_000).select(
        F.lit(1).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.col("id").alias("sent_no"), F.concat(F.lit("Adam met Sarah"), F.lit(".")).alias("sentence"), (F.col("id") * 20).alias("start")
    )
    with Corpus.of_sentences(sents, parts=64) as c:
        e = c._parted.repartition(8, "doc_id", "part").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = sorted(r["count"] for r in e)
        assert sum(sizes) == 40_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
        last = c.events.agg(F.max("order"), F.count_distinct("order")).first()
        assert tuple(last) == (40_000, 40_000)
        assert c.segments.count() == 1


def test_a_sentence_of_many_clauses_folds_in_linear_time(spark):
    """100,000 clauses with verbless ones among them: the time grows with their number, not with its square."""
    import time

    from storyloom.operators import events

    def seconds(n):
        text = ", ".join(f"the old lamp{k}" if k % 3 == 0 else f"Adam walked{k} in London and Sarah was there" for k in range(n))
        docs = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
        began = time.perf_counter()
        rows = events.event_clauses(events.clauses(events.sentences(docs))).agg(F.count("*"), F.max("span_end"), F.min("span_start")).first()
        return time.perf_counter() - began, tuple(rows), len(text)

    seconds(1000)
    small, large = seconds(3_999), seconds(60_000)
    assert large[1][1:] == (large[2], 0) and large[1][0] == 40_000 and small[1][1:] == (small[2], 0)
    assert large[0] < 50 * small[0]  # fifteen times the clauses; the square would be 225 times


def test_places_of_clauses_are_those_of_a_walk(spark):
    """Also where a part occurs in what separates it from the one before, is blank, or repeats."""
    from storyloom.functions import text as X
    from storyloom.operators import events

    rnd = random.Random(52)
    pieces = ["an", "a", "was", "and", "and then", ",", ", ", "; ", " ", "  ", "d", "he went", "so", "was was", "\t", "n", "then he", "but\n", "Adam"]
    rows = [(k, "en", k, X_strip("".join(rnd.choice(pieces) + rnd.choice([" ", "", ", "]) for _ in range(rnd.randint(1, 14)))), 7) for k in range(600)]
    sents = spark.createDataFrame([r for r in rows if r[3]], "doc_id long, lang string, sent_no int, sentence string, start int")
    cut = events.clauses(sents)
    several = X.count(F.col("sentence"), "verb") > 1
    from storyloom.functions import lexicon as L

    parts = F.filter(F.transform(F.split("sentence", L.boundary("en").java), X.trim), lambda p: p != "")
    want = cut.withColumn("_p", F.when(several & (F.size(parts) > 0), parts).otherwise(F.array("sentence"))).withColumn("want", events.walk("_p"))
    bad = want.where(~F.col("clauses").eqNullSafe(F.col("want"))).select("sentence", "clauses", "want").take(2)
    assert not bad
    assert want.where("size(want) > 2").count() > 100


def X_strip(s):
    return s.strip(" \t\n")


def test_places_beyond_an_int(spark):
    """Sentences that begin beyond 2**31 keep their places, in events, segments and mentions."""
    far = 3 * 2**31
    rows = [(0, "en", k, s, far + 1000 * k) for k, s in enumerate(["Adam walked in London.", "Sarah was there, and Adam left."])]
    sents = spark.createDataFrame(rows, "doc_id long, lang string, sent_no long, sentence string, start long")
    for options in ({"parts": 1}, {}):
        with Corpus.of_sentences(sents, **options) as c:
            assert [tuple(r) for r in c.events.orderBy("order").select("span_start", "span_end").collect()] == [(far, far + 22), (far + 1000, far + 1015), (far + 1017, far + 1031)]
            assert c.segments.agg(F.min("span_start"), F.max("span_end")).first() == (far, far + 1031)
            assert c.mentions.agg(F.min("span_start")).first()[0] == far


def test_clauses_as_cut(spark):
    """A part that also occurs in what separates it from the one before lies where it was cut from, if that is asked for."""
    docs = spark.createDataFrame([(1, "he was there and a, she was.")], "doc_id long, text string")
    spans = [[tuple(r) for r in Corpus(docs, language=None, as_cut=k).events.orderBy("order").select("span_start", "span_end").collect()] for k in (True, False)]
    assert spans == [[(0, 12), (17, 28)], [(0, 12), (13, 28)]]
