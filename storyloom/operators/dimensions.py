"""Actors, locations and mentions of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import text as X
from storyloom.operators.links import unfolded

UNKNOWN = ("unknown", "necunoscut")


def _first_spellings(rows: DataFrame) -> DataFrame:
    """Of (doc_id, name, a, b), for each name whatever its case: the first spelling by (a, b), numbered by first appearance."""
    some = rows.groupBy("doc_id", F.upper("name").alias("_key")).agg(F.min(F.struct("a", "b", "name")).alias("x"))
    return some.select("doc_id", "x.name", F.row_number().over(Window.partitionBy("doc_id").orderBy("x.a", "x.b")).alias("n"))


def actors(docs: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, n, id, name: the narrator first, then names by first appearance."""
    named = events.select("doc_id", F.col("order").alias("a"), F.posexplode("actors").alias("b", "name"))
    zero = docs.select("doc_id", F.when(F.col("lang") == "ro", "Narator").otherwise("Narrator").alias("name"), F.lit(0).alias("n"))
    return zero.unionByName(_first_spellings(named)).select("doc_id", "n", F.concat(F.lit("A"), "n").alias("id"), "name")


def locations(docs: DataFrame, events: DataFrame) -> DataFrame:
    """doc_id, n, id, name, parent_id: the unknown place first."""
    named = events.filter((F.col("location") != "") & ~F.lower("location").isin(*UNKNOWN)).select("doc_id", F.col("order").alias("a"), F.lit(0).alias("b"), F.col("location").alias("name"))
    zero = docs.select("doc_id", F.when(F.col("lang") == "ro", UNKNOWN[1]).otherwise(UNKNOWN[0]).alias("name"), F.lit(1).alias("n"))
    rest = _first_spellings(named).withColumn("n", F.col("n") + 1)
    return zero.unionByName(rest).select("doc_id", "n", F.concat(F.lit("L"), "n").alias("id"), "name", F.lit("").alias("parent_id"))


def mentions(events: DataFrame) -> DataFrame:
    """doc_id, ord, id, text, label, source, span_start, span_end, event_id."""

    def row(text: Column, label: str, exact: str, inferred: str = "") -> Column:
        at = X.index_ci(F.col("text"), text)
        start = F.when(at >= 0, F.col("span_start") + at).otherwise(F.col("span_start"))
        end = F.when(at >= 0, start + F.length(text)).otherwise(start)
        good = (X.trim(text) != "") & (F.lower(text) != UNKNOWN[0]) & ((at >= 0) | F.lit(bool(inferred)))
        return F.when(good, F.struct(text.alias("text"), F.lit(label).alias("label"), F.when(at >= 0, exact).otherwise(inferred).alias("source"), start.alias("span_start"), end.alias("span_end")))

    people = F.filter(F.transform("actors", lambda x: row(x, "PERSON", "capitalized_actor_mention", "carried_actor_context")), lambda x: x.isNotNull())
    others = F.array(
        row(F.col("location"), "LOCATION", "preposition_location_pattern"), row(F.col("temporal_anchor"), "DATE_TIME", "temporal_expression_pattern"), row(F.col("action"), "EVENT_ACTION", "verb_pattern"),
    )
    # Only persons can be the same: of other labels an event has one mention each.
    once = X.bound(people, lambda p: F.when(F.size(p) > 1, _once(p)).otherwise(p))
    items = F.concat(once, F.filter(others, lambda x: x.isNotNull()))
    rows = unfolded(events.select("doc_id", "order", F.col("id").alias("event_id"), items.alias("items")), F.col("items"), "order")
    return rows.select("doc_id", "ord", F.concat(F.lit("EM"), "ord").alias("id"), "r.text", "r.label", "r.source", "r.span_start", "r.span_end", "event_id")


def _once(mentions: Column) -> Column:
    """Of mentions that are alike in place, and in text whatever its case, the first; in order. Sorted, so long lists take little more than their length."""
    keyed = F.array_sort(F.transform(mentions, lambda m, i: F.struct(F.struct(m["span_start"].alias("a"), m["span_end"].alias("b"), F.upper(m["text"]).alias("t")).alias("k"), i.alias("i"), m.alias("m"))))
    firsts = X.bound(keyed, lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["m"].alias("m")))), lambda e: e["m"])


def event_actor_ids(events: DataFrame, out: str = "actor_ids") -> DataFrame:
    """events with the ids of their actors, in order, as :func:`actors` numbers them: without joins, in the exchange that events are dealt by.

    A dictionary is made for each document by windows over its exploded names: a name's place is the first (event, position) whose upper
    case is its own, and its number the rank of that place. Names that are the narrator's have A0. Events are put together again by
    their order, which their document's exchange keeps in one place.
    """
    names = F.posexplode_outer("actors").alias("_pos", "_name")
    rows = events.select("doc_id", "order", "lang", F.struct(*(c for c in events.columns if c not in ("doc_id", "order", "lang"))).alias("_all"), names)
    # The event goes with its first name alone.
    rows = rows.withColumn("_event", F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_all"))).drop("_all")
    rows = rows.withColumn("_key", F.upper("_name"))
    # An event without actors has one row and no name; its place is none.
    place = F.when(F.col("_name").isNotNull(), F.struct("order", "_pos"))
    rows = rows.withColumn("_first", F.min(place).over(Window.partitionBy("doc_id", "_key")))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("_first").asc_nulls_last()))
    narrator = F.upper(F.when(F.col("lang") == "ro", "Narator").otherwise("Narrator"))
    id_ = F.when(F.col("_key") == narrator, F.lit("A0")).otherwise(F.concat(F.lit("A"), rank))
    rows = rows.withColumn("_id", F.when(F.col("_name").isNotNull(), F.struct("_pos", id_.alias("id"))))
    held = rows.groupBy("doc_id", "order").agg(F.first("lang").alias("lang"), F.first("_event", ignorenulls=True).alias("_event"), F.sort_array(F.collect_list("_id")).alias("_ids"))
    return held.select("doc_id", "order", "lang", "_event.*", F.transform("_ids", lambda x: x["id"]).alias(out)).select(*events.columns, out)


def place_ids(events: DataFrame, out: str = "place_id") -> DataFrame:
    """events with the id of their location as :func:`locations` numbers them, and null where it has none: by windows of the exchange that events are dealt by."""
    name = F.col("location")
    key = F.when((name != "") & ~F.lower(name).isin(*UNKNOWN), F.upper(name))
    rows = events.withColumn("_key", key)
    first = F.when(key.isNotNull(), F.min("order").over(Window.partitionBy("doc_id", "_key")))
    rows = rows.withColumn("_first", first)
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.col("_first").asc_nulls_last()))
    return rows.withColumn(out, F.when(F.col("_first").isNotNull(), F.concat(F.lit("L"), rank + 1)).otherwise(unknown_id(name, F.col("lang")))).drop("_key", "_first")


def unknown_id(name: Column, lang: Column) -> Column:
    """L1 for the language's name of the unknown place, in any case; else null."""
    return F.when(F.upper(name) == F.upper(F.when(lang == "ro", UNKNOWN[1]).otherwise(UNKNOWN[0])), F.lit("L1"))
