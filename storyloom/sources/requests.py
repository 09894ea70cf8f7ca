"""Requests, corpora and saved responses as DataFrames; validation and service metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as X

REQUEST = "text string, options struct<layout:string,width:int,highlight_entities:array<string>,include_debug:boolean,language:string>"

# Messages of rejected requests, and the layouts.
NO_BODY = "Request body must be a JSON object."
NO_TEXT = "Request body must include a non-empty string field named 'text'."
BAD_LAYOUT = "'options.layout' must be one of: both, text_order, time_yard."
BAD_LANGUAGE = "'options.language' must be one of: en, ro."
LAYOUTS = ("both", "text_order", "time_yard")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests from JSON files, one object or an array in each: doc_id (the file's name and the place in it) and the request's fields with defaults."""
    rows = spark.read.schema(REQUEST).json(path, multiLine=True)
    rows = rows.withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("_nth", F.monotonically_increasing_id())
    return with_defaults(rows.withColumn("doc_id", F.concat_ws("#", "_file", "_nth")))


def with_defaults(rows: DataFrame) -> DataFrame:
    o = lambda c, d: F.coalesce(F.col(f"options.{c}"), F.lit(d)).alias(c)
    return rows.select("doc_id", "text", o("layout", "both"), o("width", 1200), F.col("options.highlight_entities").alias("highlight_entities"), o("include_debug", False), o("language", "en"))


def blank(x: Column) -> Column:
    return F.coalesce(X.trim(x) == "", F.lit(True))


def validate(requests: DataFrame) -> DataFrame:
    """requests with ``error``: null, or the first message that applies."""
    bad_layout = ~blank(F.col("layout")) & ~F.col("layout").isin(*LAYOUTS)
    bad_language = ~blank(F.col("language")) & X.language_strict(F.col("language")).isNull()
    return requests.withColumn("error", F.when(blank(F.col("text")), NO_TEXT).when(bad_layout, BAD_LAYOUT).when(bad_language, BAD_LANGUAGE))


def parse(bodies: DataFrame, body: str = "body", doc_id: str = "doc_id") -> DataFrame:
    """Requests from a column of JSON bodies, validated; a body that is no object gets its message."""
    rows = bodies.select(F.col(doc_id).alias("doc_id"), F.from_json(body, REQUEST, {"mode": "PERMISSIVE"}).alias("r"), X.trim(F.coalesce(F.col(body), F.lit(""))).startswith("{").alias("_object"))
    checked = validate(with_defaults(rows.select("doc_id", "_object", "r.*")))
    return checked.join(rows.select("doc_id", "_object"), "doc_id").withColumn("error", F.when(~F.col("_object"), NO_BODY).otherwise(F.col("error"))).drop("_object")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("error IS NULL").drop("error"), checked.filter("error IS NOT NULL").select("doc_id", "error")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text from a JSON array of (id, text)."""
    return spark.read.schema("id string, text string").json(path, multiLine=True).select(F.col("id").alias("doc_id"), "text")


RESPONSE = "diagram struct<actors:array<string>,locations:array<string>,events:array<struct<temporal_anchor:string>>,segments:array<string>,tracks:array<string>,relations:array<string>>"


def saved_counts(responses: DataFrame, json: str = "json") -> DataFrame:
    """Counts of saved responses, by doc_id: named entities, persons and locations without their reserved rows, anchors, events, relations, segments and tracks."""
    d = responses.select("doc_id", F.from_json(json, RESPONSE).alias("r")).select("doc_id", "r.diagram.*")
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("int")
    size = lambda c: F.greatest(F.lit(0), n(c))
    anchors = size(F.filter("events", lambda e: F.coalesce(e["temporal_anchor"], F.lit("")) != ""))
    return d.select(
        "doc_id", (size("actors") + size("locations")).alias("named_entities"), F.greatest(F.lit(0), size("actors") - 1).alias("person_entities"), F.greatest(F.lit(0), size("locations") - 1).alias("location_entities"),
        anchors.alias("temporal_anchors"), size("events").alias("events"), size("relations").alias("temporal_relations"), size("segments").alias("time_segments"), size("tracks").alias("time_tracks"),
    )


def describe(spark: SparkSession) -> DataFrame:
    """What the engine is and offers, in one row."""
    from storyloom.plans.render import VERSION

    return spark.range(1).select(
        F.lit("storyloom").alias("service"), F.lit(VERSION).alias("version"), F.lit("non-LLM rules with optional seed classifiers and TimeML-style annotations").alias("extraction"),
        F.array(F.lit("en"), F.lit("ro")).alias("supported_languages"), F.array(*map(F.lit, ("response", "json", "svg", "xml"))).alias("renderings"), F.lit(True).alias("ok"),
    )
