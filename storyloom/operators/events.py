"""Sentences, clauses and events of a corpus of documents (doc_id, text, language), set at a time.

doc_id must be unique. Everything up to events is expressions over one row; events are numbered and inherit what they lack by
windows over their document, which share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions import lexicon as L
from storyloom.functions import text as X

SENTENCE = r"[^.!?]+[.!?]?"


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str | None = "language") -> DataFrame:
    """doc_id, text, lang: null texts are empty, languages are en or ro."""
    lang = X.language(F.col(language)) if language else F.lit("en")
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(lang, F.lit("en")).alias("lang"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, lang, sent_no, sentence, start: runs of other characters with one terminator at most, trimmed.

    The text is tiled by such runs and single terminators, so places are sums of lengths.
    """
    tiles = docs.select("doc_id", "lang", F.regexp_extract_all("text", F.lit(rf"{SENTENCE}|[.!?]"), F.lit(0)).alias("tiles"))
    rows = tiles.select("doc_id", "lang", F.posexplode(F.arrays_zip(F.col("tiles").alias("tile"), X.starts("tiles").alias("at"))).alias("sent_no", "x"))
    rows = rows.select("doc_id", "lang", "sent_no", X.trim(F.col("x.tile")).alias("sentence"), (F.col("x.at") + F.length(F.regexp_extract(F.col("x.tile"), r"(?U)^\s*", 0))).alias("start"), F.col("x.tile").rlike(r"^[^.!?]").alias("real"))
    return rows.filter("real AND sentence <> ''").drop("real")


def clauses(sents: DataFrame, as_cut: bool = False) -> DataFrame:
    """sents with ``clauses``: an array of (text, start, end), the parts of a sentence between commas and conjunctions if it holds more than one verb.

    A part counts as lying where it is first found after the end of the one before. That is where it was cut from, unless it also occurs in what parts
    the two; places are sums of lengths, and only sentences with such a part, or a blank one, are walked part by part. With as_cut, parts lie where they
    were cut from in any case, and nothing is walked. Places are of the type of ``start``.
    """
    kind = dict(sents.dtypes)["start"]
    lang = F.col("lang")
    cut = lambda make: X.by_language(lang, lambda k: make(F.lit(L.boundary(k).java)))
    several = X.count(F.col("sentence"), "verb", lang) > 1
    rows = sents.withColumn("_parts", F.when(several, cut(lambda r: F.split("sentence", r))))
    rows = rows.withColumn("_seps", F.when(F.size("_parts") > 1, cut(lambda r: F.regexp_extract_all("sentence", r, F.lit(0)))))
    rows = rows.withColumn("_tiles", F.flatten(F.transform("_parts", lambda p, i: F.array(p, F.coalesce(F.get("_seps", i), F.lit(""))))))
    lead = lambda x: F.regexp_extract(x, r"(?U)^\s*", 0)
    trail = lambda x: F.regexp_extract(x, r"(?U)\s*$", 0)

    def found(part: Column, i: Column, at: Column) -> Column:
        text = X.trim(part)
        between = F.when(i > 0, F.concat(trail(F.get("_parts", i - 1)), F.get("_seps", i - 1), lead(part))).otherwise(F.lit(""))
        true = [] if as_cut else [((text != "") & (F.instr(F.concat(between, text), text) == F.length(between) + 1)).alias("true")]
        return F.struct(text.alias("text"), (F.get(at, 2 * i) + F.length(lead(part))).alias("at"), *true)

    # Bound, for the optimizer would put a column that is used once into the lambda, to be made again for each part.
    rows = rows.withColumn("_found", F.when(F.size("_parts") > 1, X.bound(X.starts("_tiles"), lambda at: F.transform("_parts", lambda p, i: found(p, i, at)))))
    place = lambda text, at: F.struct(text.alias("text"), at.cast(kind).alias("start"), (at + F.length(text)).cast(kind).alias("end"))
    whole = F.array(place(F.col("sentence"), F.col("start")))
    summed = F.transform("_found", lambda x: place(x["text"], F.col("start") + x["at"]))
    if as_cut:
        placed = F.filter(summed, lambda x: x["text"] != "")
    else:
        placed = F.coalesce(F.when(F.exists("_found", lambda x: ~x["true"]), walk("filter(transform(_found, x -> x.text), p -> p <> '')", kind)), summed)
    made = F.when(F.size("_parts") > 1, placed).otherwise(whole)
    return rows.withColumn("clauses", F.when(F.size(made) > 0, made).otherwise(whole)).drop("_parts", "_seps", "_tiles", "_found")


def walk(parts: str, kind: str = "int") -> Column:
    """Clauses of the columns sentence and start, of type kind, by looking for each of the parts after the end of the one before; the work grows with the square of their number."""
    at = "coalesce(nullif(locate(p, sentence, a.at + 1), 0) - 1, a.at)"
    item = "named_struct('text', p, 'start', start + b, 'end', start + b + length(p))"
    begin = f"named_struct('at', 0, 'out', cast(array() as array<struct<text:string,start:{kind},end:{kind}>>))"
    step = f"transform(array({at}), b -> named_struct('at', least(length(sentence), b + length(p)), 'out', array_append(a.out, {item})))[0]"
    return F.expr(f"aggregate({parts}, {begin}, (a, p) -> {step}, a -> a.out)")


def event_clauses(rows: DataFrame) -> DataFrame:
    """doc_id, lang, sent_no, clause_no, text, span_start, span_end: clauses with a verb, led by the verbless ones before them in their sentence.

    Verbless clauses at the end of a sentence are dropped. A clause with a verb takes the slice from the one before it on.
    """
    verb = X.by_language(F.col("lang"), lambda k: F.lit(L.cue("verb", k).java))
    rows = rows.withColumn("verb", verb)
    rows = rows.withColumn("_verbs", F.expr("filter(transform(clauses, (c, i) -> if(regexp_like(c.text, verb), i, null)), i -> i IS NOT NULL)"))
    group = """transform(_verbs, (v, j) -> transform(array(slice(clauses, if(j = 0, 0, _verbs[j - 1] + 1) + 1, v - if(j = 0, -1, _verbs[j - 1]))), g -> named_struct(
      'text', if(size(g) = 1, g[0].text, concat(array_join(transform(slice(g, 1, size(g) - 1), c -> c.text), ' '), ', ', g[size(g) - 1].text)),
      'start', g[0].start, 'end', g[size(g) - 1].end))[0])"""
    rows = rows.select("doc_id", "lang", "sent_no", F.posexplode(F.expr(group)).alias("clause_no", "e"))
    return rows.select("doc_id", "lang", "sent_no", "clause_no", F.col("e.text").alias("text"), F.col("e.start").alias("span_start"), F.col("e.end").alias("span_end"))


def features(rows: DataFrame) -> DataFrame:
    """rows with what their texts say by themselves."""
    t, lang = F.col("text"), F.col("lang")
    return rows.withColumns({
        "own_actors": X.actors(t, lang), "own_anchor": X.anchor(t, lang), "location": X.location(t, lang), "action": X.action(t, lang), "rule_category": X.category(t, lang),
        "cue_later": X.temporal_cue(t, F.lit(False), lang),
    })


def numbered(rows: DataFrame) -> DataFrame:
    """Events in order, with inherited actors and anchors. ``order`` counts from 1."""
    by_doc = Window.partitionBy("doc_id").orderBy("sent_no", "clause_no")
    so_far = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    inherited = lambda c, empty: F.coalesce(F.last(F.when(~empty, F.col(c)), ignorenulls=True).over(so_far), F.col(c))
    rows = rows.withColumns({"order": F.row_number().over(by_doc), "actors": inherited("own_actors", F.size("own_actors") == 0), "temporal_anchor": inherited("own_anchor", F.col("own_anchor") == "")})
    return with_cues(rows).drop("own_actors", "own_anchor", "cue_later", "sent_no", "clause_no")


def with_cues(rows: DataFrame) -> DataFrame:
    """Numbered rows with their relation to the event before, and ids."""
    first_cue = F.struct(F.lit(X.FIRST_EVENT[0]).alias("relation"), F.lit("").alias("cue"), F.lit(X.FIRST_EVENT[2]).alias("evidence"))
    cue = F.when(F.col("order") == 1, first_cue).otherwise(F.col("cue_later"))
    return rows.withColumns({"relation_to_previous": cue["relation"], "relation_cue": cue["cue"], "relation_evidence": cue["evidence"], "id": F.concat(F.lit("EV"), F.col("order"))})


#: Columns of events, in order.
COLUMNS = [
    "doc_id", "lang", "id", "text", "actors", "temporal_anchor", "location", "action", "temporal_category", "relation_to_previous", "relation_cue", "relation_evidence",
    "order", "span_start", "span_end", "confidence", "classifier",
]


def classified(rows: DataFrame, model=None) -> DataFrame:
    """rows with temporal_category, confidence and classifier; model(rows) adds predicted and score for English texts. Without one, rules alone decide."""
    ro = F.col("lang") == "ro"
    if model is None:
        category, score, source = F.col("rule_category"), F.lit(0.0), F.lit("heuristic_fallback")
    else:
        from storyloom.operators.models import category_gate

        rows = model(rows)
        gate = category_gate(F.col("predicted"), F.col("score"), F.col("rule_category"))
        category, score, source = gate["label"], gate["confidence"], gate["source"]
    rows = rows.withColumns({
        "temporal_category": F.when(ro, F.col("rule_category")).otherwise(category),
        "confidence": F.when(ro, F.lit(0.75)).otherwise(score),
        "classifier": F.when(ro, F.lit("romanian_rule_event_temporal")).otherwise(source),
    })
    return rows.select(*COLUMNS, *(["part"] if "part" in rows.columns else []))


def features_of(docs: DataFrame) -> DataFrame:
    """The clauses of documents that are events, with what they say by themselves."""
    return features(event_clauses(clauses(sentences(docs))))


def events(docs: DataFrame, model=None) -> DataFrame:
    return classified(numbered(features_of(docs)), model)


def sentence_split(text: Column) -> Column:
    """Sentences of a text with white space collapsed, cut after terminators that white space follows."""
    plain = X.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+"), X.trim), lambda s: s != "")
