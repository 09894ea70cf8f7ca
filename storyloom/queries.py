"""Queries over the driver's tables, and SQL for the same rows.

``stories`` makes a narrative of each user's events, so that every cue fires; ``documents`` are analysed whole, as English.
The SQL is a plan of its own (tiles, lists and windows of DuckDB); only vocabularies are shared. Its classes are ASCII, so other
letters of ``documents`` are replaced there by one that counts as a letter; queries on documents return counts and places, which that doesn't change.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import lexicon as L
from storyloom.functions import text as X
from storyloom.operators import comparison, dimensions, events, links, models, report, scans
from storyloom.plans import render
from storyloom.plans.corpus import Corpus
from storyloom.sources import requests

WHO = "CASE event_id % 5 WHEN 0 THEN 'Adam' WHEN 1 THEN 'Margaret' WHEN 2 THEN 'Karl and Johan' WHEN 3 THEN 'Sarah' ELSE 'Adam and Margaret' END"
SENTENCES = [
    "{who} walked through the market.", "Years earlier, {who} had carried the lamp.", "Meanwhile, {who} traveled alone across the island.", "{who} remembered the old house in Jakarta.",
    "Tomorrow, {who} will meet Mark at the station.", "{who} searched for Paul after the storm.", "Then {who} opened the door and waited in the kitchen.", "{who} might return later.",
    "{who} always looks at the sea.", "In the story the prince crossed a river.", "{who} left before dawn.", "{who} said that he was not tired.", "He saw the boat, but it was leaving.",
    "Rain and wind over the hills.", "{who} is waiting in London; the train will be late.", "{who} has decided to go, because 3 days ago he was lost.", "In 1999 {who} lived near the river.",
    "Nobody.", "{who} had been imprisoned every night.", "Finally {who} found Margaret at noon.", "{who} thought about home.", "Elsewhere, in a small town, {who} disappeared.", "{who} never walks on Monday.",
]


RO_WHO = "CASE event_id % 5 WHEN 0 THEN 'Ion' WHEN 1 THEN 'Maria' WHEN 2 THEN 'Radu si Ana' WHEN 3 THEN 'Elena' ELSE 'Ion si Maria' END"
#: Words that begin and end in ASCII letters: the SQL's patterns know no others at the ends of words.
RO_SENTENCES = [
    "{who} a plecat spre Brăila.", "Demult, {who} fusese in casa veche.", "Intre timp, {who} a calatorit singur la munte.", "{who} si-a amintit de vara aceea in Bucuresti.",
    "Maine, {who} va merge la gara.", "{who} cauta pe Paul dupa furtuna.", "Apoi {who} a deschis usa si a asteptat in curte.", "{who} poate ar fi acolo.",
    "De obicei {who} merge pe deal.", "In poveste printul a urcat un deal.", "{who} a plecat inainte de zori.", "{who} a spus ca nu era obosit.", "El a vazut barca, dar era tarziu.",
    "Ploaie si vant.", "{who} este in curs de plecare; trenul va intra in gara.", "Cu 3 zile in urma {who} a gasit cheia.", "In 1999 {who} locuia langa padure.",
    "{who} s-a gandit la mama in fiecare seara.", "Mai tarziu {who} a intalnit un prieten, deoarece s-au intalnit.", "Simultan, {who} a incercat un drum.", "In roman Paul a decis sa plece.",
    "Ana a crezut ca Ion a disparut acum.", "Probabil {who} este acasa.", "Atunci {who} a intrebat de Elena.",
]


def _sentence(lang: str = "en") -> str:
    """A SQL expression that both engines read alike."""
    who, sentences = (RO_WHO, RO_SENTENCES) if lang == "ro" else (WHO, SENTENCES)
    parts = []
    for k, s in enumerate(sentences):
        a, _, b = s.partition("{who}")
        parts.append(f"WHEN {k} THEN " + (f"concat('{a}', {who}, '{b}')" if "{who}" in s else f"'{s}'"))
    return f"CASE event_id % {len(sentences)} {' '.join(parts)} END"


#: Events of a task: texts, clauses and what is sorted by document are some ten times as large as the rows that are dealt.
EVENTS_A_TASK = 25_000


def stories(spark: SparkSession, sf_dir: str, lang: str = "en") -> DataFrame:
    """Dealt by user before anything is collected, over partitions in proportion to the rows: what a task holds doesn't grow with the table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id")
    n = max(spark.sparkContext.defaultParallelism, rows.count() // EVENTS_A_TASK + 1)
    rows = rows.repartition(n, "user_id").withColumn("s", F.expr(_sentence(lang)))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "s")))
    return rows.groupBy(F.col("user_id").alias("doc_id")).agg(F.concat_ws(" ", F.transform(ordered, lambda x: x["s"])).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt anew only if the scan has fewer splits than the cluster has cores, as a small file of one row group has; else texts stay where they are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    n = spark.sparkContext.defaultParallelism
    return docs.repartition(n) if docs.rdd.getNumPartitions() < n else docs


def _stories(spark: SparkSession, sf_dir: str, keep: bool = False, lang: str = "en") -> Corpus:
    return Corpus(stories(spark, sf_dir, lang).withColumn("language", F.lit(lang)), keep=keep)


def _freeing(corpus: Corpus, df: DataFrame) -> DataFrame:
    """df, with which what the corpus holds goes."""
    weakref.finalize(df, corpus.release)
    return df


def _documents(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(documents(spark, sf_dir), language=None, as_cut=True)


#: Characters from the beginning of a sentence of the long story to the next one's.
LONG_STEP = 1000


def long_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of one document: a sentence for each event of the table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.lit(0).cast("long").alias("doc_id"), F.lit("en").alias("lang"), F.col("event_id").alias("sent_no"), F.expr(_sentence()).alias("sentence"), (F.col("event_id") * LONG_STEP).alias("start"))


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    """Columns, with arrays joined by | and integers as long."""
    kinds = dict(df.dtypes)
    one = lambda c: F.concat_ws("|", c).alias(c) if kinds[c].startswith("array") else F.col(c).cast("long").alias(c) if kinds[c] == "int" else F.col(c)
    return df.select(*map(one, columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, source: str = "stories"):
    """Registers a function as a query; oracle: what follows the common tables of the source."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"{_tables(source)} {oracle}"
        return f

    return add


# The common tables.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _re(name: str, lang: str = "en") -> str:
    return _q(L.cue(name, lang).re2)


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _has(text: str, name: str, lang: str = "en") -> str:
    return f"regexp_matches({text}, {_re(name, lang)})"


def _first(text: str, name: str, lang: str = "en") -> str:
    return f"regexp_extract({text}, {_re(name, lang)}, 0)"


def _stop(lang: str) -> str:
    return _list(L.RO_STOPWORDS if lang == "ro" else L.EN_STOPWORDS)


def _entities(text: str, lang: str = "en") -> str:
    found = f"regexp_extract_all({text}, {_q(L.entity(lang).re2)})"
    once = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return f"list_filter({once}, lambda x: len(list_filter(string_split(x, ' '), lambda p: p <> '' AND NOT list_contains({_stop(lang)}, p))) > 0)"


def _place(text: str, lang: str) -> str:
    found = f"regexp_extract({text}, {_q(L.place(lang).re2)}, 1)"
    return f"trim(CASE WHEN {found} <> '' THEN {found} ELSE regexp_extract({text}, {_q(L.RO_ON.re2)}, 1) END)" if lang == "ro" else f"trim({found})"


def _class(lang: str = "en") -> str:
    has = lambda text, name: _has(text, name, lang)
    return f"""CASE WHEN {has('text', 'perception')} THEN 'PERCEPTION' WHEN {has('text', 'reporting')} THEN 'REPORTING' WHEN {has('text', 'intention')} THEN 'I_ACTION'
  WHEN {has('text', 'remember')} OR {has('text', 'cognition')} THEN 'I_STATE' WHEN {has('action', 'state')} THEN 'STATE' ELSE 'OCCURRENCE' END"""


def _timex_type(lang: str = "en") -> str:
    return "CASE " + " ".join(f"WHEN {_has('temporal_anchor', name, lang)} THEN '{kind}'" for name, kind in (("duration", "DURATION"), ("clock", "TIME"), ("recurring", "SET"))) + " ELSE 'DATE' END"


def _value(text: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {_q(p)})' for p in parts)} THEN '{v}'" for v, parts in L.TIMEX_VALUES)
    year = rf"regexp_extract({text}, '\b\d{{4}}\b', 0)"
    return f"CASE WHEN {year} <> '' THEN {year} {cases} WHEN temporal_category = 'Past' THEN 'PAST_REF' WHEN temporal_category = 'Future' THEN 'FUTURE_REF' ELSE 'PRESENT_REF' END"


def _ci(text: str, part: str) -> str:
    return f"strpos(lower({text}), lower({part}))"


def _tables(source: str) -> str:
    lang = "ro" if source == "romanian" else "en"
    docs = {
        "romanian": f"SELECT user_id AS doc_id, string_agg({_sentence('ro')}, ' ' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id",
        "long": "SELECT 0::BIGINT AS doc_id, '' AS text",
        "stories": f"SELECT user_id AS doc_id, string_agg({_sentence()}, ' ' ORDER BY ts, event_id) AS text FROM events GROUP BY user_id",
        "documents": r"SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '_', 'g') AS text FROM documents",
    }[source]
    sents = r"""SELECT doc_id, n AS sent_no, regexp_replace(tile, '^\s+|\s+$', '', 'g') AS sentence, (off0 + len(tile) - len(regexp_replace(tile, '^\s+', '')))::BIGINT AS start FROM tiles
  WHERE regexp_matches(tile, '^[^.!?]') AND regexp_matches(tile, '\S')"""
    if source == "long":
        sents = f"SELECT 0::BIGINT AS doc_id, event_id AS sent_no, {_sentence()} AS sentence, event_id * {LONG_STEP} AS start FROM events"
    cut = _q(L.boundary(lang).re2)
    before, after = L.place_before(lang)
    place = _q("(?i)" + before)
    none = "'unknown'"
    cue = "CASE " + " ".join(f"WHEN {_has('text', n, lang)} THEN {{'relation': '{r}', 'cue': {_first('text', n, lang)}, 'evidence': {_q(e)}}}" for n, r, e in X.CUES) + f" ELSE {{'relation': '{X.NO_CUE[0]}', 'cue': '', 'evidence': {_q(X.NO_CUE[2])}}} END"
    kind = "CASE " + " ".join(f"WHEN {_has('text', n, lang)} THEN '{k}'" for n, k in (("remember", "REM"), ("supposition", "SUP"), ("general", "GEN"), ("fiction", "FIC"))) + " ELSE 'NAR' END"
    view = f"regexp_extract(text, {_q(L.viewpoint(lang).re2)}, 1)"
    return rf"""
WITH docs AS MATERIALIZED ({docs}),
tiles AS (SELECT doc_id, n, tile, coalesce(sum(len(tile)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0
  FROM (SELECT doc_id, unnest(t) AS tile, generate_subscripts(t, 1) AS n FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]?|[.!?]') AS t FROM docs))),
sents AS MATERIALIZED ({sents}),
raw AS (SELECT *, CASE WHEN len(regexp_extract_all(sentence, {_re('verb', lang)})) > 1 THEN regexp_split_to_array(sentence, {cut}) ELSE [sentence] END AS parts,
  regexp_extract_all(sentence, {cut}) AS seps FROM sents),
pieces AS (SELECT doc_id, sent_no, start, k, parts[k] AS part, coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: len(x))), 0) + CASE WHEN len(parts) > 1 THEN coalesce(list_sum(list_transform(seps[1:k - 1], lambda x: len(x))), 0) ELSE 0 END AS off0
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM raw)),
clauses AS (SELECT doc_id, sent_no, k, regexp_replace(part, '^\s+|\s+$', '', 'g') AS c, start + off0 + len(part) - len(regexp_replace(part, '^\s+', '')) AS b, {_has('part', 'verb', lang)} AS verb FROM pieces WHERE regexp_matches(part, '\S')),
isles AS (SELECT *, coalesce(sum(verb::INT) OVER (PARTITION BY doc_id, sent_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS isle FROM clauses),
ev0 AS (SELECT doc_id, sent_no, isle, concat_ws(', ', string_agg(c, ' ' ORDER BY k) FILTER (NOT verb), max(c) FILTER (verb)) AS text, min(b)::BIGINT AS span_start, (max(b + len(c)) FILTER (verb))::BIGINT AS span_end
  FROM isles GROUP BY ALL HAVING bool_or(verb)),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_no, isle) AS ord,
  list_filter({_entities('text', lang)}, lambda x: NOT {_has('x', 'temporal_entity', lang)} AND NOT regexp_matches(text, {place} || x || {_q(after)})) AS own_actors, trim({_first('text', 'anchor', lang)}) AS own_anchor,
  {_place('text', lang)} AS location, {_first('text', 'verb', lang)} AS action,
  CASE WHEN {_has('text', 'future', lang)} THEN 'Future' WHEN {_has('text', 'past', lang)} THEN 'Past' ELSE 'Present' END AS temporal_category, {cue} AS c FROM ev0),
ev AS MATERIALIZED (SELECT *, 'EV' || ord AS id, coalesce(last_value(CASE WHEN len(own_actors) > 0 THEN own_actors END IGNORE NULLS) OVER w, []) AS actors,
  coalesce(last_value(nullif(own_anchor, '') IGNORE NULLS) OVER w, '') AS temporal_anchor, CASE WHEN ord = 1 THEN 'NONE' ELSE c.relation END AS relation_to_previous,
  CASE WHEN ord = 1 THEN '' ELSE c.cue END AS relation_cue, CASE WHEN ord = 1 THEN {_q(X.FIRST_EVENT[2])} ELSE c.evidence END AS relation_evidence
  FROM ev1 WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sg0 AS (SELECT *, CASE WHEN lag(temporal_category) OVER w = temporal_category AND list_sort(lag(list_transform(actors, lambda x: upper(x))) OVER w) = list_sort(list_transform(actors, lambda x: upper(x)))
  AND NOT (relation_cue <> '' AND relation_to_previous IN ('BEFORE', 'AFTER', 'SIMULTANEOUS'))
  AND (temporal_anchor = '' OR lag(temporal_anchor) OVER w = '' OR upper(lag(temporal_anchor) OVER w) = upper(temporal_anchor)) THEN 0 ELSE 1 END AS new
  FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
sg1 AS (SELECT *, (sum(new) OVER (PARTITION BY doc_id ORDER BY ord))::BIGINT AS seg_no FROM sg0),
sg2 AS (SELECT doc_id, seg_no, string_agg(text, ' ' ORDER BY ord) AS text, flatten(list(actors ORDER BY ord)) AS every, coalesce(first(temporal_anchor ORDER BY ord) FILTER (temporal_anchor <> ''), '') AS temporal_anchor,
  coalesce(first(location ORDER BY ord) FILTER (location <> ''), {none}) AS location, first(temporal_category ORDER BY ord) AS temporal_category, min(span_start) AS span_start, max(span_end) AS span_end,
  string_agg(id, '|' ORDER BY ord) AS event_ids, first(relation_to_previous ORDER BY ord) AS relation, first(relation_cue ORDER BY ord) AS cue, first(relation_evidence ORDER BY ord) AS evidence FROM sg1 GROUP BY ALL),
sg3 AS (SELECT * EXCLUDE (every), list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: upper(y)), upper(x)) = i) AS actors, {kind} AS type FROM sg2),
sg4 AS (SELECT *, CASE WHEN len(actors) > 0 THEN actors ELSE {_entities('text', lang)} END AS entities, {_has('text', 'parallel', lang)} AS parallel, {_first('text', 'parallel', lang)} AS parallel_cue, {_has('text', 'join', lang)} AS joins, {_has('text', 'split', lang)} AS splits FROM sg3),
sg5 AS (SELECT *, CASE WHEN type = 'REM' AND len(entities) > 0 THEN entities[1] WHEN {view} <> '' AND NOT list_contains({_stop(lang)}, {view}) THEN {view} ELSE '{'narator' if lang == 'ro' else 'narrator'}' END AS perspective,
  CASE WHEN len(entities) > 0 THEN array_to_string(entities[1:3], '&') END AS name FROM sg4),
sg6 AS (SELECT *, upper(concat_ws(':', CASE WHEN parallel THEN 'parallel' WHEN type = 'REM' THEN 'memory' ELSE 'main' END, coalesce(name, CASE WHEN type = 'REM' AND NOT parallel THEN 'Past' ELSE 'Narrative' END), temporal_category, perspective)) AS key FROM sg5),
sg7 AS (SELECT *, min(seg_no) OVER (PARTITION BY doc_id, key) AS f, row_number() OVER (PARTITION BY doc_id, key ORDER BY seg_no) - CASE WHEN type = 'REM' THEN 0.35 ELSE 0 END AS story_order FROM sg6),
sg8 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS track_no, coalesce(first_value(name) OVER (PARTITION BY doc_id, key ORDER BY seg_no), 'Narrative') AS track_name FROM sg7),
sg AS MATERIALIZED (SELECT *, 'TS' || seg_no AS id, 'TT' || track_no AS track_id, lag('TS' || seg_no) OVER w AS prev_id, lag('TT' || track_no) OVER w AS prev_track, lag(track_name) OVER w AS prev_name,
  lag(type) OVER w IS DISTINCT FROM type OR lag(perspective) OVER w IS DISTINCT FROM perspective OR lag(temporal_category) OVER w IS DISTINCT FROM temporal_category AS changed, lead(seg_no) OVER w IS NULL AS is_last
  FROM sg8 WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no)),
rel0 AS (SELECT doc_id, seg_no, 0 AS k, CASE WHEN relation = 'BEFORE' THEN id ELSE prev_id END AS from_id, CASE relation WHEN 'BEFORE' THEN 'BEFORE' WHEN 'SIMULTANEOUS' THEN 'SIMULTANEOUS' WHEN 'AFTER' THEN 'BEFORE' ELSE 'IMMEDIATELY_BEFORE' END AS rel,
    CASE WHEN relation = 'BEFORE' THEN prev_id ELSE id END AS to_id, cue FROM sg WHERE prev_id IS NOT NULL
  UNION ALL SELECT doc_id, seg_no, 1, prev_track, CASE WHEN parallel THEN 'SIMULTANEOUS' ELSE 'BEFORE' END, track_id, parallel_cue FROM sg WHERE prev_track <> track_id),
rel AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k) AS ord FROM rel0),
pairs AS (SELECT *, CASE WHEN prev_track <> track_id THEN prev_track || '|' || track_id ELSE track_id END AS tt, coalesce(prev_track <> track_id, false) AS rupt FROM sg),
bd0 AS (SELECT doc_id, seg_no, 0 AS k, 'START' AS type, NULL AS a, id AS b, track_id AS t FROM pairs WHERE prev_id IS NULL
  UNION ALL SELECT doc_id, seg_no, 1, 'RUPTURE', prev_id, id, tt FROM pairs WHERE rupt
  UNION ALL SELECT doc_id, seg_no, 2, 'COMMUTE', prev_id, id, track_id FROM pairs WHERE prev_id IS NOT NULL AND NOT rupt AND changed
  UNION ALL SELECT doc_id, seg_no, 3, 'JOIN', prev_id, id, tt FROM pairs WHERE joins AND rupt
  UNION ALL SELECT doc_id, seg_no, 4, 'SPLIT', prev_id, id, tt FROM pairs WHERE splits
  UNION ALL SELECT doc_id, seg_no, 5, 'STOP', id, NULL, track_id FROM pairs WHERE is_last),
bd AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k) AS ord FROM bd0),
ep0 AS (SELECT doc_id, seg_no, 0 AS k, 'JOIN' AS type, prev_name || '+' || track_name AS name, tt, prev_track, track_id, rupt, id AS segment_id FROM pairs WHERE joins AND rupt
  UNION ALL SELECT doc_id, seg_no, 1, 'SPLIT', track_name || ' split', tt, prev_track, track_id, rupt, id FROM pairs WHERE splits),
ep AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no, k) AS ord FROM ep0),
wr AS (SELECT doc_id, ord, CASE WHEN rupt THEN prev_track ELSE track_id END AS track, 'right' AS side FROM ep UNION ALL SELECT doc_id, ord, track_id, 'left' FROM ep WHERE rupt),
tm0 AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, upper(trim(temporal_anchor))) AS f FROM ev WHERE temporal_anchor <> ''),
tm AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS tid_no FROM tm0),
si AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS sid_no FROM ev WHERE ord > 1 AND relation_cue <> ''),
tl0 AS (SELECT doc_id, ord, 0 AS k, 'IS_INCLUDED' AS rel_type, 'ei' || ord AS a, NULL AS b, 't' || tid_no AS t, NULL AS s FROM tm
  UNION ALL SELECT e.doc_id, e.ord, 1, CASE WHEN e.relation_to_previous IN ('BEFORE', 'AFTER') THEN 'BEFORE' WHEN e.relation_to_previous = 'SIMULTANEOUS' THEN 'SIMULTANEOUS' ELSE 'IBEFORE' END,
    CASE WHEN e.relation_to_previous = 'BEFORE' THEN 'ei' || e.ord ELSE 'ei' || (e.ord - 1) END, CASE WHEN e.relation_to_previous = 'BEFORE' THEN 'ei' || (e.ord - 1) ELSE 'ei' || e.ord END, NULL, 's' || si.sid_no
    FROM ev e LEFT JOIN si ON si.doc_id = e.doc_id AND si.ord = e.ord WHERE e.ord > 1),
tl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS n FROM tl0),
mn0 AS (SELECT doc_id, ord, text AS t, span_start AS ss, id, k - 1 AS k, actors[k] AS text, 'PERSON' AS label, 'capitalized_actor_mention' AS src, 'carried_actor_context' AS inf FROM (SELECT *, unnest(range(1, len(actors) + 1)) AS k FROM ev)
  UNION ALL SELECT doc_id, ord, text, span_start, id, len(actors), location, 'LOCATION', 'preposition_location_pattern', '' FROM ev
  UNION ALL SELECT doc_id, ord, text, span_start, id, len(actors) + 1, temporal_anchor, 'DATE_TIME', 'temporal_expression_pattern', '' FROM ev
  UNION ALL SELECT doc_id, ord, text, span_start, id, len(actors) + 2, action, 'EVENT_ACTION', 'verb_pattern', '' FROM ev),
mn1 AS (SELECT *, {_ci('t', 'text')} AS p FROM mn0 WHERE trim(text) <> '' AND lower(text) <> 'unknown'),
mn2 AS (SELECT doc_id, ord, k, id AS event_id, text, label, CASE WHEN p > 0 THEN src ELSE inf END AS source, CASE WHEN p > 0 THEN ss + p - 1 ELSE ss END AS span_start, CASE WHEN p > 0 THEN ss + p - 1 + len(text) ELSE ss END AS span_end FROM mn1 WHERE p > 0 OR inf <> ''),
mn3 AS (SELECT * FROM mn2 QUALIFY row_number() OVER (PARTITION BY doc_id, ord, label, span_start, span_end, upper(text) ORDER BY k) = 1),
mn AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) AS n FROM mn3),
ac AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY o, i) AS n FROM (SELECT doc_id, arg_min(name, (o, i)) AS name, min((o, i)).o AS o, min((o, i)).i AS i
  FROM (SELECT doc_id, {{'o': ord, 'i': k}} AS x, ord AS o, k AS i, actors[k] AS name FROM (SELECT *, unnest(range(1, len(actors) + 1)) AS k FROM ev)) GROUP BY doc_id, upper(name))),
lo AS (SELECT doc_id, name, 1 + row_number() OVER (PARTITION BY doc_id ORDER BY o) AS n FROM (SELECT doc_id, arg_min(location, ord) AS name, min(ord) AS o FROM ev WHERE location <> '' AND lower(location) NOT IN ('unknown', 'necunoscut') GROUP BY doc_id, upper(location)))
""".replace("min((o, i)).o AS o, min((o, i)).i AS i", "min({'o': o, 'i': i}).o AS o, min({'o': o, 'i': i}).i AS i").replace("arg_min(name, (o, i))", "arg_min(name, {'o': o, 'i': i})")


@query("SELECT doc_id, count(*) AS n_sentences, sum(len(sentence))::BIGINT AS n_chars, max(start) AS last_start FROM sents GROUP BY doc_id", "documents")
def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _documents(spark, sf_dir).sentences
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max("start").cast("long").alias("last_start"))


@query("SELECT doc_id, ord, span_start, span_end, len(own_actors) AS n_own_actors, len(actors) AS n_actors, len(location) AS n_location, len(temporal_anchor) AS n_anchor, temporal_category, relation_to_previous FROM ev", "documents")
def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _documents(spark, sf_dir)
    rows = events.numbered(e.features.withColumn("own", F.size("own_actors")))
    big = lambda c, name: c.cast("long").alias(name)
    return rows.select("doc_id", big(F.col("order"), "ord"), big(F.col("span_start"), "span_start"), big(F.col("span_end"), "span_end"), big(F.col("own"), "n_own_actors"), big(F.size("actors"), "n_actors"), big(F.length("location"), "n_location"), big(F.length("temporal_anchor"), "n_anchor"), F.col("rule_category").alias("temporal_category"), "relation_to_previous")


@query("SELECT doc_id, seg_no, type, temporal_category, track_id, round(story_order, 2)::DOUBLE AS story_order, span_start, span_end, len(entities) AS n_entities FROM sg", "documents")
def document_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _documents(spark, sf_dir).segments.withColumn("n_entities", F.size("entities")).withColumn("story_order", F.round("story_order", 2))
    return _flat(s, "doc_id", "seg_no", "type", "temporal_category", "track_id", "story_order", "span_start", "span_end", "n_entities")


@query("SELECT temporal_category, count(*) AS n_events, count(DISTINCT doc_id) AS n_docs FROM ev GROUP BY temporal_category", "documents")
def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).events.groupBy("temporal_category").agg(F.count("*").alias("n_events"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT doc_id, substr(sha256(d.text), 1, 16) AS id, len(d.text) AS n_chars, CASE WHEN lower(trim(lang)) IN ('ro', 'ron', 'rom', 'romanian', 'română', 'romana') THEN 'ro' ELSE 'en' END AS lang FROM documents d", "documents")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", X.document_hash(F.col("text")).alias("id"), F.length("text").cast("long").alias("n_chars"), X.language(F.col("lang")).alias("lang"))


@query("SELECT doc_id, sent_no - 1 AS sent_no, sentence, start FROM sents")
def story_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).sentences, "doc_id", "sent_no", "sentence", "start")


EVENT = ["id", "text", "actors", "temporal_anchor", "location", "action", "temporal_category", "relation_to_previous", "relation_cue", "relation_evidence", "span_start", "span_end"]


@query("SELECT doc_id, id, text, array_to_string(actors, '|') AS actors, temporal_anchor, location, action, temporal_category, relation_to_previous, relation_cue, relation_evidence, span_start, span_end FROM ev")
def story_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).events, "doc_id", *EVENT)


@query("""SELECT sg.doc_id, id, text, track_id, type, perspective, round(story_order, 2)::DOUBLE AS story_order, array_to_string(entities, '|') AS entities, array_to_string(actors, '|') AS actors,
  CASE WHEN lower(location) = 'unknown' THEN 'L1' ELSE coalesce('L' || n, '') END AS location_id, temporal_anchor, temporal_category, span_start, span_end, event_ids FROM sg LEFT JOIN lo ON lo.doc_id = sg.doc_id AND upper(lo.name) = upper(sg.location)""")
def story_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stories(spark, sf_dir).located_segments.withColumn("story_order", F.round("story_order", 2))
    return _flat(s, "doc_id", "id", "text", "track_id", "type", "perspective", "story_order", "entities", "actors", "location_id", "temporal_anchor", "temporal_category", "span_start", "span_end", "event_ids")


@query("SELECT id AS event_id, ord, text, array_to_string(actors, '|') AS actors, temporal_anchor, relation_to_previous, span_start FROM ev", "long")
def long_story_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of all events of the table, cut in parts (O-50 to O-52)."""
    c = Corpus.of_sentences(long_story(spark, sf_dir), parts=scans.PART)
    rows = c.events.withColumnRenamed("id", "event_id").withColumnRenamed("order", "ord")
    return _freeing(c, _flat(rows, "event_id", "ord", "text", "actors", "temporal_anchor", "relation_to_previous", "span_start"))


@query("""SELECT id, track_id, track_name, type, perspective, round(story_order, 2)::DOUBLE AS story_order, array_to_string(entities, '|') AS entities, temporal_anchor, location,
  temporal_category, span_start, span_end, event_ids FROM sg""", "long")
def long_story_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and tracks of one document of all events of the table, cut in parts (O-53 to O-57)."""
    c = Corpus.of_sentences(long_story(spark, sf_dir), parts=scans.PART)
    rows = c.segments.withColumn("story_order", F.round("story_order", 2))
    columns = ["id", "track_id", "track_name", "type", "perspective", "story_order", "entities", "temporal_anchor", "location", "temporal_category", "span_start", "span_end", "event_ids"]
    return _freeing(c, _flat(rows, *columns))


@query("SELECT doc_id, ord, from_id, rel, to_id, cue FROM rel")
def story_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).relations, "doc_id", "ord", "from_id", "rel", "to_id", "cue")


@query("SELECT doc_id, 'B' || ord AS id, type, a AS from_segment_id, b AS to_segment_id, t AS track_ids FROM bd")
def story_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).boundaries, "doc_id", "id", "type", "from_segment_id", "to_segment_id", "track_ids")


@query("SELECT doc_id, 'EP' || ord AS id, type, name, tt AS track_ids, segment_id FROM ep")
def story_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).endpoints, "doc_id", "id", "type", "name", "track_ids", "segment_id")


@query("""SELECT s.doc_id, s.track_id AS id, any_value(s.track_name) AS name, coalesce('EP' || max(l.ord), 'START') AS left_endpoint, coalesce('EP' || max(r.ord), 'STOP') AS right_endpoint
  FROM sg s LEFT JOIN wr l ON l.doc_id = s.doc_id AND l.track = s.track_id AND l.side = 'left' LEFT JOIN wr r ON r.doc_id = s.doc_id AND r.track = s.track_id AND r.side = 'right' GROUP BY s.doc_id, s.track_id""")
def story_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).tracks, "doc_id", "id", "name", "left_endpoint", "right_endpoint")


@query("SELECT doc_id, 0::BIGINT AS n, 'A0' AS id, 'Narrator' AS name FROM docs UNION ALL SELECT doc_id, n, 'A' || n, name FROM ac")
def story_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).actors, "doc_id", "n", "id", "name")


@query("SELECT doc_id, 1::BIGINT AS n, 'L1' AS id, 'unknown' AS name, '' AS parent_id FROM docs UNION ALL SELECT doc_id, n, 'L' || n, name, '' FROM lo")
def story_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).locations, "doc_id", "n", "id", "name", "parent_id")


@query("SELECT doc_id, 'EM' || n AS id, text, label, source, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end, event_id FROM mn")
def story_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).mentions, "doc_id", "id", "text", "label", "source", "span_start", "span_end", "event_id")


@query(f"""SELECT doc_id, 'e' || ord AS eid, {_class()} AS class, action AS text, span_start + {_ci('text', 'action')} - 1 AS span_start,
  span_start + {_ci('text', 'action')} - 1 + len(action) AS span_end, id AS source_event_id FROM ev""")
def story_tml_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).tml_events, "doc_id", "eid", "class", "text", "span_start", "span_end", "source_event_id")


@query(f"""SELECT doc_id, 'ei' || ord AS eiid, upper(temporal_category) AS tense, CASE WHEN {_has('text', 'perfective')} THEN 'PERFECTIVE' WHEN {_has('text', 'progressive')} THEN 'PROGRESSIVE' ELSE 'NONE' END AS aspect,
  CASE WHEN {_has('text', 'negative')} THEN 'NEG' ELSE 'POS' END AS polarity, 'VERB' AS pos, id AS source_event_id FROM ev""")
def story_makeinstances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).makeinstances, "doc_id", "eiid", "tense", "aspect", "polarity", "pos", "source_event_id")


@query(f"""SELECT doc_id, 't' || tid_no AS tid, {_timex_type()} AS type,
  {_value('temporal_anchor')} AS value, temporal_anchor AS text, span_start + {_ci('text', 'temporal_anchor')} - 1 AS span_start, span_start + {_ci('text', 'temporal_anchor')} - 1 + len(temporal_anchor) AS span_end FROM tm WHERE ord = f""")
def story_timex3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).timex3, "doc_id", "tid", "type", "value", "text", "span_start", "span_end")


@query(f"SELECT doc_id, 's' || sid_no AS sid, relation_cue AS text, span_start + {_ci('text', 'relation_cue')} - 1 AS span_start, span_start + {_ci('text', 'relation_cue')} - 1 + len(relation_cue) AS span_end, id AS event_id, relation_to_previous AS relation_hint FROM si")
def story_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).signals, "doc_id", "sid", "text", "span_start", "span_end", "event_id", "relation_hint")


@query("SELECT doc_id, 'l' || n AS lid, rel_type, a AS event_instance_id, b AS related_to_event_instance, t AS related_to_time, s AS signal_id FROM tl")
def story_tlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_stories(spark, sf_dir).tlinks, "doc_id", "lid", "rel_type", "event_instance_id", "related_to_event_instance", "related_to_time", "signal_id")


@query("""SELECT d.doc_id, len(d.text) AS character_count, (SELECT count(*) FROM ev WHERE ev.doc_id = d.doc_id) AS event_count, (SELECT count(*) FROM sg WHERE sg.doc_id = d.doc_id) AS segment_count,
  (SELECT count(DISTINCT track_id) FROM sg WHERE sg.doc_id = d.doc_id) AS track_count, (SELECT count(*) FROM rel WHERE rel.doc_id = d.doc_id) AS relation_count, (SELECT count(*) FROM tm WHERE tm.doc_id = d.doc_id AND ord = f) AS time_ml_timex_count,
  (SELECT count(*) FROM tl WHERE tl.doc_id = d.doc_id) AS time_ml_tlink_count, (SELECT count(*) FROM ev WHERE ev.doc_id = d.doc_id AND len(actors) = 0) AS events_without_actors, (SELECT count(*) FROM sg WHERE sg.doc_id = d.doc_id AND temporal_anchor = '') AS segments_without_anchor,
  (SELECT count(*) FROM ev WHERE ev.doc_id = d.doc_id) AS time_ml_event_count, 0::DOUBLE AS average_event_confidence, 0::DOUBLE AS average_segment_confidence,
  (SELECT string_agg(type || '=' || n, '|' ORDER BY n DESC, type) FROM (SELECT type, count(*) AS n FROM sg WHERE sg.doc_id = d.doc_id GROUP BY type)) AS segment_types,
  (SELECT string_agg(temporal_category || '=' || n, '|' ORDER BY n DESC, upper(temporal_category)) FROM (SELECT temporal_category, count(*) AS n FROM ev WHERE ev.doc_id = d.doc_id GROUP BY ALL)) AS temporal_categories,
  (SELECT string_agg(rel || '=' || n, '|' ORDER BY n DESC, rel) FROM (SELECT rel, count(*) AS n FROM rel WHERE rel.doc_id = d.doc_id GROUP BY ALL)) AS relation_types,
  (SELECT string_agg(label || '=' || n, '|' ORDER BY n DESC, label) FROM (SELECT label, count(*) AS n FROM mn WHERE mn.doc_id = d.doc_id GROUP BY ALL)) AS entity_mention_labels,
  (SELECT string_agg(source, '|' ORDER BY upper(source)) FROM (SELECT source FROM mn WHERE mn.doc_id = d.doc_id UNION SELECT 'heuristic_fallback')) AS extraction_sources FROM docs d""")
def story_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir).hold("events", "segments")
    return _freeing(c, _flat(_counted(c.analysis), "doc_id", *render.ANALYSIS, "events_without_actors", "segments_without_anchor"))


def _counted(analysis: DataFrame) -> DataFrame:
    """The analysis with its maps as strings."""
    joined = lambda m: F.concat_ws("|", F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return analysis.withColumns({m: joined(m) for m in ("segment_types", "temporal_categories", "relation_types", "entity_mention_labels")})


@query("""SELECT doc_id, severity, code, message, evidence FROM (
  SELECT doc_id, 'info' AS severity, 'EVENTS_WITHOUT_ACTORS' AS code, count(*) || ' event(s) do not have an explicit or carried actor.' AS message,
    'Actor extraction uses named-entity candidates and previous-actor carry-forward.' AS evidence FROM ev WHERE len(actors) = 0 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'info', 'SEGMENTS_WITHOUT_TIMEX', count(*) || ' segment(s) have no explicit temporal anchor.',
    'Temporal anchors are optional; use TIMEX3 annotations when exact time evidence is needed.' FROM sg WHERE temporal_anchor = '' GROUP BY doc_id
  UNION ALL SELECT doc_id, 'warning', 'NO_EVENTS', 'No event-like clauses were extracted.',
    'The input did not match the configured verb and sentence patterns.' FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM ev))""")
def story_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir).hold("events", "segments")
    return _freeing(c, c.issues.select("doc_id", "severity", "code", "message", "evidence"))


@query("""SELECT sg.doc_id, id AS segment_id, round(105 + 1015.0 / count(*) OVER (PARTITION BY sg.doc_id) * (seg_no - 1), 1)::DOUBLE AS chain_x, track_no AS row, (158 + (track_no - 1) * 86)::DOUBLE AS y,
  round(105 + step * i, 1)::DOUBLE AS x1, round(105 + step * (i + 1), 1)::DOUBLE AS x2, CASE WHEN type IN ('REM', 'SUP', 'FIC') THEN '2 6' ELSE '' END AS dash
  FROM (SELECT *, least(145.0, 1015.0 / (max(most) OVER (PARTITION BY doc_id) + 1)) AS step FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, track_id) AS most, row_number() OVER (PARTITION BY doc_id, track_id ORDER BY story_order, seg_no) - 1 AS i FROM sg)) sg""")
def story_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(render.layout(_stories(spark, sf_dir)), "doc_id", "segment_id", "chain_x", "row", "x1", "x2", "y", "dash")


@query("SELECT doc_id, id, temporal_category, relation_to_previous, coalesce(nullif(relation_cue, ''), '-') AS cue, 'n/a' AS confidence, text FROM ev")
def story_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.event_table(_stories(spark, sf_dir).events).drop("order")


@query("""SELECT doc_id, seg_no, id, type, track_id, array_to_string(actors, ', ') AS actors, coalesce(nullif(temporal_anchor, ''), '-') AS anchor, replace(event_ids, '|', ', ') AS events, 'n/a' AS confidence FROM sg""")
def story_segment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = report.segment_table(_stories(spark, sf_dir).segments)
    return _flat(t, *t.columns)


@query(rf""", lines AS (SELECT doc_id, 0 AS s, ord AS o, concat_ws('  ', 'e' || ord, action, {_class()}) AS l FROM ev
  UNION ALL SELECT doc_id, 1, tid_no, concat_ws('  ', 't' || tid_no, temporal_anchor, {_timex_type()}, {_value('temporal_anchor')}) FROM tm WHERE ord = f
  UNION ALL SELECT doc_id, 2, n, concat_ws('  ', 'l' || n, a || ' -> ' || coalesce(b, t), rel_type) FROM tl)
SELECT doc_id, rtrim(concat_ws(chr(10), 'EVENT', string_agg(l, chr(10) ORDER BY o) FILTER (s = 0), '', 'TIMEX3', string_agg(l, chr(10) ORDER BY o) FILTER (s = 1), '', 'TLINK', string_agg(l, chr(10) ORDER BY o) FILTER (s = 2))) AS listing FROM lines GROUP BY doc_id""")
def story_timeml_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir).hold("events")
    return _freeing(c, report.timeml_listing(c.tml_events, c.timex3, c.tlinks))


@query(f"""SELECT doc_id, concat_ws('|', {', '.join(map(_q, report.NOTES + report.NOTES_BY['en']))}, CASE WHEN doc_id NOT IN (SELECT doc_id FROM sg) THEN 'No text segments were detected.' END,
  CASE WHEN doc_id NOT IN (SELECT doc_id FROM ev) THEN 'NO_EVENTS: No event-like clauses were extracted.' END) AS warnings FROM docs""")
def story_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir).hold("events", "segments")
    return _freeing(c, _flat(c.warnings, "doc_id", "warnings"))


def _element(name: str, body: str | None = None, **attributes: str) -> str:
    """SQL for a line of XML; attributes: names, with _ for -, and expressions."""
    safe = lambda x: f"replace(replace(replace(replace(replace(coalesce(({x})::VARCHAR, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
    inside = " || ".join(f"' {k.replace('_', '-')}=\"' || {safe(v)} || '\"'" for k, v in attributes.items())
    return f"'    <{name}' || {inside} || " + ("' />'" if body is None else f"'>' || {safe(body)} || '</{name}>'")


def _xml_sql() -> str:
    at = "span_start || '~' || span_end"
    ids = "coalesce((SELECT string_agg('A' || ac.n, ',' ORDER BY k) FROM (SELECT unnest(range(1, len({t}.actors) + 1)) AS k) JOIN ac ON ac.doc_id = {t}.doc_id AND upper(ac.name) = upper({t}.actors[k])), '')"
    where = "coalesce((SELECT 'L' || lo.n FROM lo WHERE lo.doc_id = {t}.doc_id AND upper(lo.name) = upper({t}.location)), 'L1')"
    found = lambda part: f"CASE WHEN {_ci('text', part)} > 0 THEN span_start + {_ci('text', part)} - 1 ELSE span_start END"
    spans = lambda part: f"({found(part)}) || '~' || (CASE WHEN {_ci('text', part)} > 0 THEN ({found(part)}) + len({part}) ELSE ({found(part)}) END)"
    reasons = "CASE type " + " ".join(f"WHEN '{k}' THEN {_q(v)}" for k, v in links.REASONS.items()) + " END"
    rel = dict(ID="'TI' || ord", FROM="from_id", REL="replace(rel, '_', '-')", TO="to_id", CUE="cue")
    cross = f"CASE WHEN parallel THEN {_q(links.CROSS_PARALLEL)} ELSE {_q(links.CROSS)} END"
    sections = [
        ("0, 0, n", _element("TA", ID="'A' || n", NAME="name"), "(SELECT doc_id, 0 AS n, 'Narrator' AS name FROM docs UNION ALL SELECT doc_id, n, name FROM ac)"),
        ("1, 0, n", _element("TL", ID="'L' || n", NAME="name", PARENTID="''"), "(SELECT doc_id, 1 AS n, 'unknown' AS name FROM docs UNION ALL SELECT doc_id, n, name FROM lo)"),
        ("2, 0, n", _element("ENTITY-MENTION", ID="'EM' || n", TYPE="label", SOURCE="source", EVENT="event_id", SPANS=at, TEXT="text"), "mn"),
        ("3, 0, ord", _element("EVENT", ID="id", SPANS=at, ACTORS=ids.format(t="ev"), LOCATION=where.format(t="ev"), TEMPORAL_ANCHOR="temporal_anchor", TENSE="temporal_category", ACTION="action", REL_PREV="relation_to_previous", REL_CUE="relation_cue", ORDER="ord", TEXT="text"), "ev"),
        ("4, 0, ord", _element("EVENT", "action", eid="'e' || ord", **{"class": _class()}, eventRef="id", spans=spans("action")), "ev"),
        ("4, 1, tid_no", _element("TIMEX3", "temporal_anchor", tid="'t' || tid_no", type=_timex_type(), value=_value("temporal_anchor"), functionInDocument="'NONE'", source=f"CASE WHEN {_ci('text', 'temporal_anchor')} > 0 THEN 'explicit_temporal_expression' ELSE 'inherited_temporal_anchor' END", spans=spans("temporal_anchor")), "(SELECT * FROM tm WHERE ord = f)"),
        ("4, 2, sid_no", _element("SIGNAL", "relation_cue", sid="'s' || sid_no", eventId="id", relationHint="relation_to_previous", spans=spans("relation_cue")), "si"),
        ("4, 3, ord", _element("MAKEINSTANCE", eiid="'ei' || ord", eventID="'e' || ord", tense="upper(temporal_category)", aspect=f"CASE WHEN {_has('text', 'perfective')} THEN 'PERFECTIVE' WHEN {_has('text', 'progressive')} THEN 'PROGRESSIVE' ELSE 'NONE' END", polarity=f"CASE WHEN {_has('text', 'negative')} THEN 'NEG' ELSE 'POS' END", pos="'VERB'", eventRef="id"), "ev"),
        ("4, 4, n", _element("TLINK", lid="'l' || n", relType="rel_type", eventInstanceID="a", relatedToEventInstance="b", timeID="''", relatedToTime="t", signalID="s", origin="CASE WHEN k = 0 THEN 'event_temporal_anchor' WHEN s IS NULL THEN 'event_text_order' ELSE 'event_relation_signal' END"), "tl"),
        ("5, 0, track_no", _element("TT", ID="'TT' || track_no", NAME="track_name", LEFT_EP="coalesce((SELECT 'EP' || max(ord) FROM wr WHERE wr.doc_id = t.doc_id AND wr.track = 'TT' || t.track_no AND side = 'left'), 'START')", RIGHT_EP="coalesce((SELECT 'EP' || max(ord) FROM wr WHERE wr.doc_id = t.doc_id AND wr.track = 'TT' || t.track_no AND side = 'right'), 'STOP')"), "(SELECT DISTINCT doc_id, track_no, track_name FROM sg) t"),
        ("6, 0, ord", f"CASE WHEN from_id LIKE 'TS%' THEN {_element('TREL', **rel, EVIDENCE='evidence')} ELSE {_element('TIME', **rel, EVIDENCE=cross)} END", "(SELECT rel.*, sg.evidence, sg.parallel FROM rel JOIN sg USING (doc_id, seg_no))"),
        ("7, 0, ord", _element("ENDPOINT", ID="'EP' || ord", TYPE="type", NAME="name", TT1="split_part(tt, '|', 1)", TT2="split_part(tt, '|', 2)", SEGMENT="segment_id"), "ep"),
        ("8, 0, ord", _element("POINT", ID="'B' || ord", TYPE="type", FROM_TS="a", TO_TS="b", TRACKS="replace(t, '|', ' ')", REASON=reasons), "bd"),
        ("9, 0, seg_no", _element("TS", "text", ID="id", IN_TT="track_id", SPANS=at, ACTORS=ids.format(t="sg"), LOCATION=where.format(t="sg"), NAME="id", TYPE="type", TST="temporal_category", TIME="temporal_anchor", PER="perspective", EVENTS="replace(event_ids, '|', ',')"), "sg"),
    ]
    lines = " UNION ALL ".join(f"SELECT doc_id, {place}, {line} FROM {rows}" for place, line, rows in sections)
    body = ", ".join(f"'  <{name}>', string_agg(line, chr(10) ORDER BY k, o) FILTER (s = {n}), '  </{name}>'" for n, name in enumerate(render.SECTIONS))
    return f""", lines(doc_id, s, k, o, line) AS ({lines})
SELECT doc_id, concat_ws(chr(10), '<?xml version="1.0" encoding="utf-8"?>', '<NARRATIVE>', {body}, '</NARRATIVE>') || chr(10) AS xml FROM lines GROUP BY doc_id"""


@query(_xml_sql())
def story_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir, keep=True)
    return _freeing(c, render.xml(c))


@query()
def story_svg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _stories(spark, sf_dir).hold("segments")
    return _freeing(c, render.svg(c, highlight=("Adam",)))


@query()
def story_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json(_stories(spark, sf_dir).settled())


@query()
def story_model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(stories(spark, sf_dir), language=None, category_model=models.category_model(spark), type_model=models.type_model(spark))
    return _flat(c.segments, "doc_id", "id", "type", "temporal_category", "confidence", "classifier")


_C = L.cue
_ANCHORS = f"regexp_extract_all(text, {_q(_C('anchor', 'compared').re2)})"
_PLACES = f"regexp_extract_all(text, {_q(L.place().re2)}, 1)"
_NAMES = f"regexp_extract_all(text, {_q(L.entity().re2)})"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS sentences, len(regexp_extract_all(text, '\w+|[^\w\s]')) AS tokens, len(list_distinct(list_transform(p, lambda x: upper(x)))) AS location_entities,
  len(list_distinct(list_transform(a, lambda x: upper(x)))) AS temporal_entities, len(list_distinct(list_filter(list_transform(n, lambda x: lower(x)), lambda x, i: NOT list_contains({_list(L.COMPARED_STOPWORDS)}, n[i])
    AND NOT list_contains(list_transform(p, lambda y: lower(y)), x) AND NOT list_contains(list_transform(a, lambda y: lower(y)), x)))) AS person_entities
  FROM (SELECT doc_id, text, {_ANCHORS} AS a, {_PLACES} AS p, {_NAMES} AS n FROM docs)""")
def compared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(comparison.counts(events.documents(stories(spark, sf_dir), language=None)), "doc_id", "sentences", "tokens", "location_entities", "temporal_entities", "person_entities")


@query()
def compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = events.documents(stories(spark, sf_dir), language=None).withColumn("doc_id", F.col("doc_id").cast("string"))
    runs = comparison.rule_runs(docs)
    for other in (*(comparison.toolkit_runs(docs, t) for t in ("spacy", "stanza")), *(comparison.java_tool_runs(docs, t) for t in comparison.JAVA_TOOLS), comparison.saved_runs(docs, None, "")):
        runs = runs.unionByName(other)
    return runs


@query(r"SELECT doc_id, id, CASE WHEN len(text) <= 44 THEN text ELSE rtrim(text[1:43]) || '...' END AS label FROM ev")
def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stories(spark, sf_dir).events.select("doc_id", "id", X.label(F.col("text")).alias("label"))


@query(r"""SELECT event_id, replace(replace(replace('caf' || chr(233) || chr(160) || chr(255) || chr(256) || ' & "' || event_type || '"', '&', '&amp;'), '"', '&quot;'), chr(233) || chr(160) || chr(255), '&#233;&#160;&#255;') AS escaped FROM events""")
def text_escape_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", X.escape(F.concat(F.lit('caf\u00e9\u00a0\u00ff\u0100 & "'), "event_type", F.lit('"'))).alias("escaped"))


@query("SELECT event_id, replace(replace(replace(replace(replace(props || '<''&>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM events")
def text_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", X.escape(F.concat("props", F.lit("<'&>"))).alias("escaped"))


@query(r"SELECT doc_id, list_position(p, s) AS first_place, s AS sentence FROM (SELECT DISTINCT doc_id, p, unnest(p) AS s FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM docs))")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stories(spark, sf_dir).select("doc_id", events.sentence_split(F.col("text")).alias("p"))
    return s.select("doc_id", F.explode(F.array_distinct("p")).alias("sentence"), "p").select("doc_id", F.array_position("p", F.col("sentence")).alias("first_place"), "sentence")


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'ro' WHEN 2 THEN NULL WHEN 3 THEN 'en' WHEN 4 THEN 'ro' END AS strict, CASE WHEN event_id % 6 IN (1, 4) THEN 'ro' ELSE 'en' END AS lenient FROM events")
def text_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.element_at(F.array(*map(F.lit, ("ENG", " română", "fr", "english", "ROM", ""))), (F.col("event_id") % 6 + 1).cast("int"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", names.alias("name"))
    return e.select("event_id", X.language_strict(F.col("name")).alias("strict"), X.language(F.col("name")).alias("lenient"))


@query("SELECT doc_id, rel AS key, count(*) AS cnt, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, rel) AS rank FROM rel GROUP BY doc_id, rel")
def story_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(report.count_by(_stories(spark, sf_dir).relations, "rel", "ord"), "doc_id", "key", "cnt", "rank")


@query("SELECT sg.doc_id, track_id, string_agg(id, '|' ORDER BY story_order, seg_no) AS segment_ids, count(*) AS n_segments FROM sg GROUP BY sg.doc_id, track_id")
def story_track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stories(spark, sf_dir).segments.groupBy("doc_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("story_order", "seg_no", "id"))).alias("x"), F.count("*").alias("n_segments"))
    return s.select("doc_id", "track_id", F.concat_ws("|", F.transform("x", lambda r: r["id"])).alias("segment_ids"), "n_segments")


@query("SELECT e.doc_id, e.ord, string_agg('A' || ac.n, '|' ORDER BY k) AS actor_ids FROM (SELECT doc_id, ord, actors, unnest(range(1, len(actors) + 1)) AS k FROM ev) e JOIN ac ON ac.doc_id = e.doc_id AND upper(ac.name) = upper(e.actors[k]) GROUP BY ALL")
def story_event_actor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    events_ = _stories(spark, sf_dir).events.select("doc_id", "order", "lang", "actors")  # what isn't asked for is neither made nor exploded
    rows = dimensions.event_actor_ids(events_).where("size(actors) > 0")
    return _flat(rows.withColumnRenamed("order", "ord"), "doc_id", "ord", "actor_ids")


def _compared(name: str) -> str:
    return f"regexp_matches(chunk, {_q(_C(name, 'compared').re2)})"


def _unique(items: str) -> str:
    """Distinct strings whatever their case, white space collapsed; the first spelling stays."""
    plain = rf"list_filter(list_transform({items}, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')"
    return f"list_filter({plain}, lambda x, i: list_position(list_transform({plain}, lambda y: upper(y)), upper(x)) = i)"


_OWN = f"list_filter({_NAMES.replace('text', 'chunk')}, lambda x: NOT list_contains({_list(L.COMPARED_STOPWORDS)}, x) AND NOT list_contains(list_transform(locations, lambda y: lower(y)), lower(x)) AND NOT list_contains(list_transform(own_anchors, lambda y: lower(y)), lower(x)))"

# Ends of sentences are marked first, for patterns can't look behind here.
_SEPARATORS = _q("(?i)" + chr(1) + "|" + L.boundary("compared").body.partition("|")[2])
_CHUNKS = rf"""
, chunks AS (SELECT doc_id, k, regexp_replace(parts[k], '^\s+|\s+$', '', 'g') AS chunk FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), {_SEPARATORS}) AS parts FROM docs))),
verbs AS (SELECT *, regexp_extract(chunk, {_q(_C("verb", "compared").re2)}, 0) AS verb FROM chunks WHERE chunk <> ''),
isled AS (SELECT *, sum((verb <> '')::INT) OVER (PARTITION BY doc_id ORDER BY k) AS n FROM verbs),
pe0 AS (SELECT doc_id, n, first(chunk ORDER BY k) AS chunk, first(verb ORDER BY k) AS action, string_agg(chunk, ' ' ORDER BY k) AS text FROM isled WHERE n > 0 GROUP BY doc_id, n),
pe1 AS (SELECT *, {_unique(_PLACES.replace('text', 'chunk'))} AS locations, {_unique(_ANCHORS.replace('text', 'chunk'))} AS own_anchors FROM pe0),
pe2 AS (SELECT *, {_unique(_OWN)} AS own_actors FROM pe1),
pe AS (SELECT *, coalesce(last_value(CASE WHEN len(own_actors) > 0 THEN own_actors END IGNORE NULLS) OVER w, []) AS actors, coalesce(last_value(CASE WHEN len(own_anchors) > 0 THEN own_anchors END IGNORE NULLS) OVER w, []) AS temporal_anchors
  FROM pe2 WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
_EVENTS_COMPARED = rf"""SELECT doc_id, n::BIGINT AS n, text, action, CASE WHEN {_compared("future")} THEN 'Future' WHEN {_compared("past")} THEN 'Past' ELSE 'Present' END AS temporal_category,
  CASE WHEN n = 1 THEN NULL WHEN {_compared("simultaneous")} THEN 'SIMULTANEOUS' WHEN {_compared("before")} THEN 'BEFORE' WHEN {_compared("after")} THEN 'AFTER' ELSE 'IMMEDIATELY_BEFORE' END AS relation_to_previous"""


@query(f"{_CHUNKS} {_EVENTS_COMPARED}, array_to_string(actors, '|') AS actors, array_to_string(locations, '|') AS locations, array_to_string(temporal_anchors, '|') AS temporal_anchors FROM pe")
def compared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(comparison.events(events.documents(stories(spark, sf_dir), language=None)), "doc_id", "n", "text", "action", "actors", "locations", "temporal_anchors", "temporal_category", "relation_to_previous")


_KEY = "list_sort(list_distinct(list_transform(actors, lambda x: lower(x))))"


@query(rf"""{_CHUNKS}, pc AS ({_EVENTS_COMPARED}, {_KEY} AS key, len(temporal_anchors) AS n_anchors FROM pe),
ps AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(temporal_category) OVER w = temporal_category THEN 0 ELSE 1 END AS new FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
pn AS (SELECT doc_id, count(*) AS events, sum(n_anchors)::BIGINT AS temporal_anchors, sum(new)::BIGINT AS time_segments, count(DISTINCT (key, temporal_category)) AS time_tracks FROM ps GROUP BY doc_id)
SELECT doc_id, coalesce(events, 0) AS events, coalesce(temporal_anchors, 0) AS temporal_anchors, greatest(0, coalesce(events, 0) - 1) AS temporal_relations, coalesce(time_segments, 0) AS time_segments, coalesce(time_tracks, 0) AS time_tracks FROM docs LEFT JOIN pn USING (doc_id)""")
def compared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(comparison.counts(events.documents(stories(spark, sf_dir), language=None)), "doc_id", "events", "temporal_anchors", "temporal_relations", "time_segments", "time_tracks")


_EXAMPLE = "'{\"text\":' || to_json(text) || ',\"action\":' || to_json(action) || ',\"actors\":' || to_json(actors) || ',\"locations\":' || to_json(locations) || ',\"temporal_anchors\":' || to_json(temporal_anchors) || ',\"temporal_category\":\"' || temporal_category || '\",\"relation_to_previous\":' || coalesce('\"' || relation_to_previous || '\"', 'null') || '}'"


@query(rf"""{_CHUNKS}, pc AS ({_EVENTS_COMPARED}, actors, locations, temporal_anchors, {_KEY} AS key FROM pe),
ps AS (SELECT *, CASE WHEN lag(key) OVER w = key AND lag(temporal_category) OVER w = temporal_category THEN 0 ELSE 1 END AS new FROM pc WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
pg AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS seg_no, {_EXAMPLE} AS j FROM ps),
pl AS (SELECT doc_id, seg_no, '[' || string_agg(to_json(text), ',' ORDER BY n) || ']' AS g FROM pg WHERE seg_no <= {comparison.EXAMPLES} GROUP BY ALL)
SELECT doc_id, '{{"events":[' || coalesce((SELECT string_agg(j, ',' ORDER BY n) FROM pg WHERE pg.doc_id = docs.doc_id AND n <= {comparison.EXAMPLES}), '') || '],"segments":[' || coalesce((SELECT string_agg(g, ',' ORDER BY seg_no) FROM pl WHERE pl.doc_id = docs.doc_id), '') || ']}}' AS examples FROM docs""")
def compared_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.examples(events.documents(stories(spark, sf_dir), language=None))


@query(f"{_CHUNKS} {_EVENTS_COMPARED} FROM pe")
def compared_event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(comparison.events(events.documents(stories(spark, sf_dir), language=None)), "doc_id", "n", "text", "action", "temporal_category", "relation_to_previous")


@query("""SELECT user_id AS doc_id, event_id, CASE WHEN event_type = 'error' THEN 'Request body must include a non-empty string field named ''text''.'
  WHEN event_type = 'click' THEN '''options.layout'' must be one of: both, text_order, time_yard.' WHEN event_type = 'view' THEN '''options.language'' must be one of: en, ro.' END AS error FROM events""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_type")
    asked = e.select(F.col("user_id").alias("doc_id"), "event_id", F.when(k == "error", " \n").otherwise("Adam left.").alias("text"), F.when(k == "click", "circle").otherwise("both").alias("layout"), F.when(k == "view", "Latin").otherwise(" Romanian ").alias("language"))
    return requests.validate(asked).select("doc_id", "event_id", "error")


@query("""SELECT 'storyloom' AS service, '1.0.0' AS version, 'non-LLM rules with optional seed classifiers and TimeML-style annotations' AS extraction, 'en|ro' AS supported_languages, 'response|json|svg|xml' AS renderings, true AS ok""")
def service(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = requests.describe(spark)
    return _flat(d, *d.columns)


# Romanian.


def _romanian(spark: SparkSession, sf_dir: str) -> Corpus:
    return _stories(spark, sf_dir, lang="ro")


@query("SELECT doc_id, id, text, array_to_string(actors, '|') AS actors, temporal_anchor, location, action, temporal_category, relation_to_previous, relation_cue, relation_evidence, span_start, span_end, 0.75::DOUBLE AS confidence, 'romanian_rule_event_temporal' AS classifier FROM ev", "romanian")
def romanian_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_romanian(spark, sf_dir).events, "doc_id", *EVENT, "confidence", "classifier")


@query("""SELECT sg.doc_id, id, text, track_id, track_name, type, perspective, round(story_order, 2)::DOUBLE AS story_order, array_to_string(entities, '|') AS entities, array_to_string(actors, '|') AS actors,
  CASE WHEN lower(location) = 'unknown' THEN '' ELSE coalesce('L' || n, '') END AS location_id, temporal_anchor, temporal_category, span_start, span_end, event_ids, 0.75::DOUBLE AS confidence, 'romanian_rule_segment_type' AS classifier
  FROM sg LEFT JOIN lo ON lo.doc_id = sg.doc_id AND upper(lo.name) = upper(sg.location)""", "romanian")
def romanian_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _romanian(spark, sf_dir).located_segments.withColumn("story_order", F.round("story_order", 2))
    return _flat(s, "doc_id", "id", "text", "track_id", "track_name", "type", "perspective", "story_order", "entities", "actors", "location_id", "temporal_anchor", "temporal_category", "span_start", "span_end", "event_ids", "confidence", "classifier")


@query("SELECT doc_id, ord, from_id, rel, to_id, cue FROM rel", "romanian")
def romanian_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_romanian(spark, sf_dir).relations, "doc_id", "ord", "from_id", "rel", "to_id", "cue")


@query("SELECT doc_id, 'EM' || n AS id, text, label, source, span_start::BIGINT AS span_start, span_end::BIGINT AS span_end, event_id FROM mn", "romanian")
def romanian_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_romanian(spark, sf_dir).mentions, "doc_id", "id", "text", "label", "source", "span_start", "span_end", "event_id")


@query("SELECT doc_id, 'A' || n AS id, name FROM (SELECT doc_id, 0 AS n, 'Narator' AS name FROM docs UNION ALL SELECT doc_id, n, name FROM ac) UNION ALL SELECT doc_id, 'L' || n, name FROM (SELECT doc_id, 1 AS n, 'necunoscut' AS name FROM docs UNION ALL SELECT doc_id, n, name FROM lo)", "romanian")
def romanian_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _romanian(spark, sf_dir)
    return c.actors.select("doc_id", "id", "name").unionByName(c.locations.select("doc_id", "id", "name"))


@query(rf"""SELECT doc_id, 'e' || ord AS eid, {_class('ro')} AS class, upper(temporal_category) AS tense, CASE WHEN {_has('text', 'perfective', 'ro')} THEN 'PERFECTIVE' WHEN {_has('text', 'progressive', 'ro')} THEN 'PROGRESSIVE' ELSE 'NONE' END AS aspect,
  CASE WHEN {_has('text', 'negative', 'ro')} THEN 'NEG' ELSE 'POS' END AS polarity FROM ev""", "romanian")
def romanian_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _romanian(spark, sf_dir)
    return c.tml_events.select("doc_id", "eid", "class").join(c.makeinstances.select("doc_id", F.col("event_id").alias("eid"), "tense", "aspect", "polarity"), ["doc_id", "eid"])


@query(f"SELECT doc_id, 't' || tid_no AS tid, {_timex_type('ro')} AS type, {_value('temporal_anchor')} AS value, temporal_anchor AS text FROM tm WHERE ord = f", "romanian")
def romanian_timex3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _romanian(spark, sf_dir).timex3.select("doc_id", "tid", "type", "value", "text")


@query("SELECT doc_id, 'l' || n AS lid, rel_type, a AS event_instance_id, b AS related_to_event_instance, t AS related_to_time, s AS signal_id FROM tl", "romanian")
def romanian_tlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_romanian(spark, sf_dir).tlinks, "doc_id", "lid", "rel_type", "event_instance_id", "related_to_event_instance", "related_to_time", "signal_id")


# Gates, and averages, over predictions that are made of the texts' lengths.


def _made_up(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """rows with predicted and score; some predictions are unknown labels, some are missing."""
    n = F.length("text")
    return rows.withColumns({"predicted": F.get(F.array(*map(F.lit, (*labels, "OTHER"))), F.pmod(n, F.lit(len(labels) + 1))), "score": F.when(n % 11 != 0, F.pmod(n * 7, F.lit(101)) / 100)})


def _predicted(labels: tuple[str, ...]) -> str:
    return f"{_list([*labels, 'OTHER'])}[len(text) % {len(labels) + 1} + 1] AS predicted, CASE WHEN len(text) % 11 <> 0 THEN (len(text) * 7 % 101) / 100 END AS score"


def _gate(rule: str, labels: tuple[str, ...], least: float, conflict: str, why: str, model: str) -> str:
    """label, confidence and source, by the rule's column."""
    back = f"CASE WHEN score IS NULL THEN '' WHEN NOT list_contains({_list(list(labels))}, predicted) THEN '_unknown_ml_label' WHEN score < {least} THEN '_low_ml_confidence' WHEN {conflict} THEN '_{why}' END"
    return f"CASE WHEN {back} IS NULL THEN predicted ELSE {rule} END AS label, CASE WHEN {back} IS NULL THEN score ELSE 0 END::DOUBLE AS confidence, CASE WHEN {back} IS NULL THEN '{model}' ELSE 'heuristic_fallback' || {back} END AS source"


_CATEGORY_GATE = _gate("temporal_category", models.CATEGORIES, models.CATEGORY_LEAST, "temporal_category <> 'Present' AND predicted <> temporal_category", "explicit_tense", "mlnet_event_temporal_model")
_TYPE_GATE = _gate("type", models.TYPES, models.TYPE_LEAST, f"type <> 'NAR' AND predicted <> type AND score < {models.TYPE_SURE}", "conflict", "mlnet_seed_model")


@query(f"SELECT doc_id, id, {_CATEGORY_GATE} FROM (SELECT *, {_predicted(models.CATEGORIES)} FROM ev)")
def gate_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made_up(_stories(spark, sf_dir).events, models.CATEGORIES)
    return rows.select("doc_id", "id", models.category_gate(F.col("predicted"), F.col("score"), F.col("temporal_category")).alias("g")).select("doc_id", "id", "g.*")


@query(f"SELECT doc_id, id, {_TYPE_GATE} FROM (SELECT *, {_predicted(models.TYPES)} FROM sg)")
def gate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _made_up(_stories(spark, sf_dir).segments, models.TYPES)
    return rows.select("doc_id", "id", models.segment_gate(F.col("predicted"), F.col("score"), F.col("type")).alias("g")).select("doc_id", "id", "g.*")


@query(f""", ge AS (SELECT doc_id, {_CATEGORY_GATE} FROM (SELECT *, {_predicted(models.CATEGORIES)} FROM ev)), gs AS (SELECT doc_id, {_TYPE_GATE} FROM (SELECT *, {_predicted(models.TYPES)} FROM sg))
SELECT doc_id, (SELECT round_even(avg(confidence), 3) FROM ge WHERE ge.doc_id = d.doc_id) AS average_event_confidence, (SELECT round_even(avg(confidence), 3) FROM gs WHERE gs.doc_id = d.doc_id) AS average_segment_confidence,
  (SELECT string_agg(s, '|' ORDER BY upper(s)) FROM (SELECT source AS s FROM ge WHERE ge.doc_id = d.doc_id UNION SELECT source FROM gs WHERE gs.doc_id = d.doc_id UNION SELECT source FROM mn WHERE mn.doc_id = d.doc_id)) AS extraction_sources FROM docs d""")
def scored_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages and sources of a corpus whose events and segments have made-up confidences."""
    c = _stories(spark, sf_dir).hold("events", "segments")
    scored = lambda rows, labels, gate, rule: _made_up(rows, labels).withColumn("g", gate(F.col("predicted"), F.col("score"), F.col(rule))).withColumns({"confidence": F.col("g.confidence"), "classifier": F.col("g.source")})
    evs, segs = scored(c.events, models.CATEGORIES, models.category_gate, "temporal_category"), scored(c.segments, models.TYPES, models.segment_gate, "type")
    made = report.analysis(c.documents, evs, segs, c.tracks, c.relations, c.mentions, c.tml_events, c.timex3, c.tlinks)
    return _freeing(c, _flat(made, "doc_id", "average_event_confidence", "average_segment_confidence", "extraction_sources"))


_BODIES = "CASE event_id % 5 WHEN 0 THEN concat('{\"text\": \"Adam left ', event_type, '.\", \"options\": {\"width\": 900, \"layout\": \"text_order\"}}') WHEN 1 THEN '[1]' WHEN 2 THEN '{\"text\": \" \"}' WHEN 3 THEN NULL ELSE '{\"text\": \"Da.\", \"options\": {\"language\": \"ROM\", \"include_debug\": true}}' END"


@query(f"""SELECT event_id AS doc_id, CASE event_id % 5 WHEN 0 THEN 'Adam left ' || event_type || '.' WHEN 2 THEN ' ' WHEN 4 THEN 'Da.' END AS text, CASE event_id % 5 WHEN 0 THEN 'text_order' ELSE 'both' END AS layout, CASE event_id % 5 WHEN 0 THEN 900 ELSE 1200 END::BIGINT AS width,
  CASE event_id % 5 WHEN 4 THEN 'ROM' ELSE 'en' END AS language, event_id % 5 = 4 AS include_debug, CASE event_id % 5 WHEN 1 THEN {_q(requests.NO_BODY)} WHEN 2 THEN {_q(requests.NO_TEXT)} WHEN 3 THEN {_q(requests.NO_BODY)} END AS error FROM events""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("doc_id"), F.expr(_BODIES).alias("body"))
    return _flat(requests.parse(e), "doc_id", "text", "layout", "width", "language", "include_debug", "error")


@query("""SELECT user_id AS doc_id, greatest(0, count(DISTINCT event_type) - 1) AS person_entities, count(DISTINCT event_type) + 2 AS named_entities, 1 AS location_entities, count(*) AS events, count(*) FILTER (event_id % 3 <> 0) AS temporal_anchors,
  count(*) FILTER (event_id % 2 = 0) AS temporal_relations, 0 AS time_segments, count(*) AS time_tracks FROM events GROUP BY user_id""")
def saved_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of saved responses, whose JSON is made of each user's events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    even = F.collect_list(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    diagram = F.struct(
        F.collect_set("event_type").alias("actors"), F.array(F.lit("unknown"), F.lit("house")).alias("locations"), even.alias("relations"), F.array().cast("array<string>").alias("segments"),
        F.collect_list(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("event_type")).otherwise("").alias("temporal_anchor"))).alias("events"), F.collect_list("event_type").alias("tracks"),
    )
    made = e.groupBy(F.col("user_id").alias("doc_id")).agg(diagram.alias("diagram")).select("doc_id", F.to_json(F.struct("diagram")).alias("json"))
    counted = requests.saved_counts(made)
    return _flat(counted, *counted.columns)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and tracks by document, of the stories."""
    s = _stories(spark, sf_dir).segments
    return s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.count_distinct("track_id").alias("n_tracks"), F.count_if(F.col("type") != "NAR").alias("n_marked"))


QUERIES["story_summary"] = summary
ORACLES["story_summary"] = f"{_tables('stories')} SELECT doc_id, count(*) AS n_segments, count(DISTINCT track_id) AS n_tracks, count(*) FILTER (type <> 'NAR') AS n_marked FROM sg GROUP BY doc_id"
