"""Column functions over texts: extractors and predicates, native throughout.

Each takes the text's column and that of its language (``en`` or ``ro``), or None for English alone. Missing is the empty string, not null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions import lexicon as L

Lang = Column | None


def by_language(lang: Lang, make) -> Column:
    """make("ro") for Romanian rows, make("en") for others."""
    return make("en") if lang is None else F.when(lang == "ro", make("ro")).otherwise(make("en"))


def trim(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def has(text: Column, name: str, lang: Lang = None) -> Column:
    return by_language(lang, lambda k: text.rlike(L.cue(name, k).java))


def first(text: Column, name: str, lang: Lang = None) -> Column:
    """The first match, or the empty string."""
    return by_language(lang, lambda k: F.regexp_extract(text, L.cue(name, k).java, 0))


def count(text: Column, name: str, lang: Lang = None) -> Column:
    return by_language(lang, lambda k: F.regexp_count(text, F.lit(L.cue(name, k).java)))


def bound(value: Column, make) -> Column:
    """make(value), with value evaluated once although make uses it in a lambda or more than once."""
    return F.get(F.transform(F.array(value), make), 0)


def distinct_ci(items: Column) -> Column:
    """Distinct strings whatever their case; the first spelling stays, in order. Sorted by key and place, so long lists take little more than their length."""
    keyed = F.array_sort(F.transform(items, lambda x, i: F.struct(F.upper(x).alias("k"), i.alias("i"), x.alias("x"))))
    firsts = bound(keyed, lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"])))
    return F.transform(F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def starts(parts: str) -> Column:
    """Where each string of the column of arrays begins in all of them together. Sums are made in blocks, for an array is copied whenever it grows."""
    so_far = "aggregate({items}, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('at', a.at + {value}, 'out', array_append(a.out, a.at)))"
    block = so_far.format(items=f"slice({parts}, b * 256 + 1, 256)", value="length(x)")
    blocks = f"transform(sequence(0, greatest(size({parts}) - 1, 0) div 256), b -> {block})"
    offsets = so_far.format(items="s", value="x.at") + ".out"
    return F.expr(f"transform(array({blocks}), s -> transform(array({offsets}), o -> flatten(transform(s, (x, b) -> transform(x.out, y -> y + o[b]))))[0])[0]")


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists hold the same strings as often, in any order and case."""
    return F.array_sort(F.transform(a, F.upper)) == F.array_sort(F.transform(b, F.upper))


def entities(text: Column, lang: Lang = None) -> Column:
    """Capitalised candidates in order, without those of stopwords alone."""

    def make(k: str) -> Column:
        stop = F.array(*(F.lit(w) for w in (L.RO_STOPWORDS if k == "ro" else L.EN_STOPWORDS)))
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(L.entity(k).java), F.lit(0)))
        return F.filter(found, lambda x: ~F.forall(F.filter(F.split(x, " "), lambda p: p != ""), lambda p: F.array_contains(stop, p)))

    return by_language(lang, make)


def actors(text: Column, lang: Lang = None) -> Column:
    """Entities that are neither times nor, in this text, places."""

    def make(k: str) -> Column:
        before, after = L.place_before(k)
        near = text.rlike(rf"(?iU)\b{L.any_of(L.LANGUAGES[k]['place_preposition'])}\s")

        def person(x: Column) -> Column:
            place = F.concat(F.lit(f"(?iU){before}\\Q"), x, F.lit(f"\\E{after}"))
            return ~x.rlike(L.cue("temporal_entity", k).java) & ~(near & F.regexp(text, place))

        return F.filter(entities(text, None if k == "en" else F.lit("ro")), person)

    return by_language(lang, make)


def anchor(text: Column, lang: Lang = None) -> Column:
    return trim(first(text, "anchor", lang))


def location(text: Column, lang: Lang = None) -> Column:
    def make(k: str) -> Column:
        found = F.regexp_extract(text, L.place(k).java, 1)
        return F.when(found != "", found).otherwise(F.regexp_extract(text, L.RO_ON.java, 1)) if k == "ro" else found

    return trim(by_language(lang, make))


def action(text: Column, lang: Lang = None) -> Column:
    return first(text, "verb", lang)


def category(text: Column, lang: Lang = None) -> Column:
    return F.when(has(text, "future", lang), "Future").when(has(text, "past", lang), "Past").otherwise("Present")


# Relations by cue, in the order in which cues are tried, with their evidence.
CUES = [
    ("parallel", "SIMULTANEOUS", "Parallel cue places this event alongside the previous event."),
    ("retrospective", "BEFORE", "Retrospective cue places this event earlier than the previous event."),
    ("sequential", "IMMEDIATELY_AFTER", "Sequential cue places this event immediately after the previous event."),
    ("forward", "AFTER", "Forward cue places this event after the previous event."),
]
NO_CUE = ("IMMEDIATELY_AFTER", "", "No explicit cue; defaulting to text-order adjacency.")
FIRST_EVENT = ("NONE", "", "First event in text order.")


def temporal_cue(text: Column, is_first: Column, lang: Lang = None) -> Column:
    """struct(relation, cue, evidence) to the event before."""
    row = lambda relation, c, evidence: F.struct(F.lit(relation).alias("relation"), c.alias("cue"), F.lit(evidence).alias("evidence"))
    out = F.when(is_first, row(FIRST_EVENT[0], F.lit(""), FIRST_EVENT[2]))
    for name, relation, evidence in CUES:
        out = out.when(has(text, name, lang), row(relation, first(text, name, lang), evidence))
    return out.otherwise(row(NO_CUE[0], F.lit(""), NO_CUE[2]))


def segment_type(text: Column, lang: Lang = None) -> Column:
    out = F.when(has(text, "remember", lang), "REM")
    for name, kind in (("supposition", "SUP"), ("general", "GEN"), ("fiction", "FIC")):
        out = out.when(has(text, name, lang), kind)
    return out.otherwise("NAR")


def perspective(kind: Column, text: Column, names: Column, lang: Lang = None) -> Column:
    def make(k: str) -> Column:
        found = F.regexp_extract(text, L.viewpoint(k).java, 1)
        stop = L.RO_STOPWORDS if k == "ro" else L.EN_STOPWORDS
        return F.when((found != "") & ~found.isin(stop), found).otherwise("narator" if k == "ro" else "narrator")

    return F.when((kind == "REM") & (F.size(names) > 0), F.get(names, 0)).otherwise(by_language(lang, make))


def event_class(text: Column, act: Column, lang: Lang = None) -> Column:
    out = F.when(has(text, "perception", lang), "PERCEPTION").when(has(text, "reporting", lang), "REPORTING").when(has(text, "intention", lang), "I_ACTION")
    out = out.when(has(text, "remember", lang) | has(text, "cognition", lang), "I_STATE")
    return out.when(has(F.when(act != "", act).otherwise(text), "state", lang), "STATE").otherwise("OCCURRENCE")


def tense(cat: Column) -> Column:
    return F.when(cat.isin("Past", "Present", "Future"), F.upper(cat)).otherwise("NONE")


def aspect(text: Column, lang: Lang = None) -> Column:
    return F.when(has(text, "perfective", lang), "PERFECTIVE").when(has(text, "progressive", lang), "PROGRESSIVE").otherwise("NONE")


def polarity(text: Column, lang: Lang = None) -> Column:
    return F.when(has(text, "negative", lang), "NEG").otherwise("POS")


def timex_type(text: Column, lang: Lang = None) -> Column:
    return F.when(has(text, "duration", lang), "DURATION").when(has(text, "clock", lang), "TIME").when(has(text, "recurring", lang), "SET").otherwise("DATE")


def timex_value(text: Column, cat: Column) -> Column:
    """A year, or a reference; the parts are tried in either language and inside words too."""
    plain = F.lower(trim(text))
    year = F.regexp_extract(plain, r"(?U)\b\d{4}\b", 0)
    out = F.when(year != "", year)
    for value, parts in L.TIMEX_VALUES:
        held = F.lit(False)
        for p in parts:
            held = held | plain.contains(p)
        out = out.when(held, value)
    return out.when(cat == "Past", "PAST_REF").when(cat == "Future", "FUTURE_REF").otherwise("PRESENT_REF")


def index_ci(text: Column, part: Column) -> Column:
    """Place of part in text whatever the case, from 0; -1 if there is none."""
    return F.instr(F.lower(text), F.lower(part)) - 1


def label(text: Column, limit: int = 44) -> Column:
    """White space collapsed, and cut to limit - 1 characters and dots if longer than limit."""
    plain = trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(plain) <= limit, plain).otherwise(F.concat(F.regexp_replace(F.substring(plain, 1, limit - 1), r"(?U)\s+$", ""), F.lit("...")))


def escape(text: Column) -> Column:
    """As HTML: the five special characters by entity, and U+00A0 to U+00FF by number."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    numbered = F.array_join(F.transform(F.split(out, ""), lambda c: F.when(F.ascii(c).between(160, 255), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")
    return F.when(out.rlike("[\u00a0-\u00ff]"), numbered).otherwise(out)


def document_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def language(name: Column) -> Column:
    """en or ro; anything unknown, and null, is en."""
    return F.when(F.lower(trim(name)).isin(L.ALIASES["ro"]), "ro").otherwise("en")


def language_strict(name: Column) -> Column:
    """en or ro, or null for a name that is neither."""
    plain = F.lower(trim(name))
    return F.when(plain.isin(L.ALIASES["en"]), "en").when(plain.isin(L.ALIASES["ro"]), "ro")
