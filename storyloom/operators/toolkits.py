"""Optional language toolkits behind one function: text to the eleven counters of :mod:`storyloom.operators.comparison`, and examples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from storyloom.functions import lexicon as L

PEOPLE, PLACES, TIMES = {"PERSON", "PER"}, {"GPE", "LOC", "LOCATION", "FAC"}, {"DATE", "TIME", "DURATION", "SET"}
EXAMPLES = 8


@dataclass
class Sentence:
    """What a toolkit says of a sentence: its verbs' lemmas, and its entities (text, label)."""

    text: str
    verbs: list[str]
    entities: list[tuple[str, str]]


def _pattern(p: L.Pattern) -> re.Pattern:
    return re.compile(p.body, re.IGNORECASE if p.ignore_case else 0)


def _unique(items: Iterable[str]) -> list[str]:
    """Distinct whatever their case, with white space collapsed; the first spelling stays."""
    out: dict[str, str] = {}
    for x in items:
        plain = " ".join(x.split())
        if plain:
            out.setdefault(plain.lower(), plain)
    return list(out.values())


def category(text: str) -> str:
    found = (k for k in ("future", "past") if _pattern(L.cue(k, "compared")).search(text))
    return next(found, "present").capitalize()


def relation(text: str) -> str:
    for name, said in (("simultaneous", "SIMULTANEOUS"), ("before", "BEFORE"), ("after", "AFTER")):
        if _pattern(L.cue(name, "compared")).search(text):
            return said
    return "IMMEDIATELY_BEFORE"


def event(s: Sentence, is_first: bool) -> dict:
    """An event of a sentence; places and times by pattern where the toolkit finds none."""
    of = lambda kinds: _unique(t for t, label in s.entities if label in kinds)
    return {
        "text": s.text.strip(), "action": s.verbs[0], "actors": of(PEOPLE), "locations": of(PLACES) or _unique(m.group(1) for m in _pattern(L.place()).finditer(s.text)),
        "temporal_anchors": of(TIMES) or _unique(m.group(0) for m in _pattern(L.cue("anchor", "compared")).finditer(s.text)), "temporal_category": category(s.text),
        "relation_to_previous": None if is_first else relation(s.text),
    }


def tally(sentences: list[Sentence], tokens: int, labels: list[str]) -> tuple[list[int], dict]:
    """The counters, in the order of ``COUNTS``, and the first events and segments."""
    events: list[dict] = []
    for s in sentences:
        if s.verbs:
            events.append(event(s, not events))
    groups: list[list[dict]] = []
    keys: list[tuple] = []
    for e in events:
        key = (frozenset(a.lower() for a in e["actors"]), e["temporal_category"])
        if not keys or keys[-1] != key:
            groups.append([])
            keys.append(key)
        groups[-1].append(e)
    of = lambda kinds: sum(x in kinds for x in labels)
    counts = [len(sentences), tokens, len(labels), of(PEOPLE), of(PLACES), of(TIMES), sum(len(e["temporal_anchors"]) for e in events), len(events), max(0, len(events) - 1), len(groups), len(set(keys))]
    return counts, {"events": events[:EXAMPLES], "segments": [[e["text"] for e in g] for g in groups[:EXAMPLES]]}


def load(toolkit: str) -> Callable[[str], tuple[list[int], dict]]:
    """Raises what the toolkit raises if it or its model isn't installed."""
    if toolkit == "spacy":
        import spacy

        nlp = spacy.load("en_core_web_sm")

        def run(text: str) -> tuple[list[int], dict]:
            doc = nlp(text)
            rows = [Sentence(s.text, [t.lemma_ for t in s if t.pos_ in ("VERB", "AUX")], [(e.text, e.label_) for e in s.ents]) for s in doc.sents]
            return tally(rows, len(doc), [e.label_ for e in doc.ents])

        return run
    import stanza

    nlp = stanza.Pipeline("en", processors="tokenize,pos,lemma,depparse,ner", download_method=None, verbose=False)

    def run(text: str) -> tuple[list[int], dict]:
        doc = nlp(text)
        rows = [Sentence(s.text, [w.lemma for w in s.words if w.upos in ("VERB", "AUX")], [(e.text, e.type) for e in doc.ents if e.text in s.text]) for s in doc.sentences]
        return tally(rows, sum(len(s.words) for s in doc.sentences), [e.type for e in doc.ents])

    return run
