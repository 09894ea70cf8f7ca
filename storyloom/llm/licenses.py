"""License scan by an exact set-similarity join with templates (operator 5).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case; null counts as empty. Base labels
come from phrases whose words stand consecutively. The method adds a label for each template of which a text block
holds at least ``CONTAINMENT`` of the distinct words; blocks are the lines of a text, every two neighbouring lines together, and every
window of as many words as the template has over ``CONTAINMENT``, across any line ends. A text is first taken as one block: only for templates
that it holds do windows slide. Overlapping windows are one block, the fullest, and the shortest of these; those within two lines are left to the lines.
The SQL knows lines and pairs only: it has the same rows where no license text is wrapped over more lines.

The join is exact: template words are ordered by how many documents of the corpus hold them, rarest first, from one
pass over all texts that counts only template words. A block that meets the threshold for a template of n words lacks
at most ``n - ceil(CONTAINMENT * n)`` of them, so it holds a word of the template's prefix (that many rarest words, and one
more). Words of prefixes point to their templates; of the templates met, those longer than the block allows go by the
length filter; those of which, or of the block, too few words are left from the first one in common on go by the positional filter; what is
left is counted. Templates are a library of fixed size, so nothing else is broadcast and nothing is shuffled but the counts.

Cases: null and empty texts have no words, no labels and score 0; repeated rows get a row each; very long texts are
read whole; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import lean, light, text_of

CONTAINMENT = 0.8

#: Fixed by the contract: phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed by the licenses: label and words of a statement, grant or disclaimer.
TEMPLATES: dict[str, str] = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "apache-notice": "licensed under the apache license version 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "no-warranty": "the software is provided as is without warranty of any kind express or implied",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "all-rights": "all rights reserved no part of this publication may be reproduced or transmitted in any form",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "bsd-disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
}

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: The same but for \n, which stays.
_LINES = bytes(10 if b == 10 else _LOWER[b] for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def need(n: int, containment: float = CONTAINMENT) -> int:
    """Words of a template of n that a block must hold."""
    return max(1, math.ceil(containment * n - 1e-9))


class Templates:
    """Templates with their words in a global order, rarest first, and the index of their prefixes."""

    def __init__(self, templates: Mapping[str, str], counts: Mapping[str, int], containment: float = CONTAINMENT) -> None:
        rank = lambda w: (counts.get(w.decode(), 0), w)
        self.labels = sorted(templates)
        self.words = [sorted(set(words_of(templates[k])), key=rank) for k in self.labels]
        self.need = [need(len(w), containment) for w in self.words]
        self.index: dict[bytes, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            for at, word in enumerate(w[: len(w) - self.need[t] + 1]):
                self.index.setdefault(word, []).append((t, at))
        self.prefixes = frozenset(self.index)
        self.rank = {w: k for k, w in enumerate(sorted({w for words in self.words for w in words}, key=rank))}
        self.sets = [frozenset(w) for w in self.words]
        self.at = {k: t for t, k in enumerate(self.labels)}
        self.window = [int(len(words_of(templates[k])) / containment + 1e-9) for k in self.labels]

    def match(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        """Labels of the templates that the block holds, with the containment."""
        for t in self.candidates(block):
            held = len(self.sets[t] & block)
            if held >= self.need[t]:
                yield self.labels[t], held / len(self.words[t])

    def candidates(self, block: set[bytes]) -> Iterator[int]:
        """Templates that pass the prefix, length and positional filters; words that no template has aren't looked at."""
        words = sorted(block & self.rank.keys(), key=self.rank.__getitem__)
        met: set[int] = set()
        for place, word in enumerate(words):
            for t, at in self.index.get(word, ()):
                if t not in met:
                    met.add(t)
                    # The first word in common is at these places of both, so no more words than come from there on can be.
                    if len(words) >= self.need[t] and min(len(self.words[t]) - at, len(words) - place) >= self.need[t]:
                        yield t

    def slide(self, label: str, words: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """First and last word, and containment, of the windows of a text that hold the template; of those that overlap, the best."""
        t = self.at[label]
        known, size = self.sets[t], self.window[t]
        places = [i for i, w in enumerate(words) if w in known]
        held: Counter[bytes] = Counter()
        found: list[tuple[int, int, int]] = []
        first = 0
        for i in places:
            held[words[i]] += 1
            while (j := places[first]) <= i - size or held[words[j]] > 1:  # a word that comes again isn't needed at the start
                held[words[j]] -= 1
                if not held[words[j]]:
                    del held[words[j]]
                first += 1
            if len(held) >= self.need[t]:
                found.append((-len(held), i - j, j))
        kept: list[tuple[int, int, float]] = []
        for n, wide, j in sorted(found):
            at = bisect.bisect_left(kept, (j,))
            if (at == 0 or kept[at - 1][1] < j) and (at == len(kept) or kept[at][0] > j + wide):
                kept.insert(at, (j, j + wide, -n / len(known)))
        yield from kept


def _counter(words: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n.update(words.intersection(words_of(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in n], pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    return count


def document_counts(docs: DataFrame, templates: Mapping[str, str]) -> dict[str, int]:
    """How many documents hold each template word; at most one row for each of them comes to the driver."""
    words = frozenset(w for t in templates.values() for w in words_of(t))
    rows = docs.select(text_of().alias("text")).mapInArrow(lean(_counter(words)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def scan_text(text: str, templates: Templates, phrases: Mapping[bytes, str]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score and matched blocks of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_LOWER).split()
    flat = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in phrases.items():
        at, before, last = flat.find(phrase), 0, 0
        while at >= 0:
            before, last = before + flat.count(b" ", last, at), at
            starts.append(before)
            base.add(label)
            at = flat.find(phrase, at + 1)
    labels, score, blocks = set(base), 1.0 if base else 0.0, []
    held = templates.prefixes.intersection(words)
    if held:
        rows = [x.split() for x in raw.translate(_LINES).split(b"\n")]
        lines = [set(x) for x in rows]
        for k, line in enumerate(lines):
            pair = lines[k + 1] if k + 1 < len(lines) else set()
            for block, n in ((line, 1), (line | pair, 2)):
                if (n == 1 or pair) and not held.isdisjoint(block):
                    for label, part in templates.match(block):
                        labels.add(label)
                        score = max(score, part)
                        blocks.append((k, n, label, part))
        ends = list(itertools.accumulate(map(len, rows)))
        for label, _ in templates.match(set(words)):
            for i, j, part in templates.slide(label, words):
                k, last = bisect.bisect_right(ends, i), bisect.bisect_right(ends, j)
                if last - k > 1:
                    labels.add(label)
                    score = max(score, part)
                    blocks.append((k, last - k + 1, label, part))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, blocks


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """A row for each row of docs: counts and places of phrases, labels, score, and blocks: (line, lines, label, containment) of each block found."""
    known = Templates(templates, document_counts(docs, templates), containment)
    coded = {b" " + b" ".join(words_of(p)) + b" ": label for p, label in phrases.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("line", pa.int32()), ("lines", pa.int32()), ("label", pa.string()), ("containment", pa.float64())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
        for batch in batches:
            rows = [scan_text(t, known, coded) for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            blocks = [[{"line": a, "lines": b, "label": c, "containment": d} for a, b, c, d in r] for r in cols[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip([*cols[:-1], blocks], kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,lines:int,label:string,containment:double>>"
    return light(docs).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(run), schema)


def sql(containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the digest of scan(): plain counting, without the join's filters."""
    literal = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ", ".join(f"('{k}', {literal(sorted({w.decode() for w in words_of(t)}))}, {need(len(set(words_of(t))), containment)})" for k, t in TEMPLATES.items())
    phrases = ", ".join(f"('{label}', {literal(p.split())})" for p, label in PHRASES.items())
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
phrases(label, phrase) AS (VALUES {phrases}),
templates(label, tw, need) AS (VALUES {rows}),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) JOIN phrases ON words[i] = phrase[1] AND words[i:i + len(phrase) - 1] = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
l AS (SELECT doc_id, lines[k] AS line, lines[k + 1] AS below FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(lines) + 1)) AS k FROM t)),
k AS (SELECT doc_id, list_distinct(regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS held FROM (SELECT doc_id, unnest([line, line || ' ' || coalesce(below, '')]) AS x FROM l)),
h AS (SELECT doc_id, label, max(len(list_intersect(tw, held)) / len(tw)) AS part FROM k JOIN templates ON len(list_intersect(tw, held)) >= need GROUP BY ALL),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, max(part) AS part FROM h GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END, 6)::DOUBLE AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)
"""
