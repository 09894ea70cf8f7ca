"""Periodic runs of words by Crochemore's partition refinement (operator 12).

A run is a stretch of consecutive words of one document with smallest period q (words q apart are identical) and at least
``max(LEAST, POWER * q)`` words, which no neighbouring word extends keeping period q.

Method. Positions of a document are in one class of length 1 if their words are equal, and in one class of length h + 1 if they are in one
of length h and the positions after them are, too. Classes are refined length by length: only the positions before the members of
newly made classes can leave their class, and of the parts of a class that fell apart all but the largest are looked at, so every
position is looked at about log n times (the smaller-half strategy). Each class keeps its members linked in the order of the text.
Neighbours in a class of length h at distance h are the places of a square with a primitive root of h words; it is enough to test
the pair once, when it is torn apart or at the end, for the lengths at which it was a pair. Places of squares that follow each other are merged
into a run. All documents of a slice, about ``SLICE`` words, are refined in step with numpy, each with an end mark of its own.

Squares of a run of four periods or more lie in classes of at least three members, so smaller classes are not refined further, nor is a
document beyond a quarter of its words, or once its classes are periodic stretches, of which nothing new can come.

Cases: null and empty texts, and texts of white space only, have no words and no runs; texts of less than LEAST words have no runs; a
very long text is a slice of its own, with memory in proportion to it; repeated rows have the same runs; a null doc_id is kept; an
empty table gives no rows; further columns are not read, so their names may clash; doc_id may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import lean, light, text_of
from storyloom.llm.tokens import joined, words_of

LEAST, POWER = 6, 4
SLICE = 1 << 18


class _Classes:
    """The classes of one length, over the positions of some documents: each document's words and an end mark."""

    def __init__(self, key: np.ndarray, end: np.ndarray, most: np.ndarray):
        """key: equal for equal words of one document; end: the end marks; most: the length up to which each position's document is refined."""
        self.most, n = most, len(key)
        self.first = np.concatenate([[True], end[:-1]])
        self.text = np.cumsum(self.first) - 1
        self.order = np.argsort(key, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.arange(n)
        sorted_key = key[self.order]
        new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        heads = np.flatnonzero(new)
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.cumsum(new) - 1
        self.number, room = len(heads), 2 * n + 2
        self.begin, self.size = np.zeros(room, np.int64), np.zeros(room, np.int64)
        self.ended = np.ones(room, np.int64)  # the length at which a class got less than three members
        self.begin[: len(heads)] = heads
        self.size[: len(heads)] = np.diff(np.append(heads, n))
        same = ~new[1:]
        self.next, self.last = np.full(n, -1), np.full(n, -1)
        self.next[self.order[:-1][same]] = self.order[1:][same]
        self.last[self.order[1:][same]] = self.order[:-1][same]
        self.since = np.ones(n, np.int64)
        self.marked = np.zeros(n, bool)
        self.length, self.fresh = 1, np.arange(n)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _torn(self, x: np.ndarray, until: np.ndarray | int) -> None:
        """x and its next member were a pair up to this length."""
        gap = self.next[x] - x
        found = (self.since[x] <= gap) & (gap <= until)
        if found.any():
            self.squares.append((x[found], gap[found]))

    def refine(self) -> bool:
        """Goes on to the next length; False if nothing can change any more."""
        x = np.sort(self.fresh[~self.first[self.fresh]]) - 1
        x = x[(self.size[self.of[x]] > 2) & (self.most[x] > self.length)]
        if not len(x):
            return False
        pair = self.of[x] * len(self.size) + self.of[x + 1]
        by = np.argsort(pair, kind="stable")
        x, pair = x[by], pair[by]
        cls = self.of[x]
        part_new = np.concatenate([[True], pair[1:] != pair[:-1]])
        whole = np.diff(np.append(np.flatnonzero(part_new), len(x))) == self.size[cls[part_new]]
        keep = ~whole[np.cumsum(part_new) - 1]  # parts that are all of their class change nothing
        x, cls, part_new = x[keep], cls[keep], part_new[keep]
        self.length += 1
        if not len(x):
            self.fresh = x
            return True
        part = np.flatnonzero(part_new)
        part_size = np.diff(np.append(part, len(x)))
        part_cls = cls[part]
        head = np.flatnonzero(np.concatenate([[True], part_cls[1:] != part_cls[:-1]]))  # first part of each class
        left = part_cls[head]
        taken = np.add.reduceat(part_size, head)
        self._move(x, cls, np.repeat(part[head], taken), np.repeat(taken, taken))
        self._link(x, cls, part_new)
        rest = self.size[left] - taken
        start = self.begin[left]
        most = np.maximum.reduceat(part_size, head)
        by_rest = rest >= most  # the rest keeps the class's number, else the largest part does
        parts = np.diff(np.append(head, len(part)))
        largest = np.flatnonzero(part_size == np.repeat(most, parts))
        largest = largest[np.searchsorted(largest, head)]
        numbers = self.number + np.arange(len(part))
        numbers[largest[~by_rest]] = left[~by_rest]
        self.begin[numbers] = np.repeat(start - part[head], parts) + part
        self.size[numbers] = part_size
        self.of[x] = np.repeat(numbers, part_size)
        small = np.repeat(numbers >= self.number, part_size)
        # Numbers of the kept ones stay unused.
        self.number += len(part)
        self.begin[left[by_rest]] += taken[by_rest]
        self.size[left[by_rest]] = rest[by_rest]
        other = np.flatnonzero(~by_rest & (rest > 0))
        mine = self.number + np.arange(len(other))
        self.number += len(other)
        self.begin[mine], self.size[mine] = (start + taken)[other], rest[other]
        n = rest[other]
        places = np.repeat((start + taken)[other] - np.cumsum(n) + n, n) + np.arange(n.sum())
        moved = self.order[places]
        self.of[moved] = np.repeat(mine, n)
        self.fresh = np.concatenate([x[small], moved])
        changed = np.concatenate([numbers, left, mine])
        self.ended[changed] = self.length
        return True

    def _move(self, x: np.ndarray, cls: np.ndarray, head: np.ndarray, taken: np.ndarray) -> None:
        """Puts x at the front of its classes' places in the order."""
        start = self.begin[cls]
        places = start + np.arange(len(x)) - head
        self.marked[x] = True
        there = self.order[places]
        out = there[~self.marked[there]]
        to = self.at[x]
        to = to[to >= start + taken]
        self.order[to], self.at[out] = out, to
        self.order[places], self.at[x] = x, places
        self.marked[x] = False

    def _link(self, x: np.ndarray, cls: np.ndarray, part_new: np.ndarray) -> None:
        """Takes x out of the links of its classes, and links it part by part."""
        until = self.length - 1
        y = x[np.lexsort((x, cls))]
        joined_ = self.next[y[:-1]] == y[1:]
        heads, tails = y[np.concatenate([[True], ~joined_])], y[np.concatenate([~joined_, [True]])]
        before, after = self.last[heads], self.next[tails]
        kept = before >= 0
        self._torn(before[kept], until)
        follow = np.append(np.where(part_new[1:], -1, x[1:]), -1)
        lead = np.concatenate([[-1], np.where(part_new[1:], -1, x[:-1])])
        other = self.next[x] != follow
        self._torn(x[other & (self.next[x] >= 0)], until)
        self.since[x[other]] = self.length
        self.next[x], self.last[x] = follow, lead
        self.next[before[kept]] = after[kept]
        self.since[before[kept]] = self.length
        self.last[after[after >= 0]] = before[after >= 0]

    def _settle(self) -> None:
        """Ends the refinement of documents in which no neighbours are more than half a length apart.

        Such neighbours overlap by half, so a class is one periodic stretch, and only its last member can leave it: no pair with a gap of
        a later length can come up.
        """
        x = np.flatnonzero((self.next >= 0) & (self.most > self.length))
        wide = x[(self.size[self.of[x]] > 2) & (2 * (self.next[x] - x) > self.length)]
        open_ = np.zeros(int(self.text[-1]) + 1, bool)
        open_[self.text[wide]] = True
        self.most = np.where(open_[self.text], self.most, np.minimum(self.most, self.length))

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of squares, and the sizes of their roots."""
        check = 2
        while self.refine():
            if self.length >= check:
                self._settle()
                check += max(1, check // 4)
        x = np.flatnonzero(self.next >= 0)
        of = self.of[x]
        self._torn(x, np.where(self.size[of] > 2, self.most[x], self.ended[of]))
        return tuple(np.concatenate([s[k] for s in self.squares] or [np.zeros(0, np.int64)]) for k in (0, 1))


def find_runs(ids: np.ndarray, counts: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, ...]:
    """Runs of texts whose words have these ids, counts words each: text, start in it, length and period, by text, start and period."""
    taken = counts >= max(least, power)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not taken.any():
        return none
    texts = np.flatnonzero(taken)
    n = counts[texts]
    begins = (np.cumsum(counts) - counts)[texts]
    ends = np.cumsum(n + 1)  # with an end mark each
    starts = ends - n - 1
    of = np.repeat(np.arange(len(n)), n + 1)
    end = np.zeros(int(ends[-1]), bool)
    end[ends - 1] = True
    word = np.arange(len(end)) - starts[of] + begins[of]
    key = of * (int(ids.max()) + 2) + np.where(end, 0, ids[np.minimum(word, len(ids) - 1)] + 1)
    place, period = _Classes(key, end, (n // power)[of]).all_squares()
    if not len(place):
        return none
    by = np.lexsort((place, period))
    place, period = place[by], period[by]
    new = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1)]))
    start, period = place[new], period[new]
    length = place[np.append(new[1:], len(place)) - 1] - start + 2 * period
    real = length >= np.maximum(least, power * period)
    start, length, period = start[real], length[real], period[real]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    return texts[of[start]], start - starts[of[start]], length, period


def kept_words(counts: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    begins = np.cumsum(counts) - counts
    steps = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(steps, begins[text] + start + period, 1)
    np.add.at(steps, begins[text] + start + length, -1)
    return np.cumsum(steps)[:-1] == 0


def _slices(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Texts in slices of about SLICE words."""
    at, held = 0, 0
    for k, n in enumerate(counts.tolist()):
        if held and held + n > SLICE:
            yield at, k
            at, held = k, 0
        held += n
    if at < len(counts):
        yield at, len(counts)


def _search(least: int, power: int):
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            words, counts = words_of(texts)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            for a, b in _slices(counts):
                mine, n = words.slice(bounds[a], bounds[b] - bounds[a]), counts[a:b]
                ids = mine.dictionary_encode().indices.to_numpy().astype(np.int64)
                text, start, length, period = find_runs(ids, n, least, power)
                offsets = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                left = joined(mine, kept_words(n, text, start, length, period), n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.ListArray.from_arrays(offsets, rows).cast(kind), left],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


def find(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs and collapsed of each row of docs (doc_id, text).

    runs: array of (start, length, period) by start, then period. collapsed: the words that no run contains after its first period,
    joined by one space. There is no shuffle: each text is searched where it lies.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return light(docs).select("doc_id", text_of().alias("text")).mapInArrow(lean(_search(least, power)), schema)


def with_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as the query reads them: a tenth of the texts gets a periodic end, set by the checksum of doc_id.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words: where h is divisible by 10 and n > 0, each word i >= a becomes the
    word a + (i - a) % p, with a = g % n and p = 1 + (n - a) div (3 + g % 8). A null doc_id has no checksum; its text stays.
    """
    rows = docs.select("doc_id", text_of().alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_words", F.when(F.col("_h") % 10 == 0, words))
    n = F.size("_words")
    rows = rows.withColumn("_n", n)
    g = F.expr("_h div 10")
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, (g % F.col("_n")).cast("int")))
    rows = rows.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + (_h div 10) % 8) as int)"))
    source = lambda i: F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i)
    made = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.col("_words")[source(i)])
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and digests of all runs and of the collapsed text, from :func:`find`."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # The greatest length, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.select("doc_id", "runs", "collapsed", longest.alias("best"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
