"""Removal of repeated phrases by Aho-Corasick automata (operator 13).

A window is ``LENGTH`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. A word is removed when a window covers it whose sequence
of words also starts in a document of smaller doc_id. Windows are judged on the input, not on what is left.

Method.
1. Each window is named by the smallest digest of the ``GRAM``-word sequences in it, its anchor, so equal windows have equal anchors
   wherever they lie. Consecutive windows of one anchor form a context, about 18 windows. One scan of all texts emits the anchor, a
   digest and the place of each. Of contexts equal as a whole, those outside the first document that has them are removed; each task
   settles what it meets itself, and a window function over (anchor, digest) the rest.
2. Anchors with different contexts in different documents may name recurring phrases. Their contexts are cut out of the texts and dealt
   by anchor, so each piece of a document goes to the one shard where the phrases it may hold are known.
3. In a shard, windows whose digests come from two documents are confirmed as recurring phrases and compiled into automata of at most
   ``PHRASES`` phrases each, over the shard's words as letters. All pieces of the shard are streamed through them, which finds every
   occurrence, word by word. The smallest document with an occurrence keeps it.
4. An anchor of more than ``SPLIT`` contexts is split over several shards; windows that are first in their shard are settled among the
   shards by a window function over their digests.
5. Removed spans are gathered by document. Only texts that a bitmap of fixed size marks are dealt, here and in step 2.

Counts by anchor are partial sums before they are shuffled, and the join of contexts with them is one that Spark splits where it is skewed.
Contexts and windows of split anchors are compared by 128 bits of digests, phrases word by word.

Cases: null, empty and white texts have no words; texts of less than LENGTH words lose none; repeats within one document stay; rows of
equal doc_id and text are one document and lose the same; different texts with one doc_id, or with a null one, which is the largest, are
documents of their own, in the order of their digests; very long texts are read whole; texts of one repeated word are contexts of at
most ``LONGEST`` windows; an empty table gives no rows; further columns are not read, so names may clash; doc_id is a whole number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import lean, marks, settle, split_by_marks
from storyloom.llm.jaccard import U, mix
from storyloom.llm.suffix_dedup import numbered, sliding, unite
from storyloom.llm.tokens import joined, word_bounds, words_of

LENGTH, GRAM, LONGEST = 50, 16, 64
#: Words of a shard, contexts of an anchor in one shard, phrases of an automaton, contexts that a scanning task holds: tens of MB each.
SHARD, SPLIT, PHRASES, HELD = 1 << 16, 512, 1 << 13, 250_000
_BASE = 0x5851F42D4C957F2D
_SECOND = U(0x9E3779B97F4A7C15)
#: Letters of automata: from here on there are no surrogates.
_LETTER = 0xE000


class _Rolling:
    """Digests of all stretches of a sequence of numbers, from running sums modulo 2 ** 64."""

    up = down = np.ones(1, U)

    def __init__(self, x: np.ndarray):
        n = len(x) + 1
        if len(_Rolling.up) < n:
            _Rolling.up, _Rolling.down = (np.cumprod(np.concatenate([[U(1)], np.full(n, U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        self.sums = np.concatenate([[U(0)], np.cumsum(x * _Rolling.up[: len(x)])])

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * _Rolling.down[start])


def digests_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words of the array, and a digest that is the same everywhere."""
    named = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in named.dictionary.cast(pa.large_binary()).to_pylist()), U, len(named.dictionary))
    ids = named.indices.to_numpy()
    return ids, known[ids]


def _windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of the texts its text, and the place of its first word among all words."""
    n = np.maximum(counts - LENGTH + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.repeat(np.cumsum(counts) - counts - np.cumsum(n) + n, n) + np.arange(n.sum())


def contexts(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place of the first window among all words, number of windows, anchor and digest of each context."""
    of, at = _windows(counts)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(U), none.view(U)
    grams = _Rolling(h).of(np.arange(len(h) - GRAM + 1), GRAM)
    anchor = sliding(grams, LENGTH - GRAM + 1, True)[at]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (anchor[1:] != anchor[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * LONGEST
        size = np.minimum(np.repeat(size, pieces) - nth * LONGEST, LONGEST)
    place = at[first]
    digest = _Rolling(grams).of(place, size + LENGTH - GRAM)
    return of[first], place, size, anchor[first], mix(digest ^ size.astype(U) * _SECOND)


SEEN = "key long, ctx long, doc long, pos long, size int"


def _seen(*columns: np.ndarray) -> pa.RecordBatch:
    *longs, size = columns
    return pa.RecordBatch.from_arrays([*(pa.array(x) for x in longs), pa.array(size.astype(np.int32))], ["key", "ctx", "doc", "pos", "size"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of texts (doc, text); a size of 0 marks a removed span of doc, from pos to ctx."""
    held: list[list[np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        key, ctx, doc, pos, size = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        by = np.lexsort((doc, ctx, key))
        key, ctx, doc, pos, size = (x[by] for x in (key, ctx, doc, pos, size))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
        later = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        d, a, b = unite(doc[later], pos[later], (pos + size + LENGTH - 1)[later])
        kept = ~later
        parts = (key[kept].view(np.int64), mix(d.view(U)).view(np.int64)), (ctx[kept].view(np.int64), b), (doc[kept], d), (pos[kept], a), (size[kept], 0 * d)
        return _seen(*(np.concatenate(x) for x in parts))

    for batch in batches:
        words, counts = words_of(batch.column(1))
        if not len(words):
            continue
        of, place, size, anchor, ctx = contexts(digests_of(words)[1], counts)
        begins = np.cumsum(counts) - counts
        held.append([anchor, ctx, batch.column(0).to_numpy()[of], place - begins[of], size])
        count += len(place)
        if count >= HELD:
            yield flush()
            count = 0
    if held:
        yield flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of contexts, as they stand in their texts (doc, text, asked)."""
    for batch in batches:
        raw, first, size, counts = word_bounds(batch.column(1))
        asked = batch.column(2)
        of = np.repeat(np.arange(len(asked)), asked.value_lengths().to_numpy())
        pos, many, key, salt = (asked.flatten().field(c).to_numpy() for c in ("pos", "size", "key", "salt"))
        at = (np.cumsum(counts) - counts)[of] + pos
        start = first[at]
        n = first[at + many + LENGTH - 2] + size[at + many + LENGTH - 2] - start
        step = 1 << 14  # contexts, about 8 MB of pieces
        for a in range(0, len(n), step):
            s, m = start[a : a + step], n[a : a + step]
            offsets = np.concatenate([[0], np.cumsum(m)]).astype(np.int32)
            letters = raw[np.repeat(s - offsets[:-1], m) + np.arange(offsets[-1])]
            pieces = pa.StringArray.from_buffers(len(m), pa.py_buffer(offsets), pa.py_buffer(letters))
            mine = slice(a, a + step)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[mine]), pa.array(salt[mine]), pa.array(batch.column(0).to_numpy()[of[mine]]), pa.array(pos[mine]), pieces],
                ["key", "salt", "doc", "pos", "piece"],
            )


def occurrences(letters: np.ndarray, counts: np.ndarray, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows at these places occur in all pieces: places of first words, and which phrase it is."""
    gap = np.arange(len(counts))  # pieces are parted by a letter that is no word
    text = np.full(len(letters) + len(counts), 1, np.uint32)
    text[np.arange(len(letters)) + np.repeat(gap, counts)] = letters + _LETTER
    place = np.full(len(text), -1)
    place[np.arange(len(letters)) + np.repeat(gap, counts)] = np.arange(len(letters))
    stream = text.tobytes().decode("utf-32-le")
    spell = lambda at: (letters[at : at + LENGTH] + _LETTER).astype(np.uint32).tobytes().decode("utf-32-le")
    found = []
    for at in range(0, len(phrases), PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, p in enumerate(phrases[at : at + PHRASES].tolist()):
            automaton.add_word(spell(p), at + k)
        automaton.make_automaton()
        found.append(np.fromiter(chain.from_iterable(automaton.iter(stream)), np.int64).reshape(-1, 2))
    ends, which = np.concatenate(found).T if found else np.zeros((2, 0), np.int64)
    return place[ends] - LENGTH + 1, which


FOUND = "split boolean, doc long, a long, b long, more long"


def _shard(salt: np.ndarray, doc: np.ndarray, pos: np.ndarray, words: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spans to remove from pieces of a shard, and of split anchors the windows that are first in it: place a, digest (b, more)."""
    letters, h = digests_of(words)
    of, at = _windows(counts)
    digest = _Rolling(h).of(at, LENGTH)
    by = np.argsort(digest, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], digest[by][1:] != digest[by][:-1]]))
    docs = doc[of[by]]
    recurring = np.minimum.reduceat(docs, heads) < np.maximum.reduceat(docs, heads)
    place, which = occurrences(letters.astype(np.int64), counts, at[by[heads[recurring]]])
    window = np.searchsorted(at, place)
    first = np.full(int(recurring.sum()), np.iinfo(np.int64).max)
    np.minimum.at(first, which, doc[of[window]])
    later = np.zeros(len(at), bool)
    later[window] = doc[of[window]] > first[which]
    start = at - (np.cumsum(counts) - counts)[of] + pos[of]
    d, a, b = unite(doc[of[later]], start[later], start[later] + LENGTH)
    open_ = ~later & (salt[of] >= 0)
    more = _Rolling(mix(h ^ _SECOND)).of(at[open_], LENGTH)
    columns = (
        np.concatenate([np.zeros(len(d), bool), np.ones(len(more), bool)]),
        np.concatenate([d, doc[of[open_]]]),
        np.concatenate([a, start[open_]]),
        np.concatenate([b, digest[open_].view(np.int64)]),
        np.concatenate([0 * d, more.view(np.int64)]),
    )
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["split", "doc", "a", "b", "more"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Works on pieces sorted by anchor and salt, in shards of whole groups of about SHARD words."""
    held = None

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, salt, doc, pos = (rows.column(c).to_numpy() for c in ("key", "salt", "doc", "pos"))
        words, counts = words_of(rows.column("piece").combine_chunks())
        bounds = np.concatenate([[0], np.cumsum(counts)])
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])]))
        ends = np.append(heads[1:], len(key))
        at = 0
        for end in ends.tolist():
            if bounds[end] - bounds[at] >= SHARD or end == len(key):
                part = slice(at, end)
                yield from _shard(salt[part], doc[part], pos[part], words.slice(bounds[at], bounds[end] - bounds[at]), counts[part])
                at = end

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        key, salt = held.column("key").to_numpy(), held.column("salt").to_numpy()
        last = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
        if len(last):  # the last group may go on in the next batch
            yield from work(held.slice(0, last[-1] + 1))
            held = held.slice(last[-1] + 1)
    if held is not None:
        yield from work(held)


def removed(texts: DataFrame) -> DataFrame:
    """Spans (doc, a, b) of words to remove from texts (doc, text), in which rows of equal doc have one text; they may overlap."""
    texts = texts.select("doc", "text")
    seen = texts.mapInArrow(lean(_scan), SEEN)
    rows = settle(seen.withColumn("first", F.min("doc").over(Window.partitionBy("key", "ctx"))))
    local = rows.where("size = 0").select("doc", F.col("pos").alias("a"), F.col("ctx").alias("b"))
    copies = rows.where("size > 0 AND doc > first").select("doc", F.col("pos").alias("a"), (F.col("pos") + F.col("size") + LENGTH - 1).alias("b"))
    kept = rows.where("size > 0 AND doc = first").select("key", "ctx", "doc", "pos", "size")
    anchors = (
        kept.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("ctx").alias("low"), F.max("ctx").alias("high"), F.min("doc").alias("least"), F.max("doc").alias("most"))
        .where("low < high AND least < most")
        .select("key", "n")
    )
    shards = F.ceil(F.col("n") / SPLIT)
    salt = F.when(shards > 1, F.pmod(F.xxhash64("ctx", "pos"), shards)).otherwise(F.lit(-1).cast("long"))
    asked = settle(kept.join(anchors.hint("merge"), "key").select("doc", "pos", F.col("size").cast("long").alias("size"), "key", salt.alias("salt")))
    some, _ = split_by_marks(texts, "doc", marks(asked, "doc"))  # other texts aren't dealt
    lists = asked.groupBy("doc").agg(F.collect_list(F.struct("pos", "size", "key", "salt")).alias("asked"))
    pieces = some.join(lists.hint("shuffle_hash"), "doc").select("doc", "text", "asked")
    pieces = pieces.mapInArrow(lean(_cut), "key long, salt long, doc long, pos long, piece string")
    found = settle(pieces.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lean(_match), FOUND))
    split = found.where("split").withColumn("first", F.min("doc").over(Window.partitionBy("b", "more")))
    again = split.where("doc > first").select("doc", "a", (F.col("a") + LENGTH).alias("b"))
    return local.unionByName(copies).unionByName(found.where("NOT split").select("doc", "a", "b")).unionByName(again)


def _apply(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = words_of(batch.column(1))
            spans = batch.column(2)
            of = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
            begins = np.cumsum(counts) - counts
            steps = np.zeros(len(words) + 1, np.int64)
            for name, sign in (("a", 1), ("b", -1)):
                np.add.at(steps, begins[of] + spans.flatten().field(name).to_numpy(), sign)
            keep = np.cumsum(steps)[:-1] == 0
            left = joined(words, keep, counts)
            lost = np.bincount(np.repeat(np.arange(len(counts)), counts)[~keep], minlength=len(counts))
            sha = pa.array([hashlib.sha256(t).hexdigest() for t in left.cast(pa.binary()).to_pylist()], pa.string())
            columns = [batch.column(0), pa.array(counts), pa.array(lost), sha, *([left] if keep_text else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if keep_text else [])])

    return run


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs, and the text that is left: its words, joined by one space."""
    texts = numbered(docs)
    found = removed(texts)
    some, whole = split_by_marks(texts, "doc", marks(found, "doc"))
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text
    no_spans = F.lit(None).cast("array<struct<a:long,b:long>>").alias("spans")
    apply = lambda df: df.mapInArrow(lean(_apply(keep_text)), schema)
    return apply(some.join(spans.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "spans")).unionByName(apply(whole.select("doc_id", "text", no_spans)))
