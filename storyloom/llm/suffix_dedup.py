"""Removal of repeated passages by suffix arrays (operator 7).

Texts are UTF-8 bytes (null: empty), and matches don't cross documents. A byte is removed when a string of ``LENGTH`` bytes covers it that
also starts earlier: in a document of smaller doc_id, or earlier in the same one. Strings are judged on the input.

Method.
1. Each window of LENGTH bytes is named by the smallest digest of the ``GRAM``-byte strings in it, its anchor: equal windows have
   equal anchors wherever they lie. Consecutive windows of one anchor form a context, about 35 windows. A scan of all
   texts emits for each context its anchor, a digest, and where it lies. Of equal contexts all but the first are removed whole;
   each task settles those it meets itself, so a context that fills a third of all rows leaves one row for each task.
2. Contexts of an anchor with several different contexts, mostly the ends of shared passages and the surroundings of edits, and those that may repeat within themselves, are cut out of their texts and dealt by
   anchor. Each task builds suffix arrays over shards of ``SHARD`` bytes: suffixes are sorted by their first 8 bytes and
   refined as Larsson and Sadakane do, unsorted groups alone, doubling the depth. Common prefixes come from Kasai's
   walk, in step over all contexts of a shard. Runs of suffixes with LENGTH bytes in common are equal windows; all but the first are removed.
3. An anchor of more than ``SPLIT`` contexts is split over several shards. What is first in a shard is merged with the other shards': digests of
   their windows are dealt and sorted, and the first of each kind is searched for.
   This is a merge of sorted digests, not a search of each shard's windows in each other shard's array, whose work would grow with the square of an anchor's shards.
4. Removed spans are gathered by document and applied to its text. Only texts that a bitmap of fixed size marks as asked for are dealt, here and in step 2.

Contexts and merged windows are compared by 128 bits of digests, suffixes byte by byte.

Cases: null, empty and short texts lose nothing; rows of equal doc_id and text are one document and lose the same;
different texts with one doc_id, or with a null one, which is the largest, are documents of their own, in the order of their digests; very long texts are read in pieces of ``PIECE`` windows;
texts of one repeated character are contexts of at most ``LONGEST`` windows; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import lean, light, marks, n_partitions, settle, split_by_marks, text_of
from storyloom.llm.jaccard import U, mix

LENGTH, GRAM = 100, 32
LONGEST, PIECE = 512, 1 << 18
SHARD, SPLIT = 1 << 18, 4096
#: Contexts that a task holds at a time before equal ones are settled: about 30 MB.
HELD = 250_000
_ODD = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)]
_BASE = 0x5851F42D4C957F2D


class _Powers:
    """Powers of a base and of its inverse modulo 2 ** 64."""

    up = down = np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = (np.cumprod(np.concatenate([[U(1)], np.full(n, U(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def words8(b: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The 8 bytes from each place on, as numbers."""
    n = len(b) - 7
    out = np.empty(max(n, 0), U)
    raw = b.tobytes()
    for s in range(min(8, max(n, 0))):
        out[s::8] = np.frombuffer(raw, order, (n - s + 7) // 8, s)
    return out


def sliding(x: np.ndarray, w: int, smallest: bool) -> np.ndarray:
    """The smallest, or the largest, of the w numbers from each place on, from running ones within blocks of w."""
    op, n = (np.minimum, len(x)) if smallest else (np.maximum, len(x))
    blocks = np.full(-(-n // w) * w, ~U(0) if smallest else U(0))
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).ravel()
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[: n - w + 1], ahead[w - 1 : n])


def sliced(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few texts are Python's at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def contexts(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """For the texts b[start:end]: place of the first window, number of windows, anchor and digest of each context, and whether its anchor occurs in it twice."""
    none = np.zeros(0, np.int64)
    long = ends - starts >= LENGTH
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none, none, none.view(U), none.view(U), none.astype(bool)
    m = mix(words8(b))
    n = len(m) - GRAM + 8
    grams = mix(sum((m[8 * k : 8 * k + n] * _ODD[k] for k in range(GRAM // 8)), np.zeros(n, U)))
    w = LENGTH - GRAM + 1
    smallest = sliding(grams, w, True)
    windows = ends - starts - LENGTH + 1
    at = np.repeat(starts - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
    anchor = smallest[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (anchor[1:] != anchor[:-1])])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * LONGEST
        size = np.minimum(np.repeat(size, pieces) - nth * LONGEST, LONGEST)
    place, anchor = at[first], anchor[first]
    up, down = _Powers.to(n + 1)
    total = np.concatenate([[U(0)], np.cumsum(grams * up[:n])])
    digest = (total[place + size + LENGTH - GRAM] - total[place]) * down[place]
    # A string is an anchor if it is the smallest of some window, so if the largest of the smallest around it is itself.
    gap = np.zeros(w - 1, U)
    chosen = np.flatnonzero(sliding(np.concatenate([gap, smallest, gap]), w, False) == grams)
    low, high = np.searchsorted(chosen, place), np.searchsorted(chosen, place + size + LENGTH - GRAM)
    of = np.repeat(np.arange(len(place)), high - low)
    held = chosen[np.repeat(low - np.cumsum(high - low) + high - low, high - low) + np.arange(len(of))]
    twice = np.bincount(of[grams[held] == anchor[of]], minlength=len(place)) > 1
    return place, size, anchor, mix(digest ^ size.astype(U) * _ODD[0]), twice


def unite(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by document without overlaps or touching ends."""
    if not len(doc):
        return doc, start, end
    at = np.lexsort((start, doc))
    doc, start, end = doc[at], start[at], end[at]
    # Ends so far within a document: documents are lifted above each other.
    lift = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)])) * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + lift)
    new = np.flatnonzero(np.concatenate([[True], (start + lift)[1:] > far[:-1]]))
    return doc[new], start[new], (far - lift)[np.append(new[1:], len(doc)) - 1]


SIZE_BITS = 11
TWICE = 1 << 10  # with the size: the context's anchor occurs in it twice, so some of its windows may be equal
ROW = ["key", "ctx", "doc", "pos"]


def _later(first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows lie after the first of their group; first: its index, for each row."""
    return (doc != doc[first]) | (start != start[first])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, digest, doc, place and size) of contexts; a size of 0 marks a removed span of doc, from place to digest."""
    held: list[list[np.ndarray]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        key, ctx, doc, start, size, twice = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        at = np.lexsort((start, doc, ctx, key))
        key, ctx, doc, start, size, twice = (x[at] for x in (key, ctx, doc, start, size, twice))
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
        again = _later(np.flatnonzero(new)[np.cumsum(new) - 1], doc, start) & ~new
        d, s, e = unite(doc[again], start[again], (start + size + LENGTH - 1)[again])
        rows = [np.concatenate([key[new].view(np.int64), mix(d.view(U)).view(np.int64)]), np.concatenate([ctx[new].view(np.int64), e]), np.concatenate([doc[new], d]), np.concatenate([start[new] << SIZE_BITS | size[new] | twice[new] * TWICE, s << SIZE_BITS])]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ROW)

    def take(pieces: list[tuple[int, int, bytes]]) -> None:
        nonlocal count
        data = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(8), np.uint8)
        sizes = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        place, size, anchor, ctx, twice = contexts(data, ends - sizes, ends)
        of = np.searchsorted(ends, place, "right")
        doc = np.fromiter((p[0] for p in pieces), np.int64, len(pieces))[of]
        base = np.fromiter((p[1] for p in pieces), np.int64, len(pieces))[of]
        held.append([anchor, ctx, doc, place - (ends - sizes)[of] + base, size, twice])
        count += len(place)

    pieces: list[tuple[int, int, bytes]] = []
    waiting = 0
    for batch in sliced(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
                piece = raw[at : at + PIECE + LENGTH - 1]
                if len(piece) >= LENGTH:
                    pieces.append((doc, at, piece))
                    waiting += len(piece)
            if waiting >= PIECE:
                take(pieces)
                pieces, waiting = [], 0
                if count >= HELD:
                    yield flush()
                    count = 0
    if pieces:
        take(pieces)
    if held:
        yield flush()


FOUND = ["kind", "doc", "a", "b", "key", "salt"]
SPAN, CUT = 0, 1


def _found(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], FOUND)


def _settle_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor, digest, doc and place: removed spans, and contexts to be cut out because their anchor has others."""
    held = [np.zeros(0, np.int64)] * 4
    running, number = None, 0  # an anchor whose contexts came in part, and how many

    def work(key: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray, open_end: bool) -> pa.RecordBatch:
        nonlocal running, number
        start, size, twice = pos >> SIZE_BITS, pos & (TWICE - 1), (pos & TWICE) > 0
        span = size == 0
        spans = doc[span], start[span], ctx[span]
        key, ctx, doc, start, size, twice = (x[~span] for x in (key, ctx, doc, start, size, twice))
        if not len(key):
            d, s, e = unite(*spans)
            z = np.zeros(len(d), np.int64)
            return _found(z + SPAN, d, s, e, z, z)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])])
        again = _later(np.flatnonzero(new)[np.cumsum(new) - 1], doc, start) & ~new
        d, s, e = unite(*(np.concatenate(x) for x in zip(spans, (doc[again], start[again], (start + size + LENGTH - 1)[again]), strict=True)))
        key, doc, start, size, twice = (x[new] for x in (key, doc, start, size, twice))
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.append(heads, len(key)))
        nth = np.arange(len(key)) - np.repeat(heads, many)
        hot = many > SPLIT
        if running is not None and key[0] == running:
            nth[: many[0]] += number
            hot[0] = True
            number += int(many[0]) if len(heads) == 1 else 0
        if open_end:
            hot[-1] = True
            if running != key[-1]:
                running, number = key[-1], int(many[-1])
        else:
            running = None
        hot = np.repeat(hot, many)
        ask = np.repeat(many, many) > 1
        ask |= hot | twice
        salt = np.where(hot, nth // SPLIT, -1)
        z, o = np.zeros(len(d), np.int64), np.ones(int(ask.sum()), np.int64)
        return _found(*(np.concatenate(x) for x in zip((z + SPAN, d, s, e, z, z), (o * CUT, doc[ask], start[ask], size[ask], key[ask], salt[ask]), strict=True)))

    for batch in batches:
        arrays = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
        key = arrays[0]
        if not len(key):
            continue
        cut, open_end = int(np.searchsorted(key, key[-1])), False
        if len(key) - cut > HELD:  # one anchor's contexts fill the memory: go on at the last digest
            inner = cut + int(np.searchsorted(arrays[1][cut:], arrays[1][-1]))
            cut, open_end = (inner, True) if inner > cut else (cut, False)
        if cut:
            yield work(*(a[:cut] for a in arrays), open_end)
        held = [a[cut:] for a in arrays]
    if len(held[0]):
        yield work(*held, False)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contexts."""
    for batch in sliced(batches):
        out: list[tuple] = []
        for doc, text, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for x in asked:
                piece = raw[x["a"] : x["a"] + x["b"] + LENGTH - 1]
                if len(piece) == x["b"] + LENGTH - 1:  # else it belongs to another text with this doc_id
                    out.append((x["key"], x["salt"], doc, x["a"], piece))
        yield pa.RecordBatch.from_arrays([*(pa.array([o[k] for o in out], pa.int64()) for k in range(4)), pa.array([o[4] for o in out], pa.binary())], ["key", "salt", "doc", "a", "piece"])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of bytes in order, by Larsson and Sadakane's refinement: groups not yet in order are sorted by the rank of what follows them."""
    n = len(t)
    key = words8(np.concatenate([t, np.zeros(8, np.uint8)]), ">u8")[:n]
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[sa] = group
    sizes = np.diff(np.append(np.flatnonzero(new), n))
    where = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places in sa of groups not in order
    h = 8
    while len(where):
        items, of = sa[where], group[where]
        far = items + h
        after = np.where(far < n, rank[np.minimum(far, n - 1)], -far)
        at = np.lexsort((after, of))
        items, after = items[at], after[at]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (after[1:] != after[:-1])])
        heads = np.flatnonzero(new)
        group[where] = where[heads][np.cumsum(new) - 1]
        sa[where] = items
        rank[items] = group[where]
        sizes = np.diff(np.append(heads, len(where)))
        where = where[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, starts: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Bytes, at most most, that each suffix in sa has in common with the one before it; by Kasai's walk, in step for the texts that begin at starts."""
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = n
    padded = np.concatenate([t.astype(np.int32), 256 + np.arange(2 * most + 2, dtype=np.int32)])
    out = np.zeros(n, np.int64)
    i, end, k = starts.copy(), np.append(starts[1:], n), np.zeros(len(starts), np.int64)
    while len(i):
        j = before[i]
        same = (k < most) & (padded[i + k] == padded[j + k]) & (j < n)
        done = ~same
        out[i[done]] = np.where(j < n, k, 0)[done]
        k = np.where(same, k + 1, np.where(j < n, np.maximum(k - 1, 0), 0))
        i = i + done
        live = i < end
        if not live.all():
            i, end, k = i[live], end[live], k[live]
    return out[sa]


def repeated(pieces: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of a shard's contexts: index of context, place in it, and whether an equal window comes earlier."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    t = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(sizes) - sizes
    sa = suffix_array(t)
    same = np.cumsum(common_prefixes(t, sa, begins) < LENGTH)
    group = np.empty(len(t), np.int64)
    group[sa] = same
    windows = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(pieces)), windows)
    place = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    g, d, s = group[begins[of] + place], doc[of], start[of] + place
    at = np.lexsort((s, d, g))
    new = np.concatenate([[True], g[at][1:] != g[at][:-1]])
    first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.empty(len(of), bool)
    later[at] = (d[at] != d[first]) | (s[at] != s[first])
    return of, place, later


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor and salt: removed spans (kind 0), and of split anchors the first windows (kind 1: a is the place, b and key its digest)."""
    rows: list[tuple] = []
    held = 0

    def work() -> pa.RecordBatch:
        key, salt, doc, start = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        pieces = [r[4] for r in rows]
        of, place, later = repeated(pieces, doc, start)
        d, s, e = unite(doc[of[later]], (start[of] + place)[later], (start[of] + place)[later] + LENGTH)
        z = np.zeros(len(d), np.int64)
        out = [z + SPAN, d, s, e, z, z]
        open_ = np.flatnonzero(~later & (salt[of] >= 0))
        if len(open_):
            made = [hashlib.blake2b(pieces[i][p : p + LENGTH], digest_size=16).digest() for i, p in zip(of[open_].tolist(), place[open_].tolist(), strict=True)]
            two = np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)
            o = np.ones(len(open_), np.int64)
            out = [np.concatenate(x) for x in zip(out, [o * CUT, doc[of[open_]], (start[of] + place)[open_], two[:, 0], two[:, 1], o * 0], strict=True)]
        return _found(*out)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and held >= SHARD and row[:2] != rows[-1][:2]:
                yield work()
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
    if rows:
        yield work()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From shards' first windows, sorted by digest, doc and place: spans of those that aren't the first of all."""
    last: tuple | None = None
    for batch in batches:
        b, key, doc, a = (c.to_numpy() for c in batch.columns)
        if not len(b):
            continue
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (key[1:] != key[:-1])])
        heads = np.flatnonzero(new)
        first = heads[np.searchsorted(heads, np.arange(len(b)), "right") - 1]
        later = (doc != doc[first]) | (a != a[first])
        if last is not None and (b[0], key[0]) == last[:2]:  # the first window's kind began before
            n = int(heads[1]) if len(heads) > 1 else len(b)
            later[:n] = (doc[:n] != last[2]) | (a[:n] != last[3])
        h = int(heads[-1])
        if last is None or h > 0 or (b[0], key[0]) != last[:2]:
            last = (b[h], key[h], doc[h], a[h])
        d, s, e = unite(doc[later], a[later], a[later] + LENGTH)
        z = np.zeros(len(d), np.int64)
        yield _found(z + SPAN, d, s, e, z, z)


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc orders documents by doc_id, null last, and tells apart different texts of one doc_id.

    Where ids are unique and none is null, doc is doc_id. Else different (doc_id, text) are sorted, by digests of the texts within an id, and counted.
    """
    texts = light(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if texts.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return texts.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    texts = texts.withColumn("digest", F.md5("text"))
    order = (F.col("doc_id").asc_nulls_last(), F.col("digest"))
    ranged = settle(texts.select("doc_id", "digest").distinct().repartitionByRange(n_partitions(docs), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    sizes = ranged.groupBy(part).count()
    before = sizes.withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")  # a row for each partition
    names = ranged.withColumn("part", part).join(F.broadcast(before), "part").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("doc"))
    return texts.join(names, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of"))).select("doc", "doc_id", "text")


def removed(texts: DataFrame) -> DataFrame:
    """Spans (doc, a, b) of bytes to remove from texts (doc, text), in which rows of equal doc have one text; those of a document may overlap."""
    kind = "kind long, doc long, a long, b long, key long, salt long"
    texts = texts.select("doc", "text")
    seen = texts.mapInArrow(lean(_scan), "key long, ctx long, doc long, pos long")
    first = settle(seen.repartition("key").sortWithinPartitions(*ROW).mapInArrow(lean(_settle_contexts), kind))
    asked = first.filter(f"kind = {CUT}").groupBy("doc").agg(F.collect_list(F.struct("a", "b", "key", "salt")).alias("asked"))
    some, _ = split_by_marks(texts, "doc", marks(first.filter(f"kind = {CUT}"), "doc"))  # other texts aren't dealt
    pieces = some.join(asked.hint("shuffle_hash"), "doc").select("doc", "text", "asked").mapInArrow(lean(_cut), "key long, salt long, doc long, a long, piece binary")
    second = settle(pieces.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(lean(_shards), kind))
    merged = second.filter(f"kind = {CUT}").select("b", "key", "doc", "a").repartition("b", "key").sortWithinPartitions("b", "key", "doc", "a").mapInArrow(lean(_merge), kind)
    spans = lambda df: df.filter(f"kind = {SPAN}").select("doc", "a", "b")
    return spans(first).unionByName(spans(second)).unionByName(spans(merged))


def _apply(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"text": []} if keep_text else {})
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                a, b = (np.array([min(x[k], len(raw)) for x in spans or ()], np.int64) for k in ("a", "b"))
                real = b > a
                _, a, b = unite(np.zeros(int(real.sum()), np.int64), a[real], b[real])
                kept = b"".join(raw[s:e] for s, e in zip([0, *b.tolist()], [*a.tolist(), len(raw)], strict=True))
                for name, value in (("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(a)), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                    rows[name].append(value)
                if keep_text:
                    rows["text"].append(kept.decode("utf-8", "ignore"))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] * keep_text)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True))], ["doc_id", *rows])

    return run


def dedup(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs, and the text that is left (whole characters)."""
    texts = numbered(docs)
    found = removed(texts)
    some, whole = split_by_marks(texts, "doc", marks(found, "doc"))
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text
    rows = some.join(spans.hint("shuffle_hash"), "doc", "left").select("doc_id", "text", "spans").mapInArrow(lean(_apply(keep_text)), schema)
    none = F.lit(0).cast("long")
    return rows.unionByName(whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *(["text"] * keep_text)))
