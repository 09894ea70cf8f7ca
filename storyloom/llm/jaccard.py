"""N-gram Jaccard join with set-relation skipping (operator 3).

A document's set: the distinct shingles of ``size`` words of its whole text, A-Z in lower case; with fewer words, the
whole sequence as one; without words or text, empty and linked with nothing. Documents link when
``100 * |A & B| >= percent * |A | B|``; the result is each document's component under these links. The join is exact.
size and percent are ``SHINGLE`` and ``PERCENT`` for the query op3_jaccard; the pipeline's stage passes its own.

Method.
1. A first scan counts shingles in a table of counters, four for each row but ``CELLS`` at least and ``MOST_CELLS`` at most. Their logarithms give one
   global order, rare shingles first; its quality affects only speed.
2. A second scan makes each document's set, once: (doc_id, set size, digest of the set), and for each class of equal sets, which are never
   paired from here on, a parity bitmap and its prefix in the global order, ``n - ceil(percent / 100 * n) + 1`` shingles, as index entries. Lists of one
   class vanish. Within a list, members are chained in a few pseudo-random orders: links between neighbours in a chain are checked
   first, which joins the members of a group of near copies with work linear in its size.
3. Index-level skipping. In lists that hold more than one component, entries stand in blocks by position; for each set, size and position bounds turn
   every block into a range of sizes, and blocks whose range is empty are skipped. Pairs within one component are never looked at, and every other
   pair that is left is checked by the parity bitmaps there and then.
   Where many pairs are left, rounds come first in which each component's nearest pair is compared, and pairs that are in one component after that are dropped.
4. Answer-level skipping. The chains' links give each set a leader, the most similar set it is known to be linked with, and the number of shingles in which they differ. For the pairs
   that step 3 leaves, the difference is counted for their leaders, once for all pairs with the same two. A pair's answer is derived from
   its leaders' by the triangle inequality; only where that leaves it open, the pair's own sets are compared.
:func:`join` and the query op3_jaccard return components. :func:`links` returns every link: it crosses lists with each class as a component of its own, and derives
the links of similar sets in the same way.
Lists that are long are dealt to many tasks: salted in step 2, and in step 3 cut in blocks of about ``BLOCK`` members, of which only those are paired that hold different components.

Shingles and sets are compared by 64-bit digests: for n sets about n^2 / 2^65 wrong equalities are expected.

Cases: null and empty texts have n_shingles 0 and their own doc_id as component_id; repeated rows are copies; a null doc_id is never
the smallest unless alone; very long texts are sets like others; an empty table gives no rows; further columns are not read; doc_id is a whole number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import afresh, lean, light, marks, only_first, row_key, settle, split_by_marks, text_of
from storyloom.llm.graph import components

SHINGLE, PERCENT = 3, 90
CELLS, MOST_CELLS = 1 << 20, 1 << 24
CHUNK = 1 << 14  # counters in a row
CHAINS, SALT, BLOCK = 3, 2048, 4096
BITS = 8  # words of a parity bitmap
#: Rows that a task handles at a time, classes that it remembers, and index entries and pairs that it holds: some MB each.
ROWS, SEEN, HELD, PAIRS = 500, 200_000, 250_000, 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: Words of more bytes are digested one by one.
LONG_WORD = 256


def word_digests(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all words of the texts, and how many each text has."""
    data = (b" ".join(raws) + bytes([32] * 9)).translate(_LOWER)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    first, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # the 8 bytes from each place on
    h = mix(size.astype(U) + U(1))
    left = np.flatnonzero(size <= LONG_WORD)
    k = 0
    while len(left):
        rest = np.minimum(size[left] - k, 8)
        h[left] = mix(h[left] ^ (eight[first[left] + k] & (~U(0) >> (U(64) - 8 * rest.astype(U)))))
        k += 8
        left = left[size[left] > k]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[first[i] : first[i] + size[i]])
    ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    return h, np.diff(np.searchsorted(first, ends), prepend=0)


def all_shingles(raws: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the shingles of all texts, repeated ones too, and how many each text has."""
    h, words = word_digests(raws)
    n = max(0, len(h) - size + 1)
    x = h[:n]
    for k in range(1, size):
        x = mix(x) ^ h[k : n + k]
    x = mix(x)
    ends = np.cumsum(words)
    short = np.flatnonzero((words > 0) & (words < size))
    counts = np.where(words >= size, words - size + 1, (words > 0).astype(np.int64))
    at = np.repeat(ends - words - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    out = x[np.minimum(at, n - 1)] if n else np.zeros(len(at), U)
    place = np.cumsum(counts) - counts
    for i in short.tolist():
        out[place[i]] = xxhash.xxh64_intdigest(h[ends[i] - words[i] : ends[i]].tobytes(), seed=int(words[i]))
    return out, counts


def sets_of(raws: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted digests of its distinct shingles."""
    x, counts = all_shingles(raws, size)
    end = 0
    for n in counts.tolist():
        s = np.sort(x[end : end + n])
        end += n
        yield s[np.concatenate([[True], s[1:] != s[:-1]])] if n > 1 else s


def shingles(text: str | bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted digests of the distinct shingles."""
    return next(sets_of([text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text], size))


def digest(s: np.ndarray) -> int:
    """Of a set; fits a signed 64-bit number."""
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def slices(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Some rows at a time, with the bytes of their texts; very long texts come in fewer rows."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part, raws, held = batch.slice(at, ROWS), [], 0
            for text in part.column(column):
                raws.append(text.as_py().encode("utf-8", "surrogatepass"))
                held += len(raws[-1])
                if held > 1 << 21:
                    break
            at += len(raws)
            yield part.slice(0, len(raws)), raws


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _count(size: int, cells: int):
    """The task's counters of shingles, as chunks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(cells, np.uint32)  # a task has fewer shingles than would overflow
        for _, raws in slices(batches):
            x, _ = all_shingles(raws, size)
            at = np.sort((x & U(cells - 1)).astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            counts[at[first]] += np.diff(np.append(first, len(at))).astype(np.uint32)
        part = TaskContext.get().partitionId()
        for c in range(cells // CHUNK):
            row = counts[c * CHUNK : (c + 1) * CHUNK].astype("<i8")
            if row.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([part], pa.int64()), pa.array([zstandard.compress(row.tobytes(), 1)], pa.binary())], ["chunk", "part", "counts"])

    return count


def _total(table: pa.Table) -> pa.Table:
    total = sum((np.frombuffer(zstandard.decompress(x), "<i8") for x in table.column("counts").to_pylist()), np.zeros(CHUNK, np.int64))
    return pa.table({"chunk": table.column("chunk")[:1], "part": pa.array([0], pa.int64()), "counts": pa.array([zstandard.compress(total.astype("<i8").tobytes(), 1)], pa.binary())})


def _ranked(table: pa.Table) -> pa.Table:
    counts = np.frombuffer(zstandard.decompress(_total(table).column("counts")[0].as_py()), "<i8")
    ranks = np.minimum(255, np.log2(np.maximum(counts, 1)) * RANKS).astype(np.uint8)
    return pa.table({"chunk": table.column("chunk")[:1], "total": pa.array([int(counts.sum())], pa.int64()), "ranks": pa.array([ranks.tobytes()], pa.binary())})


#: Ranks to a doubling of the count.
RANKS = 6


def order_of(texts: DataFrame, size: int, cells: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For each cell a rank by its count; the count of each rank; the mean count. On the driver, cells bytes."""
    kind = "chunk long, part long, counts binary"
    some = texts.mapInArrow(lean(_count(size, cells)), kind).withColumn("part", F.col("part") % 64)
    chunks = some.groupBy("chunk", "part").applyInArrow(_total, kind).groupBy("chunk").applyInArrow(_ranked, "chunk long, total long, ranks binary").collect()
    ranks = np.zeros(cells, np.uint8)
    for r in chunks:
        ranks[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["ranks"], np.uint8)
    return ranks, np.ceil(2.0 ** (np.arange(256) / RANKS)).astype(np.int64), sum(r["total"] for r in chunks) // cells


SALT_BITS, POS_BITS = 10, 25
MADE = ["key", "pack", "cls", "doc", "extra"]


def _entries(ranks, mean: int, size: int, percent: int):
    """Rows of MADE. Index entries: key, packed size, position and salt, class. With extra: documents (a key of its own, n, class, doc_id, row key),
    and classes (class, n, class, digest of a text that has it, parity bitmap), the latter like entries the first time a task meets them."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, least = ranks.value
        seen: set[int] = set()
        cells, number = len(rank), 0
        for batch, raws in slices(batches, 1):
            ids, names, hashes = (batch.column(c).to_pylist() for c in (0, 2, 3))
            keys, packs, classes, rows = [], [], [], []
            for raw_id, name, text, s in zip(ids, names, hashes, sets_of(raws, size), strict=True):
                n = len(s)
                c = digest(s)
                number += 1
                rows.append((xxhash.xxh64_intdigest(name, seed=number) - (1 << 63), n, c, raw_id, name))  # repeated rows too go to many tasks
                if not n or c in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(c)
                parity = np.packbits((np.bincount((s >> U(55)).astype(np.int64), minlength=64 * BITS) & 1).astype(np.uint8))
                rows.append((c, n, c, text, parity.tobytes()))
                r = rank[(s & U(cells - 1)).astype(np.int64)]
                at = np.argsort(r, kind="stable")[: prefix_length(n, percent)]
                s, r = s[at], r[at]
                # Long lists only: shingles of cells that are far above the mean, by their surplus.
                salts = np.minimum((1 << SALT_BITS) - 1, 1 + np.maximum(0, least[r] - 2 * mean) // SALT)
                salt = (mix(s ^ U(c & (1 << 64) - 1)) % salts.astype(U)).astype(np.int64)
                salt[salts > 1] += 1  # 0: the list isn't salted
                salt = np.minimum(salt, (1 << SALT_BITS) - 1)
                keys.append(np.where(salt > 0, s ^ mix(salt.astype(U)), s).view(np.int64))
                packs.append((n << (POS_BITS + SALT_BITS)) | (np.arange(len(s)) << SALT_BITS) | salt)
                classes.append(np.full(len(s), c, np.int64))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array([r[4] for r in rows], pa.binary())], MADE)
            if keys:
                k = sum(map(len, keys))
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (keys, packs, classes)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], MADE)

    return emit


def unpack(pack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, positions, salts."""
    return pack >> (POS_BITS + SALT_BITS), (pack >> SALT_BITS) & ((1 << POS_BITS) - 1), pack & ((1 << SALT_BITS) - 1)


def may_link(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets of n and m shingles can link if p and q of them come before the first that both have."""
    k = 100 + percent
    return np.minimum(n - p, m - q) * k >= percent * (n + m)


PAIR, ENTRY, DOCUMENT, CLASS = 0, 1, 2, 3
LISTED = ["kind", "a", "b", "pack", "doc", "extra"]


def _chains(percent: int):
    """From rows of MADE sorted by key: pairs of neighbours in a chain (class a, the next class b, its place in the chain's order, the order), the entries of lists of several classes (class a, token b, pack), documents and classes (class a, n b)."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # key, pack, class, and whether the entry was returned before
        last_class: int | None = None

        def work(part: bool) -> Iterator[pa.RecordBatch]:
            """Handles the lists in held; of the list that goes on, if part, one entry stays there."""
            nonlocal held
            key, pack, cls, done = held
            turn = mix(mix((key.view(U) % U(CHAINS)) + U(1)) ^ cls.view(U))
            at = np.lexsort((-done, cls, turn, key))
            key, pack, cls, done, turn = (x[at] for x in (key, pack, cls, done, turn))
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])])
            key, pack, cls, done, turn = (x[new] for x in (key, pack, cls, done, turn))  # a class that several tasks met counts once
            if part and len(key) == 1:
                held = [key, pack, cls, done]
                return
            n, p, salt = unpack(pack)
            near = np.flatnonzero(key[1:] == key[:-1])
            near = near[may_link(n[near], p[near], n[near + 1], p[near + 1], percent)]
            order = (key[near].view(U) % U(CHAINS)).astype(np.int64)
            pairs = np.unique(np.stack([cls[near], cls[near + 1], (turn[near + 1] >> U(1)).astype(np.int64), order], 1), axis=0) if len(near) else np.zeros((0, 4), np.int64)
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            several = (same[1:] | same[:-1] | (salt > 0) | (done > 0)) & (done == 0)
            token = np.where(salt > 0, (key.view(U) ^ mix(salt.astype(U))).view(np.int64), key)[several]
            k = len(token)
            columns = [np.concatenate([np.full(len(pairs), PAIR), np.full(k, ENTRY)]), np.concatenate([pairs[:, 0], cls[several]]), np.concatenate([pairs[:, 1], token]), np.concatenate([pairs[:, 2], pack[several]])]
            orders = pa.concat_arrays([pa.array(pairs[:, 3]), pa.nulls(k, pa.int64())])
            k += len(pairs)
            held = [x[-1:] for x in (key, pack, cls, np.ones(len(key), np.int64))] if part else [np.zeros(0, np.int64)] * 4
            if k:
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns), orders, pa.nulls(k, pa.binary())], LISTED)

        for batch in batches:
            mark = pc.is_valid(batch.column("extra"))
            named = batch.filter(mark)
            if named.num_rows:
                key, n, cls, doc, extra = named.columns
                kind = np.where(pc.binary_length(extra).to_numpy() == 8 * BITS, CLASS, DOCUMENT)
                keep = np.ones(len(kind), bool)  # a class that several tasks met counts once: its rows are neighbours
                of = cls.to_numpy()
                for i in np.flatnonzero(kind == CLASS).tolist():
                    keep[i], last_class = of[i] != last_class, int(of[i])
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int64)), cls, n, pa.nulls(len(kind), pa.int64()), doc, extra], LISTED).filter(pa.array(keep))
            plain = batch.filter(pc.invert(mark))
            if not plain.num_rows:
                continue
            held = [np.concatenate([h, c]) for h, c in zip(held, [*(c.to_numpy() for c in plain.columns[:3]), np.zeros(plain.num_rows, np.int64)], strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
            if cut:
                rest = [x[cut:] for x in held]
                held = [x[:cut] for x in held]
                yield from work(False)
                held = rest
            if len(held[0]) > HELD:
                yield from work(True)
        if len(held[0]):
            yield from work(False)

    return chain


def bits_apart(w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits the parity bitmaps w of sets i and j differ."""
    return np.bitwise_count(w[:, i].view(U) ^ w[:, j].view(U)).sum(axis=0, dtype=np.int64)  # of signed numbers it would count the absolute value


def close(w: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether sets i and j can link by their parity bitmaps w: sets differ in at least as many shingles as their bitmaps in bits."""
    apart = bits_apart(w, i, j)
    # |A ^ B| = |A| + |B| - 2 |A & B| <= (|A| + |B|) * (100 - percent) / (100 + percent) for links.
    return apart * (100 + percent) <= (n[i] + n[j]) * (100 - percent)


def bitmaps(column: pa.Array) -> np.ndarray:
    """Parity bitmaps as BITS rows of words."""
    raw = b"".join(column.to_pylist())
    return np.ascontiguousarray(np.frombuffer(raw, np.int64).reshape(-1, BITS).T)


def cross_pairs(n: np.ndarray, p: np.ndarray, cls: np.ndarray, root: np.ndarray, side: np.ndarray, w: np.ndarray, both: bool, percent: int = PERCENT, bits: bool = False) -> Iterator[np.ndarray]:
    """Pairs of classes of different roots in an index list that may link; with both, only of different sides; with bits, the number of bits in which their bitmaps differ comes third.

    The list stands in blocks by position, each by size. For a set, a block is a range of sizes, often empty.
    """
    k = 100 + percent
    at = np.lexsort((cls, n, p))
    n, p, cls, root, side, w = n[at], p[at], cls[at], root[at], side[at], w[:, at]
    starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    ends = np.append(starts[1:], len(p))
    high = ((k - percent) * n - k * p) // percent  # largest partner by this set's position
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        q, sizes = p[s], n[s:e]
        low = -(-(percent * n + k * q) // (k - percent))  # smallest partner at position q
        first = np.searchsorted(sizes, low, "left")
        last = np.searchsorted(sizes, high, "right")
        x = np.flatnonzero(last > first)
        if not len(x):
            continue
        for part in np.array_split(x, max(1, int((last - first)[x].sum()) // PAIRS)):
            width = (last - first)[part]
            i = np.repeat(part, width)
            j = s + np.repeat(first[part] - np.cumsum(width) + width, width) + np.arange(width.sum())
            good = (cls[i] < cls[j]) & (root[i] != root[j])
            if both:
                good &= side[i] != side[j]
            i, j = i[good], j[good]
            good = close(w, n, i, j, percent)
            if good.any():
                yield np.stack([cls[i[good]], cls[j[good]], *([bits_apart(w, i[good], j[good])] if bits else [])], 1)


#: Index lists of at most so many entries are paired together, by distance.
SHORT = 12
CROSSED = ["token", "i", "j", "side", "pack", "cls", "root"]


FOUND = ["a", "b", "bits", "token"]


def nearest(pairs: np.ndarray, cls: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of the pairs (a, b, bits) of classes cls that have these roots, for each root the one of fewest bits."""
    at = np.argsort(cls)
    ends = np.concatenate([root[at][np.searchsorted(cls[at], pairs[:, c])] for c in (0, 1)])
    a, b, bits = np.concatenate([pairs, pairs]).T
    order = np.lexsort((b, a, bits, ends))
    first = np.concatenate([[True], ends[order][1:] != ends[order][:-1]])
    return pairs[np.unique(order[first] % len(pairs))]


def _crossings(percent: int, whole: bool):
    """From entries (CROSSED, parity) sorted by (token, i, j): pairs of different components that may link, and the bits in which their bitmaps differ.

    Unless whole, a list or two blocks of more pairs for each entry than a short list can have give the nearest pair of each component only, and a row of i, j, how many pairs they have, and
    their token, which is null in pairs. So rows are no more than a multiple of the entries, whatever the size of a group.
    """

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (len(CROSSED) + BITS)

        def work(arrays: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            token, i, j, side, pack, cls, root = arrays[: len(CROSSED)]
            w = np.stack(arrays[len(CROSSED) :])
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            heads = np.flatnonzero(new)
            sizes = np.diff(np.append(heads, len(token)))
            n, p, _ = unpack(pack)
            of = np.cumsum(new) - 1
            short = sizes[of] <= SHORT
            found, more = [], []
            for d in range(1, SHORT):
                x = np.flatnonzero(short[:-d] & (of[:-d] == of[d:]) & (root[:-d] != root[d:])) if len(of) > d else ()
                if not len(x):
                    continue
                y = x + d
                good = ((i[x] == j[x]) | (side[x] != side[y])) & may_link(n[x], p[x], n[y], p[y], percent)
                x, y = x[good], y[good]
                good = close(w, n, x, y, percent)
                x, y = x[good], y[good]
                found.append(np.stack([np.minimum(cls[x], cls[y]), np.maximum(cls[x], cls[y]), bits_apart(w, x, y)], 1))
            for s, size in zip(heads[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
                e = s + size
                here, made = [], 0
                for part in cross_pairs(n[s:e], p[s:e], cls[s:e], root[s:e], side[s:e], w[:, s:e], bool(i[s] != j[s]), percent, True):
                    here.append(part)
                    made += len(part)
                    if sum(map(len, here)) > PAIRS:
                        if whole:
                            yield batch_of(here)
                            here = []
                        else:
                            here = [nearest(np.concatenate(here), cls[s:e], root[s:e])]
                if 2 * made > (SHORT - 1) * size and not whole:  # more for each entry than a short list can have
                    here = [nearest(np.concatenate(here), cls[s:e], root[s:e])]
                    more.append((i[s], j[s], made, token[s]))
                found += here
                if sum(map(len, found)) > PAIRS:
                    yield batch_of(found)
                    found = []
            if found:
                yield batch_of(found)
            if more:
                yield pa.RecordBatch.from_arrays([pa.array([int(x[c]) for x in more], pa.int64()) for c in range(4)], FOUND)

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(pairs[:, c])) for c in range(3)), pa.nulls(len(pairs), pa.int64())], FOUND)

        for batch in batches:
            k = len(CROSSED)
            arrays = [np.concatenate([h, c]) for h, c in zip(held, [*(c.to_numpy() for c in batch.columns[:k]), *bitmaps(batch.column(k))], strict=True)]
            if not len(arrays[0]):
                continue
            last = (arrays[0] == arrays[0][-1]) & (arrays[1] == arrays[1][-1]) & (arrays[2] == arrays[2][-1])
            cut = len(last) - int(last.sum())
            if cut:
                yield from work([a[:cut] for a in arrays])
            held = [a[cut:] for a in arrays]
        if len(held[0]):
            yield from work(held)

    return cross


def _near(percent: int):
    """The pairs (a, b, sizes, parity bitmaps) that may link by their bitmaps."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
                w = np.concatenate([bitmaps(batch.column(c)) for c in ("parity_a", "parity_b")], axis=1)
                i = np.arange(batch.num_rows)
                yield batch.drop_columns(["n_a", "n_b", "parity_a", "parity_b"]).filter(pa.array(close(w, n, i, i + batch.num_rows, percent)))

    return near


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press, seen = zstandard.ZstdCompressor(level=1), set()
    for batch, raws in slices(batches, 1):
        new = []
        for name, raw in zip(batch.column(0).to_pylist(), raws, strict=True):
            if name not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name)
                new.append((name, press.compress(raw)))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.binary())], ["text_id", "z"])


def _common(size: int):
    """Pairs (a, b, packed texts) with the number of shingles that both sets have."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def get(c: int, z: bytes) -> np.ndarray:
            if c not in sets:
                if len(sets) > 100:
                    sets.clear()
                sets[c] = shingles(zstandard.decompress(z), size)
            return sets[c]

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                both = [len(np.intersect1d(get(a, x), get(b, y), assume_unique=True)) for a, b, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64())], ["a", "b", "both"])

    return common


class Sets:
    """The classes of a table of documents, and how their sets are compared.

    rows: doc_id, n, cls, row_key. lists: cls, token, pack. chains: a, the next class b, its place t in the order o. nodes: cls, n, text_id, parity.
    """

    def __init__(self, docs: DataFrame, size: int, percent: int) -> None:
        spark = docs.sparkSession
        self.size, self.percent = size, percent
        self.texts = light(docs).select(text_of().alias("text"))
        cells = min(MOST_CELLS, max(CELLS, 1 << (4 * docs.count()).bit_length()))
        ranks, least, mean = order_of(self.texts, size, cells)
        shared = spark.sparkContext.broadcast((ranks, least))
        named = docs.select(F.col("doc_id").cast("long").alias("doc"), text_of().alias("text"), row_key().alias("row_key")).select("doc", "text", F.unhex("row_key").alias("row_key"), F.xxhash64("text").alias("text_id"))
        made = named.mapInArrow(lean(_entries(shared, mean, size, percent)), "key long, pack long, cls long, doc long, extra binary")
        listed = settle(made.repartition("key").sortWithinPartitions("key").mapInArrow(lean(_chains(percent)), "kind long, a long, b long, pack long, doc long, extra binary"))
        self.rows = listed.filter(f"kind = {DOCUMENT}").select(F.col("doc").alias("doc_id"), F.col("b").alias("n"), F.col("a").alias("cls"), F.lower(F.hex("extra")).alias("row_key"))
        self.nodes = listed.filter(f"kind = {CLASS}").select(F.col("a").alias("cls"), F.col("b").alias("n"), F.col("doc").alias("text_id"), F.col("extra").alias("parity"))
        self.chains = listed.filter(f"kind = {PAIR}").select("a", "b", F.col("doc").alias("o"), F.col("pack").alias("t")).distinct()
        self.lists = listed.filter(f"kind = {ENTRY}").select(F.col("a").alias("cls"), F.col("b").alias("token"), "pack")

    def side(self, s: str, *columns: str) -> DataFrame:
        return self.nodes.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns))

    def neighbours(self) -> DataFrame:
        """Compared pairs: of each class and order, the next class of those that share a list with it and may link by the parity bitmaps.

        However many lists a class is in, it has one such neighbour in each order, and a group of near copies still hangs together.
        """
        both = self.chains.join(self.side("a", "n", "parity"), "a").join(self.side("b", "n", "parity"), "b")
        likely = both.select("a", "b", "o", "t", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(lean(_near(self.percent)), "a long, b long, o long, t long")
        nearest = likely.groupBy("a", "o").agg(F.min(F.struct("t", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        return self.compared(nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def compared(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with n_a, n_b, and apart: the number of shingles that one of both sets has. Only the texts that are asked for are dealt."""
        asked = afresh(pairs.join(self.side("a", "n", "text_id"), "a").join(self.side("b", "n", "text_id"), "b"))
        if asked.isEmpty():
            return asked.select("a", "b", "n_a", "n_b", F.lit(0).cast("long").alias("apart"))
        wanted = asked.select(F.explode(F.array("text_id_a", "text_id_b")).alias("text_id"))
        some, _ = split_by_marks(self.texts.select(F.xxhash64("text").alias("text_id"), "text"), "text_id", marks(wanted, "text_id"))
        bodies = afresh(some.mapInArrow(lean(_pack_texts), "text_id long, z binary").join(wanted.distinct(), "text_id", "left_semi").groupBy("text_id").agg(F.first("z").alias("z")))
        body = lambda s: bodies.select(F.col("text_id").alias(f"text_id_{s}"), F.col("z").alias(f"z_{s}"))
        both = asked.join(body("a"), "text_id_a").join(body("b"), "text_id_b").select("a", "b", "z_a", "z_b").mapInArrow(lean(_common(self.size)), "a long, b long, both long")
        return afresh(both.join(asked.select("a", "b", "n_a", "n_b"), ["a", "b"]).select("a", "b", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - 2 * F.col("both")).alias("apart")))

    def links(self, apart: str = "apart"):
        """The condition that sets of n_a and n_b shingles link that differ in so many."""
        return F.expr(f"({apart}) < n_a + n_b AND ({apart}) * {100 + self.percent} <= (n_a + n_b) * {100 - self.percent}")

    def crossed(self, labelled: DataFrame, whole: bool) -> DataFrame:
        """Pairs of classes of different roots that may link, with bits, from lists (token, pack, cls, root). Unless whole, also rows with a token: of lists that have more pairs.

        A list is cut in blocks: of a root of more than BLOCK entries by class, of the others together by root. Blocks of one root aren't paired with each other.
        """
        held = labelled.groupBy("token", "root").agg(F.count("*").alias("c"))
        big = F.collect_list(F.when(F.col("c") > BLOCK, F.struct("root", F.ceil(F.col("c") / BLOCK).cast("int").alias("k")))).alias("big")
        small = F.coalesce(F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))), F.lit(0))
        lists = held.groupBy("token").agg(F.count("*").alias("roots"), F.ceil(small / BLOCK).cast("int").alias("pooled"), big).filter("roots > 1").drop("roots")
        left = labelled.join(lists, "token").withColumn("nth", F.expr("cast(array_position(transform(big, x -> x.root), root) as int)"))
        left = left.withColumn("begin", F.expr("pooled + aggregate(slice(big, 1, greatest(nth - 1, 0)), 0, (n, x) -> n + x.k)")).withColumn("total", F.expr("pooled + aggregate(big, 0, (n, x) -> n + x.k)"))
        left = left.withColumn("parts", F.expr("if(nth > 0, element_at(big, nth).k, 0)"))
        left = left.withColumn("own", F.expr("cast(if(nth > 0, begin + pmod(xxhash64(cls), parts), pmod(xxhash64(root), pooled)) as int)"))
        left = left.withColumn("other", F.explode(F.expr("filter(sequence(0, total - 1), x -> nth = 0 OR x < begin OR x >= begin + parts)")))
        left = left.select("token", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), F.col("own").cast("long").alias("side"), "pack", "cls", "root")
        left = left.join(self.nodes.select("cls", "parity"), "cls").select(*CROSSED, "parity")
        return left.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lean(_crossings(self.percent, whole)), "a long, b long, bits long, token long").distinct()

    def derived(self, pairs: DataFrame, tried: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, derived from what their leaders differ in where that is enough; tried: compared neighbours."""
        linked = tried.filter(self.links())
        both = linked.select(F.col("a").alias("cls"), F.col("b").alias("leader"), "apart").unionByName(linked.select(F.col("b").alias("cls"), F.col("a").alias("leader"), "apart"))
        # Of two sets that would lead each other the one with the smaller class leads.
        leaders = both.filter("leader < cls").groupBy("cls").agg(F.min(F.struct("apart", "leader")).alias("m")).select("cls", "m.leader", "m.apart")
        lead = lambda s: leaders.select(F.col("cls").alias(s), F.col("leader").alias(f"l_{s}"), F.col("apart").alias(f"d_{s}"))
        led = pairs.join(lead("a"), "a", "left").join(lead("b"), "b", "left").join(self.side("a", "n"), "a").join(self.side("b", "n"), "b")
        led = led.withColumns({"l_a": F.coalesce("l_a", "a"), "l_b": F.coalesce("l_b", "b"), "d": F.coalesce("d_a", F.lit(0)) + F.coalesce("d_b", F.lit(0))})
        led = afresh(led.select("a", "b", "n_a", "n_b", "d", F.least("l_a", "l_b").alias("x"), F.greatest("l_a", "l_b").alias("y")))
        asked = led.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        known = tried.select("a", "b", "apart")
        told = self.compared(asked.join(known, ["a", "b"], "left_anti")).select("a", "b", "apart").unionByName(known).select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("apart").alias("far"))
        led = afresh(led.join(told, ["x", "y"], "left").withColumn("far", F.coalesce("far", F.lit(0))))  # leaders that are one set
        sure = led.filter(self.links("far + d"))
        open_ = led.filter(self.links("greatest(far - d, 0)") & ~self.links("far + d")).select("a", "b")
        own = self.compared(open_).filter(self.links())
        return afresh(sure.select("a", "b").unionByName(own.select("a", "b")))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b) between nodes, which needn't be in roots."""
    name = lambda s: F.coalesce(f"r_{s}", s).alias(s)
    over = components(links.join(_rooted(roots, "a"), "a", "left").join(_rooted(roots, "b"), "b", "left").select(name("a"), name("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    lone = over.join(roots.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
    return afresh(known.unionByName(lone))


def _rooted(roots: DataFrame, s: str) -> DataFrame:
    return roots.select(F.col("node").alias(s), F.col("root").alias(f"r_{s}"))


#: Up to so many pairs of different components are compared without rounds of merging first.
FEW, MERGES = 100_000, 5
#: Times that lists of very many pairs give the nearest pair of each component before they give all.
TURNS = 8


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b, bits) whose components differ, with these, ra and rb."""
    rows = pairs.join(_rooted(roots, "a"), "a", "left").join(_rooted(roots, "b"), "b", "left")
    return rows.select("a", "b", "bits", F.coalesce("r_a", "a").alias("ra"), F.coalesce("r_b", "b").alias("rb")).filter("ra <> rb")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    return _named(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """a, b, doc_a, doc_b: every link between different sets, by their classes (a < b) and the smallest doc_id of each.

    Nothing is skipped inside a component, so work and rows grow with the square of a group of near copies, as its links do. Documents with equal
    sets are linked too, and to what the others of their class are linked with; they share a class and have no rows of their own.
    """
    sets = Sets(docs, size, percent)
    tried = sets.neighbours()
    pairs = sets.crossed(sets.lists.withColumn("root", F.col("cls")), True).select("a", "b").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    found = sets.derived(pairs, tried).unionByName(tried.filter(sets.links()).select("a", "b"))
    least = sets.rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = lambda s: least.select(F.col("cls").alias(s), F.col("least").alias(f"doc_{s}"))
    return found.join(named("a"), "a").join(named("b"), "b").select("a", "b", "doc_a", "doc_b")


def answered(sets: Sets, pairs: DataFrame, roots: DataFrame, tried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots and tried after all pairs (a, b, bits) have their answers."""
    for _ in range(MERGES):
        if pairs.count() <= FEW:
            break
        # Of each component the pair that is nearest by the bitmaps; what it joins makes most of the other pairs needless.
        both = apart(pairs, roots)
        near = both.select(F.col("ra").alias("r"), "a", "b", "bits").unionByName(both.select(F.col("rb").alias("r"), "a", "b", "bits")).groupBy("r").agg(F.min(F.struct("bits", "a", "b")).alias("m"))
        more = sets.compared(near.select("m.a", "m.b").distinct())
        roots = merged(roots, more.filter(sets.links()).select("a", "b"))
        tried = tried.unionByName(more)
        pairs = afresh(apart(pairs, roots).join(more.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "bits"))
    return merged(roots, sets.derived(pairs.select("a", "b"), tried)), tried


def _named(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, row_key, component_id and top, a class that names the component, for each row of docs."""
    sets = Sets(docs, size, percent)
    tried = sets.neighbours()
    roots = components(tried.filter(sets.links()))
    lists, done, whole = sets.lists, tried.select("a", "b"), False
    for turn in range(1, TURNS + 2):
        labelled = lists.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("token", "pack", "cls", F.coalesce("root", "cls").alias("root"))
        found = afresh(sets.crossed(labelled, whole))
        pairs = afresh(found.filter("token IS NULL").select("a", "b", "bits").join(done, ["a", "b"], "left_anti"))
        new = not pairs.isEmpty()
        if new:
            roots, tried = answered(sets, pairs, roots, tried)
        left = found.filter("token IS NOT NULL")
        if whole or not (most := left.agg(F.sum("bits")).first()[0]):
            break
        # Lists of very many pairs come again: most of their pairs are in one component now. If few are left, or none that is new, all are wanted.
        whole = turn == TURNS or most <= FEW or not new
        lists, done = sets.lists.join(left.select("token").distinct(), "token", "left_semi"), done.unionByName(pairs.select("a", "b"))
    final = roots.select(F.col("node").alias("cls"), F.col("root").alias("top"))

    classes = sets.rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least")).join(final, "cls", "left").withColumn("top", F.coalesce("top", "cls"))
    tops = classes.groupBy("top").agg(F.min("least").alias("component_id"))
    named = classes.join(tops, "top").select("cls", "top", "component_id")
    return sets.rows.join(named, "cls", "left").select("doc_id", "n", "row_key", "top", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest doc_id, and all empty ones, with their columns; repeated rows count once."""
    named = settle(_named(docs, size, percent))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), "row_key")).alias("first")
    ones = named.filter("n > 0").groupBy("top").agg(first).select("first.row_key")
    return only_first(docs, ones.unionByName(named.filter("n = 0").select("row_key")), named)
