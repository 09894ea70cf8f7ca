"""Packing documents into token windows by multiway Karmarkar-Karp differencing (operator 10).

Texts become token ids by a public tokenizer, and a closing id ends each document. Documents of a window and more are
cut at its multiples, and what is left of them in pieces of a quarter of a window at most. These go, with others of the partition, into as few
windows as their tokens need: differencing merges the two partial partitions of the largest spread, largest sums against smallest, until one
is left, which gives windows of nearly equal sums. As long as one exceeds the capacity, the window count rises and differencing begins anew;
sums of such short pieces lie so near to each other that a few windows in a thousand are enough. Pieces of a document that meet again in a window
are one piece. Nothing is shuffled: each task packs the rows it reads, ``GROUP`` windows at a time, so memory and padding are bounded at any size of input.

Null and empty texts have the closing id alone. Repeated rows and null doc_ids are packed like others. An empty table gives no rows.
Sequence ids are the partition's number in the high bits and a counter in the low 33.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import lean, light, text_of

CAPACITY = 2048
#: Windows that are packed at a time.
GROUP = 256
#: Rests longer than this part of a window are cut before differencing, so that sums come near to each other.
CUT = 4
#: Different words that are encoded as one text.
WORDS = 5000
#: Characters of text that are encoded at a time.
SLICE = 6_000_000

#: The parts of a tokenizer file under which a chunk between white space may be encoded by itself, in lower case, and the ends of words be told by "</w>".
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: How byte-level models write bytes: printable ones of Latin-1 as themselves, the others, in order, from U+0100 on; here the space stays.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTES = {b: b if b in _SHOWN else 0x100 + sum(x not in _SHOWN for x in range(b)) for b in range(256)} | {0x20: 0x20}
# End of fixed values.


class Encoder:
    """Token ids of texts, as ``tokenizers`` gives them for whole texts.

    Of a tokenizer file that cuts at white space, lowers letters and marks the ends of words (``NORMALIZER``, ``SPLITTER``), each different
    chunk between white space is encoded once for each ``SLICE`` of text: words of letters as one text of them, without the marks after them. Only one slice's words are remembered, for the next.
    With any other file, and for texts with a special token's name or with U+001C to U+001F, which not all take for white space, whole texts are encoded.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model = known["model"]
        self.cuts = known.get("normalizer") == NORMALIZER and known.get("pre_tokenizer") == SPLITTER and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not known.get("truncation") and not known.get("padding")
        # Special tokens are found before anything is lowered or cut; odd() knows those that begin with "<|".
        self.cuts = self.cuts and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in known["added_tokens"])
        self.ends = np.zeros(0, bool)
        self.before = pa.array([], pa.large_string()), pa.array([], pa.large_list(pa.uint32()))
        if self.cuts:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[n for t, n in model["vocab"].items() if t.endswith("</w>")]] = True
            # The same model without what lowers and cuts texts, for words of lower Latin letters.
            self.merger = Tokenizer.from_str(json.dumps(known | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}}))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    @staticmethod
    def plain(text: str) -> str:
        """A text with the same ids and fewer different chunks: the tokenizer lowers its letters too, and of Latin letters as Python does."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
        return text.lower()

    def odd(self, text: str) -> bool:
        """Whether a text must be encoded whole."""
        return not self.cuts or any(x in text for x in ("<|", "\x1c", "\x1d", "\x1e", "\x1f"))

    def encode(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by last; how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        odd = {k: self.whole(t) for k, t in enumerate(texts) if self.odd(t)}
        split = pc.utf8_split_whitespace(pa.array(["" if k in odd else self.plain(t) for k, t in enumerate(texts)], pa.large_string()))
        offsets, chunks = split.offsets.to_numpy(), split.values.dictionary_encode()
        del split
        ids, sizes = self.look_up(chunks.dictionary)
        known = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids))
        flat = known.take(chunks.indices).values.to_numpy()
        ends = np.cumsum(sizes[chunks.indices.to_numpy()])
        bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        counts = np.diff(bounds)
        if odd:
            parts = np.split(flat, bounds[1:-1])
            for k, own in odd.items():
                parts[k], counts[k] = own, len(own)
            flat = np.concatenate(parts)
        return np.insert(flat, np.cumsum(counts), np.uint32(last)), counts + 1

    def look_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different chunks one after the other, and how many each has. A chunk of letters, and of marks after these, is two units; any other is one."""
        words = pc.utf8_rtrim(chunks, characters=MARKS)
        plain = pc.and_(pc.utf8_is_alpha(words), pc.match_substring_regex(words, r"^[\x{00}-\x{FF}]*$"))
        of_letters = plain.to_numpy(zero_copy_only=False)
        words = words.filter(plain).dictionary_encode()
        marks = pc.replace_substring_regex(chunks.filter(plain), r"^\pL+", "").dictionary_encode()
        others = chunks.filter(pc.invert(plain)).to_pylist()
        units = [self.known(words.dictionary), self.of_each(marks.dictionary.to_pylist()), self.of_each([*others, ""])]
        sizes = np.concatenate([x[1] for x in units])
        n, m = len(units[0][1]), len(units[1][1])
        pairs = np.full((len(chunks), 2), len(sizes) - 1)  # the last unit is empty
        pairs[of_letters, 0], pairs[of_letters, 1] = words.indices.to_numpy(), n + marks.indices.to_numpy()
        pairs[~of_letters, 0] = n + m + np.arange(len(others))
        known = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.concatenate([x[0] for x in units])))
        return known.take(pa.array(pairs.ravel())).flatten().to_numpy(), sizes[pairs].sum(axis=1)

    def known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of different words of Latin letters: those that the slice before had too aren't encoded again."""
        before, lists = self.before
        at = pc.index_in(words, value_set=before)
        new = pc.is_null(at)
        ids, sizes = self.of_words(words.filter(new).to_pylist())
        fresh = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids, pa.uint32()))
        place = np.where(new.to_numpy(zero_copy_only=False), len(before) + np.cumsum(new.to_numpy(zero_copy_only=False)) - 1, pc.fill_null(at, 0).to_numpy())
        lists = pa.concat_arrays([lists, fresh]).take(pa.array(place))
        self.before = words, lists
        return lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of words of Latin letters: many are encoded as one text."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), WORDS):
            text = " ".join(words[at : at + WORDS]).lower().encode("utf-8").decode("latin-1").translate(BYTES)
            ids.append(np.array(self.merger.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
            sizes.append(np.diff(np.flatnonzero(self.ends[ids[-1]]), prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def of_each(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), WORDS):
            got = [x.ids for x in self.tokenizer.encode_batch_fast(chunks[at : at + WORDS], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of sizes in m parts of nearly equal sums, by Karmarkar-Karp differencing."""
    left: list[int] = []
    right: list[int] = []
    # A partial partition: its sums that aren't zero, largest first, and for each the node that holds its members.
    heap = [(-int(s), k, np.array([s], np.int64), np.array([k], np.int64)) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(sizes)
    while len(heap) > 1:
        _, k, a, p = heapq.heappop(heap)
        _, _, b, q = heapq.heappop(heap)
        meet = max(0, len(a) + len(b) - m)  # that many of the smallest of a take the smallest of b, in opposite order
        if meet:
            # With zeros added, place i of a meets place m - 1 - i of b.
            x, y = a[len(a) - meet :], b[len(b) - meet :][::-1]
            new = np.arange(n + len(left), n + len(left) + meet)
            left += p[len(a) - meet :].tolist()
            right += q[len(b) - meet :][::-1].tolist()
            sums = np.concatenate([a[: len(a) - meet], b[: len(b) - meet], x + y])
            nodes = np.concatenate([p[: len(a) - meet], q[: len(b) - meet], new])
        else:
            sums, nodes = np.concatenate([a, b]), np.concatenate([p, q])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = sums[0] - (sums[-1] if len(sums) == m else 0)
        heapq.heappush(heap, (-int(spread), k, sums, nodes))
    parts = []
    for node in heap[0][3].tolist() if heap else []:
        stack, members = [node], []
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack += [left[x - n], right[x - n]]
        parts.append(sorted(members))
    return parts


def fill(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length), for items shorter than a window; the window count rises until no sum exceeds the capacity."""
    most = max(1, capacity // CUT)
    pieces = [(i, at, min(most, n - at)) for i, n in enumerate(lengths) for at in range(0, n, most)]
    sizes = [p[2] for p in pieces]
    m = max(1, -(-sum(sizes) // capacity))
    while sizes:
        parts = difference(sizes, m)
        if max(sum(sizes[k] for k in p) for p in parts) <= capacity:
            break
        m += 1
    windows = []
    for p in parts if sizes else ():
        window: list[tuple[int, int, int]] = []
        for i, start, n in sorted(pieces[k] for k in p):
            if window and window[-1][0] == i and window[-1][1] + window[-1][2] == start:  # pieces that meet again
                start, n = window[-1][1], window.pop()[2] + n
            window.append((i, start, n))
        windows.append(window)
    return windows


def _packer(path: str, last: int, capacity: int, group: int, ids_too: bool):
    def pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        coder = encoder(path)
        docs: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows: list[tuple] = []  # doc, start, length, sequence, offset
            rests: list[tuple[int, int, int]] = []
            for d, (_, ids) in enumerate(docs):
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    rows.append((d, at, capacity, sequence, 0))
                    sequence += 1
                if len(ids) > whole:
                    rests.append((d, whole, len(ids) - whole))
            for window in fill([n for _, _, n in rests], capacity) if rests else ():
                at = 0
                for i, start, n in window:
                    d, base, _ = rests[i]
                    rows.append((d, base + start, n, sequence, at))
                    at += n
                sequence += 1
            pieces = [np.ascontiguousarray(docs[d][1][s : s + n], "<u4") for d, s, n, _, _ in rows]
            out = {
                "doc_id": pa.array([docs[r[0]][0] for r in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                "doc_tokens": pa.array([len(docs[r[0]][1]) for r in rows], pa.int64()),
                "sequence_id": pa.array([r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
            if ids_too:
                out["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
            docs.clear()
            return pa.RecordBatch.from_pydict(out)

        names: list[int | None] = []
        texts: list[str] = []
        waiting = 0

        def take() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            flat, counts = coder.encode(texts, last)
            for name, ids in zip(names, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
                docs.append((name, ids))
                held += len(ids)
                if held >= group * capacity:
                    yield flush()
                    held = 0
            names.clear()
            texts.clear()
            waiting = 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                texts.append(text)
                waiting += len(text)
                if waiting >= SLICE:
                    yield from take()
        if texts:
            yield from take()
        if docs:
            yield flush()

    return pack_batches


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, tokenizer: str | None = None, last: int = 1, capacity: int = CAPACITY, group: int = GROUP, ids: bool = True) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids themselves if wanted.

    tokenizer: path of any ``tokenizers`` file, the same on all machines; see :class:`Encoder` for those that are quick.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids
    rows = light(docs).select(F.col("doc_id").cast("long"), text_of().alias("text"))
    return rows.mapInArrow(lean(_packer(tokenizer or default_tokenizer(), last, capacity, group, ids)), schema)
