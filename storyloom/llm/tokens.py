"""Words of many texts at a time, without a Python string for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_bounds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, place and size of each word ``[^\\x20\\x09-\\x0D]+`` in them, and how many words each text has. No text is null."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    letter = ~_SPACE[raw]
    edges = np.zeros(len(raw) + 1, bool)  # a text begins or ends here
    edges[at] = True
    before, after = np.concatenate([[False], letter[:-1]]), np.concatenate([letter[1:], [False]])
    first = np.flatnonzero(letter & (~before | edges[:-1]))
    size = np.flatnonzero(letter & (~after | edges[1:])) + 1 - first
    return raw, first, size, np.diff(np.searchsorted(first, at))


def words_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of the texts in order, and how many each text has."""
    raw, first, size, counts = word_bounds(texts)
    letters = raw[~_SPACE[raw]]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters)), counts


def joined(words: pa.Array, keep: np.ndarray, counts: np.ndarray) -> pa.Array:
    """For each text its words that are kept, joined by one space."""
    of = np.repeat(np.arange(len(counts)), counts)
    left = np.bincount(of[keep], minlength=len(counts))
    offsets = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, words.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
