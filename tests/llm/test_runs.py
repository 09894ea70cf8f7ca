"""Operator 12 against a brute-force search for periods, and the query's digests against their plain form."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from storyloom.llm import runs


def brute(words, least=6, power=4):
    """Maximal stretches for every period, without those that have a smaller one."""
    n, out = len(words), set()
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q):
                s = words[i : i + length]
                if not any(s[d:] == s[:-d] for d in range(1, q)):
                    out.add((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rnd):
    n = rnd.choice([0, 1, 5, 6, 7, 24, rnd.randint(0, 90)])
    words = [rnd.randrange(rnd.choice([1, 2, 3, 9, 50])) for _ in range(n)]
    if n and rnd.random() < 0.7:
        a = rnd.randrange(n)
        p = rnd.randint(1, max(1, (n - a) // 3))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        words += words[: rnd.choice([0, 0, n])]
    return words


@pytest.mark.parametrize(("least", "power"), [(6, 4), (1, 4), (12, 5)])
def test_runs_by_brute_force(least, power):
    rnd = random.Random(12)
    for _ in range(150):
        texts = [some_words(rnd) for _ in range(rnd.randint(1, 7))]
        counts = np.array([len(t) for t in texts])
        got = [[] for _ in texts]
        for text, *run in zip(*(x.tolist() for x in runs.find_runs(np.array(sum(texts, []), np.int64), counts, least, power)), strict=True):
            got[text].append(tuple(run))
        assert got == [brute(t, least, power) for t in texts]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = brute(words)
    dropped = {k for start, length, period in found for k in range(start + period, start + length)}
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), start, length, period, 1000 * length // period if found else None,
        sha("".join("{},{},{}\n".format(*r) for r in found)), sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def test_runs_query(spark, monkeypatch):
    """Nulls, white texts, other spaces, repeated rows, clashing names, a text longer than a slice."""
    rnd = random.Random(13)
    letters = ["a", "b", "é", "c d", "\x00", "日本", "퟿"]
    texts = [" ".join(letters[w % 7] for w in some_words(rnd)) for _ in range(150)]
    texts += [None, "", " \t\n\x0b\x0c\r ", "x", "a " * 400, "    " * 9, "ab ba " * 50 + "ab " * 9, "\n a\ta a  a a a\r\n"]
    rows = [(k if k % 11 else None, t, "x", 1) for k, t in enumerate(texts)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _h int").repartition(3)
    want = sorted((expected(i, t) for i, t, *_ in rows), key=str)
    assert sum(r[1] > 0 for r in want) > 15 and sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5
    for size in (runs.SLICE, 7):
        monkeypatch.setattr(runs, "SLICE", size)
        assert sorted((tuple(r) for r in runs.digests(runs.find(runs.with_periods(docs))).collect()), key=str) == want
    got = runs.find(docs).where("doc_id = 154").first()
    assert got.n_words == 400 and [tuple(r) for r in got.runs] == [(0, 400, 1)] and got.collapsed == "a"


def test_runs_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert runs.digests(runs.find(runs.with_periods(empty))).collect() == []
    named = spark.createDataFrame([("a", "x " * 9)], "doc_id string, text string")
    assert [(r.doc_id, r.n_words) for r in runs.find(named).collect()] == [("a", 9)]


def test_runs_of_long_texts():
    """A long periodic text settles early; one whose periods are long is refined length by length."""
    rnd = np.random.default_rng(14)
    for n, period in ((200_000, 9), (20_000, 4_000)):
        words = rnd.integers(0, 500, n)
        start = n // 10
        words[start:] = words[start + np.arange(n - start) % period]
        found = [x.tolist() for x in runs.find_runs(words, np.array([n]))]
        assert found == [[0], [start - int(words[start - 1] == words[start - 1 + period])], [n - start + int(words[start - 1] == words[start - 1 + period])], [period]]
