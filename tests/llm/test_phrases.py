"""Operator 13 against a brute-force comparison of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from storyloom.llm import phrases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """rows: (order, text) -> (n_words, n_removed, kept words)."""
    first, out = {}, {}
    texts = {d: WORD.findall(t or "") for d, t in rows}
    for d in sorted(texts):
        for k in range(len(texts[d]) - 49):
            first.setdefault(tuple(texts[d][k : k + 50]), d)
    for d, w in texts.items():
        lost = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < d for x in range(k, k + 50)}
        out[d] = (len(w), len(lost), " ".join(x for k, x in enumerate(w) if k not in lost))
    return out


def words(rnd, n, kinds=4000):
    return [rnd.choice(["w", "é", "日"]) + str(rnd.randrange(kinds)) for _ in range(n)]


def some_texts(rnd, n=90):
    """Unrelated, near and exact copies, shared passages around the least length, texts of one word, periods, other white space."""
    passages = [words(rnd, k) for k in (49, 50, 51, 70, 300)] + [["x"] * 120, ["a", "b"] * 60]
    texts = []
    for _ in range(n):
        kind = rnd.randrange(7)
        if kind == 0 and texts:
            w = list(rnd.choice(texts))
            for _ in range(rnd.randint(0, 2)):
                if w:
                    w[rnd.randrange(len(w))] = "edit" + str(rnd.randrange(99))
        elif kind == 1:
            w = ["x"] * rnd.randint(0, 300)
        else:
            w = words(rnd, rnd.choice([0, 3, 49, 50, 120]))
            for _ in range(rnd.randint(0, 3)):
                w += rnd.choice(passages)[rnd.randint(0, 3) :] + words(rnd, rnd.randint(0, 30))
        texts.append(w)
    return [rnd.choice([" ", "\n", " \t"]).join(w) for w in texts]


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, doc int, key string").repartition(parts)
    return [tuple(r) for r in phrases.dedup(df).collect()]


@pytest.mark.parametrize("bounds", [{}, {"SPLIT": 2, "PHRASES": 3, "SHARD": 300, "HELD": 20}, {"SPLIT": 1, "LONGEST": 2}])
def test_phrases_by_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(phrases, name, value)
    texts = some_texts(random.Random(31 + len(bounds)))
    rows = [(7 * k % 1000, t) for k, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n\x0b")]
    want = {(d, n, lost, hashlib.sha256(kept.encode()).hexdigest(), kept) for d, (n, lost, kept) in brute(rows).items()}
    assert sum(x[2] > 0 for x in want) > 25
    assert set(run(spark, rows)) == want


def test_phrases_of_repeated_and_null_ids(spark):
    """Rows equal in id and text are one document; other texts of an id are documents of their own, in the order of their digests; null is last."""
    rnd = random.Random(33)
    passage, other = " ".join(words(rnd, 60)), " ".join(words(rnd, 55))
    rows = [(5, passage), (5, f"{other} {passage}"), (5, passage), (None, other), (None, f"{passage} z"), (9, f"{other} {other}"), (None, None)]
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t or "") for i, t in rows})
    found = brute([(k, x[4]) for k, x in enumerate(order)])
    want = {(x[3], n, lost, hashlib.sha256(kept.encode()).hexdigest(), kept) for k, x in enumerate(order) for n, lost, kept in [found[k]]}
    got = run(spark, rows)
    assert len(got) == len(rows) and set(got) == want


def test_phrases_of_nothing(spark):
    assert run(spark, []) == []


def test_phrases_in_many_copies_of_one_passage(spark, monkeypatch):
    """A passage in every text, with other words before it, in a few contexts of one task: all but the first lose it, whatever the order of rows."""
    monkeypatch.setattr(phrases, "SPLIT", 4)
    rnd = random.Random(34)
    passage = words(rnd, 80)
    rows = [(k, " ".join([*(f"p{k}x{i}" for i in range(rnd.randint(1, 9))), *passage, f"end{k % 50}"])) for k in range(400)]
    got = {r[0]: r for r in run(spark, rows, 9)}
    assert got[0][2] == 0 and all(got[k][2] == 80 + (k >= 50) for k in range(1, 400))


def test_occurrences_are_word_by_word():
    """Automata find phrases however many there are, and not across pieces."""
    letters = np.arange(200)
    letters[150:] = letters[:50]
    place, which = phrases.occurrences(letters, np.array([100, 50, 50]), np.array([0, 30, 100]))
    assert sorted(zip(place.tolist(), which.tolist(), strict=True)) == [(0, 0), (30, 1), (100, 2), (150, 0)]
    place, which = phrases.occurrences(letters, np.array([100, 100]), np.array([], np.int64))
    assert len(place) == len(which) == 0
