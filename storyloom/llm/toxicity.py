"""Toxicity by maximum-scoring segments (operator 8).

Fit. Labelled rows with ``crc32(doc_id as text) mod 3 <> 1``, at most ``FIT_ROWS`` of them in the order of a digest of doc_id, are
joined to their texts; equal texts count once. One half (by a checksum of the text) gives features (words, and their first 4 and 5 letters, so
that unseen endings of a known stem count) a log-odds with a Dirichlet prior; features whose association with the label is significant are
kept, at most ``MAX_FEATURES``. The other half, which the features haven't seen, gives the calibration.

Score. A word scores the log-odds of its most significant feature, any other word ``DRIFT``. All maximal-scoring
segments of a text are found in one pass. Segment scores are normalised by the extreme-value law of maximal segments,
``lambda * S - ln(K * n)`` for n words, where lambda solves ``sum p(s) exp(lambda s) = 1`` over clean texts and K is
fitted to their maxima, so long texts gain nothing by length alone. Segments above ``SIGNIFICANT`` are passages; the best normalised score and
the number of passages give the document's score by a logistic curve.

Inputs of a score are the text's words alone. Null, empty and white texts score as a text without evidence. Repeated rows are scored alike.
An empty table gives no rows; empty or one-class labels give a fixed curve and no features. Very long texts are scanned whole, in linear time. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import lean, light, settle, text_of
from storyloom.llm.licenses import words_of

FIT_ROWS, MAX_FEATURES = 20_000, 50_000
PRIOR, LEAST_PRIOR, ASSOCIATION, DRIFT, SIGNIFICANT = 500.0, 0.5, 15.0, -0.5, 3.0
REJECT = 0.7
STEMS = (4, 5)
#: Words whose scores a task remembers.
MEMORY = 100_000


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3


def features(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence with these positive scores at these places and drift elsewhere."""
    # first, last, sum before, sum after, and the nearest earlier segment with a smaller sum before (Ruzzo and Tompa)
    found: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for at, s in zip(places, scores, strict=True):
        left = total + drift * (at - before - 1)
        right = left + s
        first, total, before = at, right, at
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((first, at, left, right, j))
                break
            first, left, lower = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = lower
    return [(a, b, r - x) for a, b, x, r, _ in found]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # of significant features
    ranks: dict[str, float]  # their association
    lam: float
    log_k: float
    curve: tuple[float, float, float]

    def normal(self, score: float, n: int) -> float:
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def measure(self, best: list[tuple[int, int, float]], n: int) -> tuple[float, int]:
        z = [self.normal(s, n) for _, _, s in best]
        return max(0.0, max(z, default=0.0)), sum(x > SIGNIFICANT for x in z)

    def score(self, x: float, passages: int) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, a + b * x + c * math.log1p(passages)))))


class _Words(dict):
    """Scores of words, found when they are first asked for."""

    def __init__(self, weights: dict[str, float], ranks: dict[str, float]) -> None:
        self.weights, self.ranks = weights, ranks

    def __missing__(self, word: bytes) -> float:
        known = [f for f in features(word.decode("utf-8", "surrogatepass")) if f in self.weights]
        if len(self) >= MEMORY:
            self.clear()
        self[word] = s = self.weights[max(known, key=self.ranks.__getitem__)] if known else 0.0
        return s


def evidence(text: str, scores: _Words) -> tuple[int, list[int], list[float]]:
    """Number of words, places of the scoring ones, their scores."""
    words = words_of(text)
    s = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(s)
    return len(words), at.tolist(), s[at].tolist()


def training(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> DataFrame:
    """Distinct texts of at most bound labelled rows outside the held-out fold, with toxic and half."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 1)
    some = settle(known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound))  # bounded, so it may be broadcast
    rows = light(docs).select("doc_id", text_of().alias("text")).join(F.broadcast(some), "doc_id")
    return settle(rows.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("half", (F.crc32(F.encode("text", "utf-8")) % 2).cast("int")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic > 0].update({f for w in set(words_of(text)) for f in features(w.decode("utf-8", "surrogatepass"))})
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "t": pa.array([counts[1][x] for x in part], pa.int64()), "c": pa.array([counts[0][x] for x in part], pa.int64())})


def log_odds(counts: DataFrame, limit: int = MAX_FEATURES) -> list[tuple[str, float, float]]:
    """Features (feature, t, c) that speak for the label, with log-odds and association; at most limit of them come to the driver."""
    nt, nc = (float(x or 0) for x in counts.agg(F.sum("t"), F.sum("c")).first())
    if not nt or not nc:
        return []
    t, c, n = F.col("t").cast("double"), F.col("c").cast("double"), nt + nc
    alpha = F.greatest(F.lit(LEAST_PRIOR), (t + c) / n * PRIOR)
    delta = F.log((t + alpha) / (F.lit(nt + PRIOR) - t - alpha)) - F.log((c + alpha) / (F.lit(nc + PRIOR) - c - alpha))
    part = lambda x, share: F.when(x > 0, x * F.log(x / ((t + c) * share))).otherwise(0.0)
    g = 2 * (part(t, nt / n) + part(c, nc / n))
    rows = counts.withColumn("d", delta).withColumn("g", g).filter((F.col("d") > 0) & (F.col("g") >= ASSOCIATION)).orderBy(F.col("g").desc(), "feature").limit(limit)
    return [(r["feature"], r["d"], r["g"]) for r in rows.collect()]


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    rows = training(docs, labels, bound)
    counts = rows.filter("half = 0").select("text", "toxic").mapInArrow(lean(_count), "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    found = log_odds(settle(counts))
    weights, ranks = {f: d for f, d, _ in found}, {f: g for f, _, g in found}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each clean text the number of words and the best segment's score; of each score of a word how often clean texts have it."""
        scores, held = _Words(weights, ranks), Counter()
        for batch in batches:
            sizes, best = [], []
            for text in batch.column(0).to_pylist():
                n, at, s = evidence(text, scores)
                held.update(round(x, 3) for x in s)
                sizes.append(n)
                best.append(max((x for _, _, x in segments(at, s)), default=0.0))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.nulls(len(sizes), pa.int64())], ["n", "best", "times"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(held), pa.int64()), pa.array(list(held), pa.float64()), pa.array(list(held.values()), pa.int64())], ["n", "best", "times"])

    half = rows.filter("half = 1").select("text", "toxic")
    clean = settle(half.filter("toxic <= 0").mapInArrow(lean(look), "n long, best double, times long"))
    clean = clean.filter("n IS NOT NULL").unionByName(clean.filter("n IS NULL").groupBy("n", "best").agg(F.sum("times").alias("times"))).collect()  # at most bound rows, and a row for each score of a feature
    lam, log_k = extreme([(r["n"], r["best"]) for r in clean if r["n"] is not None], Counter({r["best"]: r["times"] for r in clean if r["n"] is None}))
    draft = Model(weights, ranks, lam, log_k, (0, 0, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Words(weights, ranks)
        for batch in batches:
            got = [draft.measure(segments(at, s), n) for n, at, s in (evidence(x, scores) for x in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x for x, _ in got], pa.float64()), pa.array([k for _, k in got], pa.int64())], ["toxic", "x", "passages"])

    seen = half.mapInArrow(lean(place), "toxic int, x double, passages long").collect()  # at most bound rows
    x = np.array([(1.0, r["x"], math.log1p(r["passages"])) for r in seen]).reshape(-1, 3)
    y = np.array([r["toxic"] > 0 for r in seen], float)
    return Model(weights, ranks, lam, log_k, logistic(x, y))


def extreme(clean: list[tuple[int, float]], positive: Counter) -> tuple[float, float]:
    """lambda and ln K of the scores of clean texts: words and best score of each, and how often each score of a word occurs."""
    total = sum(n for n, _ in clean)
    positive[5.0] += 1  # one word more than was seen, so that a corpus without any has a law too
    total += 1
    drift = total - sum(positive.values())

    def excess(lam: float) -> float:
        return sum(n * math.exp(min(700.0, lam * s)) for s, n in positive.items()) + drift * math.exp(lam * DRIFT) - total

    low, high = 1e-6, 1e-6
    while excess(high) <= 0 and high < 100:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    lam = max(high, 1e-3)
    best = [lam * s - math.log(n) for n, s in sorted(clean) if n]
    return lam, (float(np.mean(best)) if best else -6.0) - 0.5772156649


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """A curve by Newton's method; a fixed one where only one class was seen."""
    if len(y) == 0 or y.min() == y.max():
        return (-5.0, 1.0, 0.0)
    b, penalty = np.zeros(3), np.array([0.0, ridge, ridge])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, model: Model, passages: bool = True) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, and passages: (first word, last word, score) of each significant one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Words(model.weights, model.ranks)
        for batch in batches:
            out, found = [], []
            for text in batch.column(1).to_pylist():
                n, at, s = evidence(text, scores)
                best = segments(at, s)
                out.append(model.score(*model.measure(best, n)))
                found.append([{"first": a, "last": b, "score": v} for a, b, v in best if model.normal(v, n) > SIGNIFICANT])
            columns = {"doc_id": batch.column(0), "score": pa.array(out, pa.float64())}
            if passages:
                columns["passages"] = pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, score double" + ", passages array<struct<first:long,last:long,score:double>>" * passages
    rows = light(docs).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(run), schema)
    return rows.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), *(["passages"] * passages))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with their columns."""

    @F.pandas_udf("boolean")
    def clean(texts):
        import pandas as pd

        scores = _Words(model.weights, model.ranks)
        got = []
        for text in texts:
            n, at, s = evidence(text, scores)
            got.append(model.score(*model.measure(segments(at, s), n)) < REJECT)
        return pd.Series(got, dtype=bool)

    return light(docs).filter(clean(text_of()))
