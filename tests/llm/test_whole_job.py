"""Cases in which the operators once did less than the whole job."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import exact_dedup, graph, jaccard, licenses, mixing

from test_operators import LOW, SCHEMA, corpus, words


def shingle_set(text, size):
    w = (text or "").encode().translate(LOW).split()
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_links(rows, size, percent):
    sets = {r[0]: shingle_set(r[1], size) for r in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_near_copies_of_the_stage_link_by_five_words_at_four_fifths(spark):
    import corpus_pipeline

    rnd = random.Random(11)
    base = [f"w{rnd.random()}" for _ in range(200)]
    near = list(base)
    for k in (30, 80, 120, 170):
        near[k] = f"n{k}"
    far = list(base)
    for k in (30, 60, 90, 120, 150, 180):
        far[k] = f"f{k}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "short text")]
    assert brute_links(rows, 5, 80) == {(1, 2)} and not brute_links(rows, 3, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()} == {1, 3, 4}
    assert {r.doc_id: r.component_id for r in jaccard.join(df).collect()} == {k: k for k in (1, 2, 3, 4)}


def test_jaccard_of_other_sizes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for size, percent in ((5, 80), (2, 60)):
        least = {r[0]: r[0] for r in rows}
        links = brute_links(rows, size, percent)
        for _ in range(len(rows)):
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df, size, percent).collect()} == {r[0]: (len(shingle_set(r[1], size)), least[r[0]]) for r in rows}


def drawn(rows, d):
    """Shares of the expected tokens by the values of a dimension."""
    total = sum(r.n_tokens * r.prob for r in rows)
    return {v: sum(r.n_tokens * r.prob for r in rows if r[d] == v) / total for v in {r[d] for r in rows}}


def test_drawn_shares_meet_targets_when_cells_are_full(spark):
    sizes = {("a", "x"): 100, ("a", "y"): 200, ("b", "x"): 300, ("b", "y"): 400}
    docs = [(k * 1000 + i, "w " * 10, lang, source) for k, ((source, lang), n) in enumerate(sizes.items()) for i in range(n // 10)]
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.6, "y": 0.4}}
    rows = mixing.weigh(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), targets, budget=0.4).collect()
    assert sum(r.n_tokens * r.prob for r in rows) == pytest.approx(400, rel=1e-5) and max(r.prob for r in rows) == 1
    assert drawn(rows, "source") == pytest.approx(targets["source"], rel=1e-5)
    assert drawn(rows, "lang") == pytest.approx(targets["lang"], rel=1e-5)


def test_values_with_too_few_tokens_give_all(spark):
    docs = [(k, "w " * 10, "x", "a" if k < 5 else "b" if k < 50 else "c") for k in range(100)]
    rows = mixing.weigh(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), {"source": {"a": 0.5, "b": 0.3, "c": 0.2}}, budget=0.5).collect()
    assert drawn(rows, "source") == pytest.approx({"a": 0.1, "b": 0.54, "c": 0.36}, rel=1e-5)


def test_licenses_wrapped_over_many_lines(spark):
    grant, bsd = (licenses.TEMPLATES[k].split() for k in ("mit-grant", "bsd-grant"))
    boxed = lambda w, n: "\n".join(f" * {' '.join(w[k : k + n])} *" for k in range(0, len(w), n))
    rows = [
        (1, "Some words before.\n" + boxed(grant, 4) + "\nand after"), (2, "code and text; " + "\n\n".join(" ".join(bsd[k : k + 11]) for k in range(0, len(bsd), 11))),
        (3, "\n".join(" filler " * 4 + w for w in grant)), (4, boxed(grant[:12], 4)), (5, boxed(grant, 4) + "\nfiller" * 40 + "\n" + boxed(grant[:-1], 3)),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(got[k].labels, got[k].score) for k in (1, 2, 3, 4)] == [("mit-grant", 1.0), ("bsd-grant", 1.0), ("", 0.0), ("", 0.0)]
    assert [(b.line, b.lines, b.label) for b in got[1].blocks] == [(1, 5, "mit-grant")]
    assert [(b.line, b.lines) for b in got[5].blocks] == [(0, 5), (45, 7)] and got[5].blocks[1].containment < 1


def test_license_windows_match_plain_search():
    rnd = random.Random(12)
    known = licenses.Templates(licenses.TEMPLATES, {})
    for _ in range(300):
        label = rnd.choice(known.labels)
        t = known.at[label]
        w = [x if rnd.random() < 0.85 else b"other" for _ in range(3) for x in [*licenses.words_of(licenses.TEMPLATES[label]), *[b"gap"] * rnd.randint(0, 30)]]
        want = {i for i in range(len(w)) if len(known.sets[t] & set(w[i : i + known.window[t]])) >= known.need[t]}
        got = list(known.slide(label, w))
        assert bool(got) == bool(want) and all(b - a < known.window[t] and len(known.sets[t] & set(w[a : b + 1])) == round(part * len(known.sets[t])) >= known.need[t] for a, b, part in got)
        assert all(any(i - known.window[t] < b and a < i + known.window[t] for a, b, _ in got) for i in want)


def test_stages_tell_rows_of_one_id_apart(spark):
    """Different texts with a null id or a repeated one stay, but for copies and near copies."""
    rnd = random.Random(13)
    texts = [words(rnd, 90) for _ in range(6)]
    near = texts[0].split()
    near[40] = "changed"
    rows = [(None, t) for t in texts[:4]] + [(None, " ".join(near)), (None, texts[1]), (None, ""), (7, texts[4]), (7, texts[5]), (7, texts[2] + "  "), (7, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    copies = exact_dedup.keep_one(df)
    left = sorted(map(tuple, copies.collect()), key=str)
    assert left == sorted([(None, t) for t in (texts[0], texts[1], texts[3], " ".join(near), "")] + [(7, t) for t in (texts[4], texts[5], texts[2] + "  ")], key=str)
    apart = [tuple(r) for r in jaccard.keep_one(copies).collect()]
    assert len(apart) == 7 and len([r for r in apart if r[1] in (texts[0], " ".join(near))]) == 1 and set(apart) < set(left)


def test_links_inside_components(spark, monkeypatch):
    rnd = random.Random(14)
    base = words(rnd, 150).split()
    rows = []
    for k in range(40):
        v = list(base)
        for _ in range(rnd.randint(0, 3)):
            v[rnd.randrange(len(v))] = f"n{rnd.random()}"
        rows.append((k, " ".join(v)))
    rows += [(100 + k, words(rnd, 30)) for k in range(10)]
    first = {}
    for k, t in rows:
        first.setdefault(shingle_set(t, 3), k)
    want = {(a, b) for a, b in brute_links(rows, 3, 90) if {a, b} <= set(first.values())}
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = [(min(r.doc_a, r.doc_b), max(r.doc_a, r.doc_b)) for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(rows)


def family(rnd, n, most):
    """Copies of one text with up to so many words changed: of two of them many differ too much."""
    base = words(rnd, 120).split()
    rows = []
    for k in range(n):
        v = list(base)
        for at in rnd.sample(range(len(v)), rnd.randint(1, most)):
            v[at] = f"n{rnd.random()}"
        rows.append((k, " ".join(v)))
    return rows


def least_linked(rows, size, percent):
    least = {k: k for k, _ in rows}
    want = brute_links(rows, size, percent)
    while any(least[a] != least[b] for a, b in want):
        for a, b in want:
            least[a] = least[b] = min(least[a], least[b])
    return least


def spied(monkeypatch):
    """What each crossing of the index lists gave: whether it was whole, entries, rows."""
    seen, plain = [], jaccard.Sets.crossed

    def crossed(self, labelled, *whole):
        made = plain(self, labelled, *whole)
        seen.append((whole, labelled.count(), made.count()))
        return made

    monkeypatch.setattr(jaccard.Sets, "crossed", crossed)
    return seen


@pytest.mark.parametrize("turns", [1, 8])
def test_pairs_of_a_group_of_near_copies_grow_with_its_size(spark, monkeypatch, turns):
    """in a group that its chains leave in many components, crossed lists gave nearly all pairs of members, its size squared."""
    monkeypatch.setattr(jaccard, "TURNS", turns, raising=False)
    monkeypatch.setattr(jaccard, "SHORT", 3)
    seen = spied(monkeypatch)
    rows = family(random.Random(31), 240, 6)
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80).collect()}
    assert got == least_linked(rows, 5, 80)
    assert sum(made for _, _, made in seen) <= 6 * len(rows), seen
    assert turns > 1 or [whole for whole, _, _ in seen] == [(False,), (True,)]


@pytest.mark.parametrize("most", [100_000, 40])
def test_crossed_lists_give_each_components_nearest_pair(monkeypatch, most):
    """lists of more pairs than entries, in one block and in two, at once and in parts; whole, all of their pairs."""
    monkeypatch.setattr(jaccard, "PAIRS", most)
    rnd = np.random.default_rng(33)
    m = 90
    n, p = rnd.integers(90, 110, m), rnd.integers(0, 4, m)
    w = np.zeros((jaccard.BITS, m), np.int64)
    w[0] = rnd.integers(0, 1 << 14, m)
    token, side = np.repeat([5, 6, 7], [40, 40, 10]), rnd.integers(0, 2, m)
    j = np.where(token == 6, 1, 0)
    side[token != 6] = 0
    cls, root = rnd.permutation(m), rnd.integers(0, 9, m)
    pack = (n << (jaccard.POS_BITS + jaccard.SALT_BITS)) | (p << jaccard.SALT_BITS)
    parity = [np.ascontiguousarray(w[:, k]).tobytes() for k in range(m)]
    batch = pa.RecordBatch.from_arrays([*(pa.array(x) for x in (token, np.zeros(m, np.int64), j, side, pack, cls, root)), pa.array(parity, pa.binary())], [*jaccard.CROSSED, "parity"])
    got = {}
    for whole in (True, False):
        rows = [tuple(r.values()) for b in jaccard._crossings(80, whole)(iter([batch.slice(0, 50), batch.slice(50)])) for r in b.to_pylist()]
        got[whole] = {r[:3] for r in rows if r[3] is None}, sorted(r[2:] for r in rows if r[3] is not None)
    bits = lambda x, y: int(w[0][x] ^ w[0][y]).bit_count()
    want = {}
    for x, y in itertools.combinations(range(m), 2):
        if token[x] == token[y] and root[x] != root[y] and (token[x] != 6 or side[x] != side[y]) and jaccard.may_link(n[x], p[x], n[y], p[y], 80):
            want[min(cls[x], cls[y]), max(cls[x], cls[y]), bits(x, y)] = token[x]
    assert got[True] == (set(want), []) and len(want) > 500
    of = dict(zip(cls.tolist(), root.tolist(), strict=True))
    least = {t: {r: min((b, x, y) for (x, y, b), u in want.items() if u == t and r in (of[x], of[y])) for r in of.values() if any(u == t and r in (of[x], of[y]) for (x, y, _), u in want.items())} for t in (5, 6)}
    near = {(x, y, b) for t in (5, 6) for b, x, y in least[t].values()} | {k for k, t in want.items() if t == 7}
    assert got[False] == (near, sorted((sum(u == t for u in want.values()), t) for t in (5, 6)))


def test_turns_do_not_multiply_estimates(spark, monkeypatch):
    """each turn's table carried the estimated size of the plan that made it, a product over its joins; its digits grew by a power with the turns, and filled the driver's memory."""
    bits, plain = [], type(spark.range(1)).checkpoint

    def checkpoint(self, *args, **options):
        bits.append(int(self._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length())
        return plain(self, *args, **options)

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", checkpoint)
    monkeypatch.setattr(graph, "LOCAL", 2)
    rnd = random.Random(32)
    nodes = rnd.sample(range(10_000), 600)
    edges = [(a, b) for k in (0, 200) for a, b in itertools.pairwise(nodes[k : k + 200])] + list(itertools.pairwise(nodes[400:402]))
    rnd.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    assert got == {n: min(group) for group in (nodes[:200], nodes[200:400], nodes[400:402]) for n in group}
    assert len(bits) > 4 and max(bits) < 1000, bits
