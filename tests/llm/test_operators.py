"""Operators against brute force on small fixtures, with the hard cases: nulls, empties, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from storyloom.llm import chat, exact_dedup, graph, jaccard, licenses, mixing, packing, quality, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row_id long, _text string"


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))


def corpus(seed=1):
    """Texts with copies, near copies, shared passages, and the hard cases."""
    rnd = random.Random(seed)
    texts = [words(rnd, rnd.randint(1, 120)) for _ in range(60)]
    for t in texts[:15]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            v[rnd.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    passage = words(rnd, 60)
    texts += [f"{words(rnd, 20)} {passage}\n{words(rnd, 10)}" for _ in range(6)]
    texts += [texts[3]] * 5 + [texts[3].replace(" ", "\n"), texts[3].upper(), "", " \n ", None, None, "one", "one", "Two words", "ab " * 200, "x" * 700, "é" * 150, words(rnd, 4000)]
    return [(k * 7 % 1000, t, ("en", "de", None)[k % 3], f"src{k % 4}" if k % 11 else None, None, "x", 5, "y") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


def test_exact_dedup(docs):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r[1])].append(r)
    want = {}
    for g in groups.values():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        for r in g:
            want[r[0]] = (keep, len(g), r[0] == keep, hashlib.sha256(strip(r[1]).encode()).hexdigest())
    for counters in (1, 4096):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(docs, counters).collect()}
        assert got == want


def test_exact_dedup_repeated_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "ab"), (None, "c"), (2, "a  b")]
    got = exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in got) == [(False, 4, False), (False, 4, False), (False, 4, False), (False, 4, True), (True, 1, True)]
    kept = exact_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == [(2, "a  b"), (None, "c")] or sorted((r.doc_id or 0) for r in kept) == [0, 2]


LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(t, size=3):
    w = (t or "").encode().translate(LOW).split()
    return frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size=3, percent=90):
    sets = {r[0]: shingle_set(r[1], size) for r in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard(docs):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == brute_components(corpus())


def test_jaccard_blocks(spark, monkeypatch):
    """A group of near copies that is split, salted and paired in blocks."""
    rnd = random.Random(5)
    base = words(rnd, 150).split()
    rows = []
    for k in range(80):
        v = list(base)
        for _ in range(rnd.randint(0, 5)):
            v[rnd.randrange(len(v))] = f"n{rnd.random()}"
        rows.append((k, " ".join(v)))
    rows += [(100 + k, words(rnd, 30)) for k in range(20)]
    monkeypatch.setattr(jaccard, "SALT", 4)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "CHAINS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()} == brute_components(rows)


def test_cross_pairs_match_plain_filter():
    rnd = np.random.default_rng(3)
    m = 300
    n, p = rnd.integers(90, 130, m), rnd.integers(0, 12, m)
    cls, root, side = rnd.permutation(m), rnd.integers(0, 4, m), rnd.integers(0, 2, m)
    w = np.zeros((jaccard.BITS, m), np.int64)
    for both in (False, True):
        got = {tuple(x) for part in jaccard.cross_pairs(n, p, cls, root, side, w, both) for x in part.tolist()}
        want = {(int(min(cls[i], cls[j])), int(max(cls[i], cls[j]))) for i, j in itertools.combinations(range(m), 2) if root[i] != root[j] and (not both or side[i] != side[j]) and jaccard.may_link(n[i], p[i], n[j], p[j])}
        assert got == want


@pytest.mark.parametrize("local", [400_000, 10])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL", local)
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)] + [(rnd.randint(2000, 2100), rnd.randint(2000, 2100)) for _ in range(60)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    assert got == {x: root(x) for x in up}


def test_quality(docs):
    for r in quality.judge(quality.ledger(docs)).collect():
        t = next(x[1] for x in corpus() if x[0] == r.doc_id) or ""
        w = t.encode().split()
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        held = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), len(strip(t)), len(held), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t)
        assert r.base_failed == (len(w) < 10 or 100 * len(held) > 20 * len(w))
        assert not (r.kept and r.base_failed)


def test_ablations(docs):
    found = {r.rule: (r.n_failed, r.n_admitted_without) for r in quality.ablations(quality.ledger(docs)).collect()}
    assert set(found) == {n for n, _ in quality.RULES}
    assert all(b <= a for a, b in found.values())


def test_licenses(spark):
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, None), (3, "apache, LICENSE apache license"), (4, "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and documentation files"),
        (5, "mit licenses"), (6, "gnu general public gnu general public license"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels) == (1, 5, "mit") and "mit-notice" in got[1].labels
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].score) == (0, 0, None, 0.0)
    assert (got[3].n_base, got[3].first_word, got[3].last_word) == (2, 0, 2)
    assert got[4].labels == "mit-grant" and 0.8 <= got[4].score <= 1
    assert got[5].labels == "" and (got[6].first_word, got[6].n_base) == (3, 1)


def test_licence_filters_lose_nothing():
    rnd = random.Random(4)
    pool = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words_of(t)})
    known = licenses.Templates(licenses.TEMPLATES, {w.decode(): rnd.randint(0, 99) for w in pool})
    for _ in range(400):
        block = set(rnd.sample(pool, rnd.randint(0, 40))) | set(sorted(rnd.choice(known.sets))[:6])
        want = {k for k, s, n in zip(known.labels, known.sets, known.need, strict=True) if len(s & block) >= n}
        assert {k for k, _ in known.match(block)} == want


def test_sharding(docs):
    rows = corpus()
    got = sharding.shard(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert len(got) == len(rows) and set(by) == set(range(40))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    ordered = [r.place for _, v in sorted(by.items()) for r in sorted(v, key=lambda r: r.slot)]
    assert ordered == sorted(ordered)
    text = {r[0]: (r[1] or "").encode() for r in rows}
    assert all((r.size, r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id])) for r in got)


def test_hilbert_curve_visits_neighbours():
    at = np.array(list(itertools.product(range(8), repeat=3)))
    order = np.argsort(sharding.hilbert(at, 3))
    assert sorted(sharding.hilbert(at, 3)) == list(range(512))
    assert (np.abs(np.diff(at[order], axis=0)).sum(axis=1) == 1).all()


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def spans_of(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup(df, False).collect()}


def test_suffix_dedup(docs):
    assert spans_of(docs) == brute_repeats([(r[0], r[1]) for r in corpus()])


def test_suffix_dedup_split_anchors(spark, monkeypatch):
    """A passage in many texts, whose ends are more contexts than one shard takes."""
    rnd = random.Random(8)
    passage = words(rnd, 50)
    rows = [(k, f"{words(rnd, rnd.randint(0, 25))} {passage} {words(rnd, rnd.randint(0, 25))}") for k in range(60)] + [(90, "ab" * 900), (91, "ba" * 300)]
    monkeypatch.setattr(suffix_dedup, "SPLIT", 3)
    monkeypatch.setattr(suffix_dedup, "SHARD", 2000)
    assert spans_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_repeats(rows)


def test_suffix_array_and_common_prefixes():
    rnd = random.Random(3)
    for text in (b"a", b"\0\0\0", b"banana" * 30, bytes(rnd.choice(b"ab") for _ in range(2000)), bytes(rnd.randrange(256) for _ in range(500))):
        t = np.frombuffer(text, np.uint8)
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        lcp = suffix_dedup.common_prefixes(t, sa, np.arange(0, len(t), 37))
        same = lambda a, b: next((k for k in range(100) if a[k : k + 1] != b[k : k + 1] or not a[k : k + 1]), 100)
        assert lcp[1:].tolist() == [same(text[a:], text[b:]) for a, b in itertools.pairwise(sa.tolist())]


def test_maximal_segments():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(0, 14)
        s = [rnd.choice([0, 0, 1.3, 2.1]) for _ in range(n)]
        got = toxicity.segments([k for k in range(n) if s[k]], [x for x in s if x])
        full = [x or toxicity.DRIFT for x in s]
        best = max((sum(full[a:b]) for a in range(n) for b in range(a + 1, n + 1)), default=0)
        assert max((x for _, _, x in got), default=0) == pytest.approx(max(best, 0))
        assert all(x == pytest.approx(sum(full[a : b + 1])) for a, b, x in got)
        assert all(b < c for (_, b, _), (c, _, _) in itertools.pairwise(got))


def toxic_corpus(n=900):
    rnd = random.Random(9)
    common, bad = [words(rnd, 1) for _ in range(60)], ["vileone", "viletwo", "vilethree", "grim"]
    rows, labels = [], []
    for k in range(n):
        t = [rnd.choice(common) for _ in range(rnd.randint(3, 60))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(2):
                t.insert(rnd.randrange(len(t)), rnd.choice(bad))
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {k: y for k, _, y in labels}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(held)) for k in truth)
    right = sum(got[k].predicted == truth[k] for k in held) / len(held)
    assert right > 0.95 and got[5000].predicted == got[5001].predicted == 0
    found = next(got[k] for k in held if truth[k] and got[k].predicted)
    w = rows[found.doc_id][1].split()
    assert found.passages and all(any(x.startswith(("vile", "grim")) for x in w[p["first"] : p["last"] + 1]) for p in found.passages)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {k for k, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1, None), (None, 1, 1)], [(2, 1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


def legal(roles):
    r = roles[1:] if roles[:1] == ["system"] else roles
    return bool(r) and len(r) % 2 == 0 and all(x == ("user", "assistant")[k % 2] for k, x in enumerate(r))


def cheapest(roles):
    """By search over all ways."""
    best = {(chat.START): 0}
    for role in roles:
        new = {}
        for s, c in best.items():
            for a, b, cost, *_ in chat.steps(role if role in chat.ROLES else None):
                if a == s:
                    new[b] = min(new.get(b, 10**9), c + cost)
        best = new
    return min(c + chat.INSERT * len(chat.PATHS[s, chat.ASSISTANT]) for s, c in best.items() if (s, chat.ASSISTANT) in chat.PATHS)


COST = {"keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE, "merge_relabel": chat.MERGE + chat.RELABEL, "insert": chat.INSERT, "end": 0}


@pytest.mark.parametrize("parts", [1, 7])
def test_chat(spark, parts, monkeypatch):
    monkeypatch.setattr(chat, "n_partitions", lambda df: parts)
    rnd = random.Random(7)
    rows = [(c, k, rnd.choice(["system", "user", "assistant", "user", "assistant", None, "bot"]), rnd.choice(["hi", "", None, "ok"])) for c in (*range(12), None) for k in range(rnd.randint(1, 9))]
    rows += [(50, k, rnd.choice(["user", "assistant", "tool"]), "x") for k in range(120)]
    got = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id].append(r)
    assert set(got) == {r[0] for r in rows}
    for c, out in got.items():
        out.sort(key=lambda r: r.seq)
        turns = dict(sorted((r.out_turn, r.repaired_role) for r in out if r.action != "end"))
        assert legal([turns[k] for k in sorted(turns)]) and sorted(turns) == list(range(len(turns)))
        assert sum(COST[r.action] for r in out) == cheapest([r[2] for r in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])])
        said = "".join(r.rendered for r in out)
        assert said.count("<|end|>") == len(turns) and said.startswith("<|") and said.endswith("<|end|>\n")


def test_packing(docs):
    rows = corpus()
    tok = packing.Encoder(packing.default_tokenizer()).tokenizer
    got = packing.pack(docs).collect()
    by, ids = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
        ids[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    for v in by.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, t, *_ in rows:
        want = tok.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted(ids[i], key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)


def test_encoder_matches_whole_texts():
    rnd = random.Random(1)
    texts = ["", "It's 'S they'LL 3.5, x..", "A.\x1cB", "É.È, ", "ß.", "İ Σας ΣΑΣ", "<|endoftext|>hi <|ENDOFTEXT|>", "x\xa0y\x85z.", "...,,, .."]
    texts += ["".join(rnd.choice("aAéÉ'.,sStT \n\t3²½ªµ÷×ßÿ|<>-_Σ\xa0\x85\x1c日́") for _ in range(rnd.randint(0, 30))) for _ in range(500)]
    e = packing.Encoder(packing.default_tokenizer())
    flat, n = e.encode(texts, 1)
    for t, got in zip(texts, np.split(flat, np.cumsum(n)[:-1]), strict=True):
        assert got.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_differencing():
    rnd = random.Random(2)
    for m in (1, 2, 5, 20):
        sizes = [rnd.randint(1, 700) for _ in range(4 * m)]
        parts = packing.difference(sizes, m)
        assert sorted(i for p in parts for i in p) == list(range(len(sizes))) and len(parts) <= m
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 700
    items = [1100] * 9
    windows = packing.fill(items)
    assert sum(n for w in windows for _, _, n in w) == sum(items) and all(sum(n for *_, n in w) <= 2048 for w in windows)


def test_mixing(docs):
    rows = mixing.weigh(docs, {"lang": {"en": 3, "de": 1}}, budget=0.3).collect()
    assert len(rows) == len(corpus())
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.prob for r in rows) == pytest.approx(0.3 * total, rel=1e-6)
    assert all(r.prob == 0 for r in rows if r.lang == mixing.NONE)
    got = {r.doc_id for r in mixing.sample(docs, {"lang": {"en": 3, "de": 1}}, budget=0.3).collect()}
    assert got == {r.doc_id for r in rows if r.sampled}


def test_raking_meets_targets(spark):
    rnd = random.Random(3)
    cells = spark.createDataFrame([(s, g, t, rnd.randint(1, 900)) for s in "abc" for g in "xy" for t in "pq"], "source string, lang string, topic string, tokens long")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.9, "q": 0.1}}
    out = mixing.rake(cells, want, rounds=30).collect()
    total = sum(r.tokens for r in out)
    for d, shares in want.items():
        for v, share in shares.items():
            assert sum(r.weight for r in out if r[d] == v) == pytest.approx(share * total, rel=1e-6)


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (mixing.weigh(none), exact_dedup.dedup(none), jaccard.join(none), quality.judge(quality.ledger(none)), licenses.scan(none), sharding.shard(none), suffix_dedup.dedup(none), toxicity.score(none, toxicity.fit(none, labels)), packing.pack(none)):
        assert df.count() == 0
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stages_keep_columns(docs, none, spark, tmp_path):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, none):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.columns == table.columns
            now = spark.createDataFrame(out.collect(), SCHEMA)
        assert now.count() <= table.count()


def test_pipeline(docs, spark, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[strip(r[1])].append(r)
    left = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    named = brute_components(left, 5, 80)  # the stage's rule: five words, four fifths
    left = [r for r in left if named[r[0]][1] == r[0]]
    drawn = {r.doc_id for r in mixing.weigh(spark.createDataFrame(left, SCHEMA)).collect() if r.sampled}
    assert {r.doc_id for r in got} == drawn
