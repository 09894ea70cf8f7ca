"""Hard cases of single operators: repeated and null ids, lists that are cut, clashing names, other tokenizers."""

import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from storyloom.llm import exact_dedup, jaccard, licenses, mixing, packing, sharding, suffix_dedup, toxicity

from test_operators import LOW, brute_repeats, words
from test_whole_job import brute_links, shingle_set


def test_suffix_dedup_tells_texts_of_one_id_apart(spark):
    """Null and repeated ids: different texts are documents of their own, ordered by digest within an id; equal rows are one document."""
    rnd = random.Random(21)
    passage = words(rnd, 50)
    rows = [(7, f"{words(rnd, 12)} {passage}"), (7, words(rnd, 60)), (7, f"{passage} {words(rnd, 9)}"), (None, words(rnd, 70)), (None, f"{words(rnd, 5)} {passage}"), (None, None), (None, ""), (3, words(rnd, 40)), (3, f"x {passage}")]
    rows += [rows[0], rows[4]]
    order = sorted({(i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), i, t or "") for i, t in rows})
    want = brute_repeats([(k, x[4]) for k, x in enumerate(order)])
    want = {(x[3], *want[k]) for k, x in enumerate(order)}
    got = [tuple(r) for r in suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), False).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_padding_is_bounded():
    """Windows beyond the least are few, whatever the lengths."""
    rnd = random.Random(22)
    for lengths in ([rnd.randint(1, 2047) for _ in range(500)], [1100] * 300, [2047] * 200, [1] * 5000, [700] * 90 + [3] * 40, [1]):
        windows = packing.fill(lengths)
        assert all(sum(n for *_, n in w) <= 2048 for w in windows)
        held = sorted((i, start, n) for w in windows for i, start, n in w)
        assert sum(n for *_, n in held) == sum(lengths) and all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in zip(held, held[1:]))
        least = -(-sum(lengths) // 2048)
        assert len(windows) <= least + 2 + least // 50


@pytest.mark.parametrize("change", ["case", "whole word", "none"])
def test_encoder_of_other_tokenizers(tmp_path, change):
    """A tokenizer that the short way isn't right for is asked for whole texts."""
    with open(packing.default_tokenizer(), encoding="utf-8") as file:
        known = json.load(file)
    if change == "case":
        known["normalizer"]["normalizers"].pop()
    if change == "whole word":
        known["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, known["pre_tokenizer"]["pretokenizers"][1]]}
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(known), encoding="utf-8")
    coder = packing.Encoder(str(path))
    assert coder.cuts == (change == "none")
    texts = ["Hello. HELLO, hello", "", "A.b, C.", "x"]
    flat, n = coder.encode(texts, 1)
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_encoder_of_few_words_at_a_time(monkeypatch):
    """However many words are encoded as one text, ids are the same."""
    monkeypatch.setattr(packing, "WORDS", 5)
    rnd = random.Random(23)
    coder = packing.Encoder(packing.default_tokenizer())
    for _ in range(30):
        texts = [words(rnd, rnd.randint(0, 9)) + rnd.choice(["", ".", ",", " a,", " 7."]) for _ in range(4)]
        flat, n = coder.encode(texts, 1)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [[*coder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def entries_of(lists):
    """Rows as jaccard._chains gets them; lists: key and the classes of each."""
    rows = [(key, 100 << (jaccard.POS_BITS + jaccard.SALT_BITS), c) for key, classes in sorted(lists) for c in classes]
    return [
        pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows[at : at + 7]], pa.int64()) for k in range(3)), pa.nulls(len(rows[at : at + 7]), pa.int64()), pa.nulls(len(rows[at : at + 7]), pa.binary())], jaccard.MADE)
        for at in range(0, len(rows), 7)
    ]


@pytest.mark.parametrize("most", [3, 10, 1000])
def test_lists_that_are_cut_keep_their_entries(monkeypatch, most):
    """Lists at any place of a full buffer: the entries of those of several classes are all returned, and neighbours form a chain."""
    monkeypatch.setattr(jaccard, "HELD", most)
    rnd = random.Random(24)
    lists = [(5, list(range(1, 10))), (6, [1, 2]), (7, [3]), (8, [4] * 12), (9, [4] * 11 + [5]), (10, list(range(40))), (11, [7, 8]), (12, [9] * 9 + [1] * 9)]
    lists += [(100 + k, rnd.sample(range(30), rnd.randint(1, 13))) for k in range(60)]
    out = [r for b in jaccard._chains(90)(iter(entries_of(lists))) for r in b.to_pylist()]
    assert {(r["b"], r["a"]) for r in out if r["kind"] == jaccard.ENTRY} == {(key, c) for key, classes in lists if len(set(classes)) > 1 for c in classes}
    pairs = {(r["a"], r["b"]) for r in out if r["kind"] == jaccard.PAIR}
    for _, classes in lists:
        near = {c: {c} for c in classes}
        for a, b in pairs:
            if a in near and b in near:
                both = near[a] | near[b]
                for c in both:
                    near[c] = both
        assert all(len(x) == len(near) for x in near.values())


def test_word_digests_tell_words_apart():
    """Words of all lengths, at all places of a text, and texts that end in all ways."""
    rnd = random.Random(25)
    pool = ["", " ", "a", "ab", "\u00e9", "x" * 7, "x" * 8, "x" * 9, "x" * 15, "x" * 16, "x" * 17, "x" * 256, "x" * 257, "x" * 300, "x" * 299 + "y", "\0", "a\0", "\0a", "A", "tab\tnew\nline\x0b"]
    texts = [rnd.choice([" ", "\n", ""]).join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))).encode() for _ in range(400)]
    h, n = jaccard.word_digests(texts)
    words_ = [w for t in texts for w in t.translate(LOW).split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(h) == len(words_)
    known = {}
    assert all(known.setdefault(w, x) == x for w, x in zip(words_, h.tolist())) and len(set(known.values())) == len(known)


@pytest.mark.parametrize("few", [10_000, 0])
def test_jaccard_of_many_groups(spark, monkeypatch, few):
    """Groups of near copies at all distances: components and links, derived and compared, are those of brute force."""
    monkeypatch.setattr(jaccard, "BLOCK", 6)
    monkeypatch.setattr(jaccard, "FEW", few)
    rnd = random.Random(26)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(rnd.randint(40, 160))]
        for _ in range(14):
            v = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4, 7])):
                v[rnd.randrange(len(v))] = f"n{rnd.randint(0, 5)}"
            if rnd.random() < 0.4:
                v = v[rnd.randint(0, 6) :]
            rows.append((len(rows), " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, percent in ((3, 90), (5, 80)):
        want = brute_links(rows, size, percent)
        least = {k: k for k, _ in rows}
        for _ in range(len(rows)):
            for a, b in want:
                least[a] = least[b] = min(least[a], least[b])
        assert {r.doc_id: r.component_id for r in jaccard.join(df, size, percent).collect()} == least
        first = {}
        for k, t in rows:
            first.setdefault(shingle_set(t, size), k)
        got = {(min(r.doc_a, r.doc_b), max(r.doc_a, r.doc_b)) for r in jaccard.links(df, size, percent).collect()}
        assert got == {(a, b) for a, b in want if {a, b} <= set(first.values())}


def brute_steps(values, steps):
    """Strings: the part of rows with smaller ones, in so many steps; a null is in step 0."""
    held = [v.encode() for v in values if v is not None]
    return [0 if v is None else sum(x < v.encode() for x in held) * steps // len(held) for v in values]


def test_places_of_prefixed_strings(spark):
    """Sources with a long common prefix fall in different steps, and places are those of the curve through them."""
    rnd = random.Random(27)
    rows = [(k, "x" * rnd.randint(0, 60), rnd.choice(["en", "de", None]), f"https://host/dataset/publisher-{rnd.choice('aabcdé')}" if k % 9 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in sharding.shard(df, 7).collect()}
    sizes = np.array([len(r[1]) + 16 for r in rows], float)
    cuts = np.unique(np.sort(sizes)[[max(0, -(-len(rows) * k // 32) - 1) for k in range(1, 32)]])
    steps = np.stack([brute_steps([r[3] for r in rows], 32), brute_steps([r[2] for r in rows], 32), np.searchsorted(cuts, sizes, "right")], 1)
    assert len({int(s) for s in steps[:, 0]}) >= 5
    assert [got[r[0]].place for r in rows] == sharding.hilbert(steps, 5).tolist()
    ordered = sorted(got.values(), key=lambda r: (r.place, r.text_crc32, r.doc_id))
    assert [(r.shard, r.slot) for r in ordered] == [(k * 7 // 300, k - -(-(k * 7 // 300) * 300 // 7)) for k in range(300)]


def test_written_shards_keep_all_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows and a column called shard: every row is written once, in the order of slots."""
    rows = [(None, f"text {k % 5}", "en", "a", k) for k in range(12)] + [(7, "same", "de", None, 1)] * 6 + [(k, None, None, f"s{k}", 0) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard long").repartition(4)
    manifest = {r.shard: r for r in sharding.write(df, str(tmp_path / "out"), 5).collect()}
    back = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "shard", "_shard")) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted((r[:5] for r in back), key=str) == sorted(rows, key=str)
    assert {k: sum(r[5] == k for r in back) for k in manifest} == {k: r.n_rows for k, r in manifest.items()} and max(r.n_rows for r in manifest.values()) - min(r.n_rows for r in manifest.values()) <= 1


HELPERS = ["_nth", "_row_key", "_kept", "_source", "_lang", "_topic", "_prob", "_bucket", "_bit", "_bits", "_byte", "_text", "row_key", "text_id", "doc", "spans", "cls", "Place", "a.b"]


def test_columns_called_like_helpers_go_through(spark):
    """Stages return further columns as they were, whatever they are called."""
    rnd = random.Random(28)
    texts = [words(rnd, 40) for _ in range(8)]
    rows = [(k, t, "en", f"s{k % 2}", *(f"{c} {k}" for c in HELPERS)) for k, t in enumerate([*texts, texts[0], texts[1] + " end"])]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *HELPERS])
    model = toxicity.fit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for stage in (lambda d: toxicity.keep_clean(d, model), exact_dedup.keep_one, lambda d: jaccard.keep_one(d, 5, 80), lambda d: mixing.sample(d, budget=0.9)):
        out = stage(df)
        assert out.columns == df.columns
        found = {tuple(r) for r in out.collect()}
        assert found and found <= set(rows)
    assert suffix_dedup.dedup(df).count() == len(rows) and sharding.shard(df).count() == len(rows)


def test_positional_filter_rejects():
    """A block that passes the prefix and the length filter, and doesn't pass the positional one; what holds a template passes all."""
    known = licenses.Templates({"t": "a b c d e", "u": "f g h i j"}, {w: k for k, w in enumerate("abcdefghij")}, 0.8)
    block = {b"b", b"f", b"g", b"h"}  # b is in the prefix of t, and four words are known
    assert known.index[b"b"] and len(block) >= known.need[0]
    assert list(known.candidates({b"a", b"b", b"c", b"d"})) == [0]
    assert 0 in list(known.candidates(block))  # three known words follow b: only counting tells
    assert list(known.candidates({b"e", b"f", b"b", b"a"})) == [0] and list(known.match({b"e", b"f", b"b", b"a"})) == []
    late = {b"f", b"g", b"a", b"j"} | {b"i"}
    mixed = licenses.Templates({"t": "a b c d e", "u": "f g h i j"}, {w: k for k, w in enumerate("fgahbicjde")}, 0.8)
    assert len(late) >= mixed.need[0] and mixed.index[b"a"] and 0 not in list(mixed.candidates(late)) and list(mixed.match(late)) == [("u", 0.8)]


def test_places_of_phrases_in_long_texts():
    """Very many places take linear time, and are those of plain search."""
    known = licenses.Templates(licenses.TEMPLATES, {})
    coded = {b" " + b" ".join(licenses.words_of(p)) + b" ": label for p, label in licenses.PHRASES.items()}
    n = 200_000
    got = licenses.scan_text("mit license x " * n, known, coded)
    assert got[:4] == (3 * n, n, 0, 3 * n - 3)


def test_scores_match_a_plain_model(spark):
    """Every score, held out or not, from the definitions: features, log-odds, best segments by search, extreme-value law and curve."""
    from test_operators import toxic_corpus

    rows, labels = toxic_corpus(500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    text, truth = dict(rows), {k: y for k, _, y in labels}
    fit = {text[k]: truth[k] for k in truth if zlib.crc32(str(k).encode()) % 3 != 1}
    halves = [[(t, y) for t, y in sorted(fit.items()) if zlib.crc32(t.encode()) % 2 == h] for h in (0, 1)]
    counts = {0: Counter(), 1: Counter()}
    for t, y in halves[0]:
        counts[y].update({f for w in set(t.split()) for f in toxicity.features(w)})
    nt, nc = sum(counts[1].values()), sum(counts[0].values())
    weights, ranks = {}, {}
    for f in counts[0] | counts[1]:
        t, c = counts[1][f], counts[0][f]
        alpha = max(toxicity.LEAST_PRIOR, (t + c) / (nt + nc) * toxicity.PRIOR)
        d = math.log((t + alpha) / (nt + toxicity.PRIOR - t - alpha)) - math.log((c + alpha) / (nc + toxicity.PRIOR - c - alpha))
        g = 2 * sum(x * math.log(x / ((t + c) * share)) if x else 0 for x, share in ((t, nt / (nt + nc)), (c, nc / (nt + nc))))
        if d > 0 and g >= toxicity.ASSOCIATION:
            weights[f], ranks[f] = d, g
    assert model.weights == pytest.approx(weights)

    def word_scores(t):
        return [max(((ranks[f], weights[f]) for f in toxicity.features(w) if f in weights), default=(0, toxicity.DRIFT))[1] for w in t.split()]

    def best(t):
        s = word_scores(t)
        return max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)

    clean = [t for t, y in halves[1] if not y]
    scores = [x for t in clean for x in word_scores(t)] + [5.0]
    assert sum(math.exp(model.lam * x) for x in scores) / len(scores) == pytest.approx(1, abs=1e-3)
    assert model.log_k == pytest.approx(sum(model.lam * max(0, best(t)) - math.log(len(t.split())) for t in clean) / len(clean) - 0.5772156649, abs=1e-6)
    a, b, c = model.curve
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for k, t in rows:
        n = len(t.split())
        z = model.lam * best(t) - model.log_k - math.log(n) if best(t) > 0 else 0  # a text without evidence
        passages = len(got[k].passages)
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-(a + b * max(0, z) + c * math.log1p(passages)))), abs=1e-9) and got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert (z > toxicity.SIGNIFICANT) == (passages > 0)


def test_pipeline_by_brute_force(spark, tmp_path):
    """The pipeline's documents and token ids: exact copies go, near copies by five words at 0.8 go, the draw is the weights', and pieces hold all ids."""
    import corpus_pipeline

    from test_operators import SCHEMA, corpus, strip

    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(strip(r[1]), []).append(r)
    left = [min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values()]
    least = {r[0]: r[0] for r in left}
    links = brute_links(left, 5, 80)
    for _ in left:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    left = [r for r in left if least[r[0]] == r[0]]
    drawn = {r.doc_id for r in mixing.weigh(spark.createDataFrame(left, SCHEMA)).collect() if r.sampled}
    assert links and {r.doc_id for r in got} == drawn
    tok, texts = packing.Encoder(packing.default_tokenizer()).tokenizer, {r[0]: r[1] or "" for r in rows}
    for k in drawn:
        ids = [x for r in sorted((r for r in got if r.doc_id == k), key=lambda r: r.start) for x in r.ids]
        assert ids == [*tok.encode(texts[k], add_special_tokens=False).ids, 1]


def test_raking_that_cannot_settle_says_so(spark):
    cells = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "p", 10)], "source string, lang string, topic string, tokens long")
    with pytest.warns(UserWarning, match="off by"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}})


def test_exact_dedup_broadcasts_frequent_digests_only(spark):
    """With few counters, whatever the sketch names, the answer is the same; a table without copies has no heavy digests."""
    rows = [(k, f"text {k}") for k in range(300)] + [(1000 + k, "the same") for k in range(150)]
    for counters in (2, 8, 64):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters).collect()}
        assert got == {k: (k, 1, True) for k in range(300)} | {1000 + k: (1000, 150, k == 0) for k in range(150)}


def test_raking_in_one_row_and_by_windows_agree(spark, monkeypatch):
    rnd = random.Random(29)
    docs = spark.createDataFrame([(k, "w " * rnd.randint(0, 40) + rnd.choice(["", "@", "\n x", " | "]), rnd.choice(["en", "de", None]), rnd.choice("aaabc")) for k in range(400)], "doc_id long, text string, lang string, source string")
    for targets in (None, {"source": {"a": 0.2, "b": 0.5, "c": 0.3}}):
        got = []
        for local in (5000, 0):
            monkeypatch.setattr(mixing, "LOCAL", local)
            got.append({r.doc_id: (r.rate, r.prob) for r in mixing.weigh(docs, targets, 0.5).collect()})
        assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], abs=1e-7) for k in got[0])


def test_raking_of_targets_that_cannot_be_met_agrees(spark, monkeypatch):
    """Both ways of raking end after the same rounds, draw the same documents and tell by how much targets are missed."""
    rnd = random.Random(41)
    pairs = [("a", "en"), ("b", "de"), ("b", "fr"), ("c", "fr")]
    docs = spark.createDataFrame([(k, "w " * rnd.randint(1, 30), *pairs[k % 4]) for k in range(40)], "doc_id long, text string, source string, lang string")
    targets = {"source": {"a": 0.7, "b": 0.2, "c": 0.1}, "lang": {"en": 0.1, "de": 0.3, "fr": 0.6}}
    got = []
    for local in (5000, 0):
        monkeypatch.setattr(mixing, "LOCAL", local)
        with pytest.warns(UserWarning, match="off by"):
            got.append({r.doc_id: (r.rate, r.prob, r.residual, r.sampled) for r in mixing.weigh(docs, targets, 0.5).collect()})
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k], rel=1e-6, abs=1e-9) for k in got[0])
    assert {k: v[3] for k, v in got[0].items()} == {k: v[3] for k, v in got[1].items()}
    assert min(v[2] for v in got[0].values()) > 0.01


def test_mixing_of_null_values_and_ids(spark):
    """U+0000 is one value with null; rows without an id share their draw; targets that are met leave no residual."""
    rows = [(None, "a b c", "s", "en")] * 3 + [(k, "a b", source, "en") for k, source in enumerate(["\x00", None, "s", "s", "t"])]
    got = mixing.weigh(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert len(got) == 8 and len({r.source for r in got}) == 3
    assert len({r.sampled for r in got if r.doc_id is None}) == 1 and all(r.residual <= 1e-9 for r in got)


def test_keeping_one_of_many_equal_rows(spark):
    """100,000 equal rows without an id beside others: one stays, and further columns stay."""
    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(" ").alias("text"), F.lit("x").alias("_one"))
    some = spark.createDataFrame([(k, f"text {k % 7}" + " " * (k % 3), f"y{k}") for k in range(60)], "doc_id long, text string, _one string")
    docs = many.unionByName(some).repartition(6)
    got = exact_dedup.keep_one(docs)
    assert got.columns == docs.columns
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.text, r._one) for r in got.collect())
    want = {}
    for k in range(60):
        want.setdefault(k % 7, []).append((-(k % 3), k))
    want = sorted((False, k, f"text {k % 7}" + " " * (k % 3), f"y{k}") for _, k in map(min, want.values()))
    assert rows == [*want, (True, 0, " ", "x")]
