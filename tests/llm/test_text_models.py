"""Quality rules, BPE, importance resampling and context trees."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from casframe.llm import bpe, context_tree, importance, quality_rules
from casframe.llm.common import bounded_sample, cut, kth_largest
from test_dedup import lower, words

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a b"), (5, "word " * 60), (6, "#*$%&|<> x\n\n#*$%&|<> x\n"), (7, "\u00e4\u4e2d\U0001f600 " * 50), (None, "null id"), (9, "x y z " * 20000), (9, "repeated"), (9, "repeated")]


def base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    held = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(held) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(held), failed)


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_base_counts(spark):
    rows = [(r.doc_id, r.text) for r in rows_of(spark, "documents").limit(150).collect()] + ODD
    docs = spark.createDataFrame([(i, t, "mine") for i, t in rows], "doc_id long, text string, kept string")
    got = quality_rules.quality_rules(docs, rows_of(spark, "labels")).collect()
    assert [tuple(r)[:7] for r in got] == [(i, *base(t)) for i, t in rows]
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_is_learned(spark):
    docs, labels = rows_of(spark, "documents"), rows_of(spark, "labels")
    ids = labels.selectExpr("doc_id", "quality", "crc32(cast(doc_id as string)) % 3 = 0 AS test").collect()
    train = spark.createDataFrame([(r.doc_id, r.quality) for r in ids if not r.test], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, train).collect()}
    test = [(r.quality, got[r.doc_id].quality_probability >= 0.5) for r in ids if r.test]
    assert np.mean([bool(q) == k for q, k in test]) > 0.95
    assert np.mean([k for q, k in test if q]) > 0.98


def test_trees_are_monotone_and_flat_scoring_is_recursive():
    r = np.random.default_rng(2)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + 0.3 * r.standard_normal(600)) < 0.6).astype(float)
    forest = quality_rules.fit(x, y, directions=(-1, 0, 1), trees=25)

    def walk(n, row):
        while forest.feature[n] >= 0:
            n = forest.left[n] if row[forest.feature[n]] <= forest.threshold[n] else forest.right[n]
        return forest.value[n]

    assert np.allclose(forest.margin(x), [forest.bias + sum(walk(n, row) for n in forest.roots) for row in x])
    assert np.mean((forest.probability(x) > 0.5) == y) > 0.75
    for j, sign in ((0, -1), (2, 1)):
        line = np.repeat(x[:40], 50, axis=0)
        line[:, j] = np.tile(np.linspace(0, 1, 50), 40)
        steps = np.diff(forest.margin(line).reshape(40, 50), axis=1)
        assert (sign * steps >= -1e-12).all()


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words " * 5), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality_rules.quality_rules(docs, none).collect()] == [False, False]
    assert quality_rules.quality_rules(docs.limit(0), none).collect() == []


@pytest.fixture(scope="module")
def tokens():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, tokens):
    ranks, library = tokens
    rows = [(r.doc_id, r.text) for r in rows_of(spark, "documents").limit(200).collect()] + ODD + [(77, "<|endoftext|> don't \x85\x1c\u2028 '\u017f 12\u00b2"), (78, "q" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN).collect()
    ids = [library.encode_ordinary(t or "") for _, t in rows]
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (i, t), x in zip(rows, ids, strict=True)]
    assert [tuple(r) for r in got] == want
    encoded = bpe.encode_ids(docs, ranks, public_tokenizers.PATTERN)
    assert [r.ids for r in encoded.collect()] == ids
    assert [r.text for r in bpe.decode_ids(encoded, ranks).collect()] == [t or "" for _, t in rows]


def test_bpe_on_random_text(tokens):
    ranks, library = tokens
    encoder, r = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(5)
    pool = [chr(c) for c in range(0x300)] + list("\u1680\u180e\u200b\u3000\ufeff\u0660\u4e2d\u0301") + ["  ", "\r\n", "'ll", "'S"]
    for _ in range(1500):
        text = "".join(r.choice(pool) for _ in range(r.randrange(40)))
        assert encoder.encode(text) == library.encode_ordinary(text)


def test_importance(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in importance.importance_resample(docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    k = math.ceil(len(got) * np.mean([q > 0 for q in quality.values()]))
    keys = sorted((r.key for r in got.values()), reverse=True)
    assert {i for i, r in got.items() if r.kept} == {i for i, r in got.items() if r.key >= keys[k - 1]}
    assert np.mean([got[i].kept for i, q in quality.items() if q]) > 0.95
    assert np.mean([got[i].kept for i, q in quality.items() if not q]) < 0.1


def test_importance_ratio_is_that_of_the_models(spark):
    rows = [(1, "good text here"), (2, "bad"), (3, None), (4, "Good bad"), (4, "Good bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    known = importance.WordHashes()
    grams = [importance.buckets((t or "").encode(), known) for _, t in rows]
    raw, good = Counter(int(x) for g in grams for x in g), Counter(grams[0].tolist())
    b = importance.BUCKETS
    ratio = lambda x: math.log((good[x] + 1) / (sum(good.values()) + b)) - math.log((raw[x] + 1) / (sum(raw.values()) + b))
    got = importance.importance_resample(docs, labels, 1.0).collect()
    assert np.allclose([r.log_ratio for r in got], [sum(ratio(int(x)) for x in g) for g in grams])
    assert all(r.kept for r in got) and got[3].key == got[4].key
    assert importance.importance_resample(docs.limit(0), labels).collect() == []


def test_kth_largest(spark):
    r = random.Random(3)
    for values in ([r.randrange(-(1 << 62), 1 << 62) for _ in range(300)], [r.randrange(50) for _ in range(300)], [7] * 9, [70000, 3]):
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        for k in (1, 2, len(values) // 2 + 1, len(values)):
            assert kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
        assert kth_largest(frame, "v", len(values) + 1) is None and kth_largest(frame, "v", 0) is None
    assert kth_largest(frame.limit(0), "v", 1) is None


def test_bounded_sample(spark):
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert 350 < bounded_sample(rows, 500).count() < 650 and bounded_sample(rows, 5000).count() == 5000


def test_order_of_floats():
    x = np.array([-np.inf, -3.5, -1e-300, 0.0, 1e-300, 2.0, np.inf])
    assert (np.diff(importance.sortable(x).astype(object)) > 0).all()


def ctw(train, texts, most=None):
    """The textbook recursion: log10 probabilities of each text after a training sequence, held fixed.

    most: how many contexts of three and four bytes are nodes, by count; the other contexts
    below a node are one child, None.
    """
    pad, depth = b"\xff" * 4, 4
    seen = Counter(s[i - d : i] for t in train for s in [pad + t + b"\xff"] for i in range(4, len(s)) for d in (3, 4))
    kept = {}
    for d in (3, 4):
        own = sorted((c for c in seen if len(c) == d), key=lambda c: -seen[c])
        n = (most or {}).get(d, len(own))
        own = own if n >= len(own) else [c for c in own[:n] if seen[c] > seen[own[n]]]
        kept[d] = {c for c in own if d == 3 or c[1:] in kept[3]}

    def path(before):
        """Contexts of a position, the shortest first; the rest of a node stands for those that are no nodes."""
        out = [before[4 - d :] for d in range(3)]
        for d in (3, 4):
            c = before[4 - d :]
            if c in kept[d]:
                out.append(c)
            else:
                if any(k[1:] == out[-1] for k in kept[d]):
                    out.append((out[-1], None))
                break
        return out

    def visits(text):
        s = pad + text + b"\xff"
        for i in range(4, len(s)):
            prefix, nodes = 1, path(s[i - 4 : i])
            for bit in (s[i] >> k & 1 for k in range(7, -1, -1)):
                yield [(prefix, c) for c in nodes], bit
                prefix = prefix * 2 + bit

    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - 2 * lg(0.5) - lg(a + b + 1)
    n, child = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for nodes, bit in visits(t):
            for x in nodes:
                n[x][bit] += 1
            for x, y in zip(nodes, nodes[1:]):
                child[x].add(y)

    weighted = {}

    def weight(x):
        if x not in weighted:
            own = kt(*n[x]) if x in n else 0.0
            weighted[x] = np.logaddexp(own, sum(map(weight, child[x]))) - math.log(2) if x in child else own
        return weighted[x]

    out = []
    for t in texts:
        total = 0.0
        for nodes, bit in visits(t):
            p = None
            for x in reversed(nodes):
                a, b = n[x] if x in n else (0, 0)
                own = (b + 0.5) / (a + b + 1)
                stay = math.exp(kt(a, b) - math.log(2) - weight(x)) if x in child else 0.5
                p = own if p is None else stay * own + (1 - stay) * p
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("most", [None, {3: 40, 4: 30}, {3: 0, 4: 0}])
def test_context_tree_scores(spark, monkeypatch, most):
    monkeypatch.setattr(context_tree, "TOP_WORDS", 5)  # most words go by the join
    monkeypatch.setattr(context_tree, "DEEP", most or context_tree.DEEP)
    monkeypatch.setattr(context_tree, "GRAM_ENTRIES", 100)
    rows = [(r.doc_id, r.text[:300]) for r in rows_of(spark, "documents").limit(12).collect()] + [(i, t and t[:200]) for i, t in ODD]
    got = context_tree.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    tokens = [[*words(lower(t)), None] for _, t in rows]
    counts = Counter(x for t, h in zip(tokens, held, strict=True) if not h for x in t)
    total = sum(counts.values())
    model = ctw([lower(t).encode() for (_, t), h in zip(rows, held, strict=True) if not h], [lower(t).encode() for _, t in rows], most)
    want = []
    for (i, _), h, t, m in zip(rows, held, tokens, model, strict=True):
        s = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (len(counts) + 1))) for x in t)
        want.append((i if i is not None else -1, h, len(t), sum(counts[x] > 0 for x in t), total, round(s, 6), round(m, 2)))
    have = [(r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 2)) for r in got]
    assert len(have) == len(want)
    for x, y in zip(sorted(have), sorted(want), strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], abs=0.02)


def test_context_tree_is_a_distribution():
    runs, n = np.array([0x616263, 0x616264, 0x206162]), np.array([5, 2, 9])
    deep = {3: (np.array([0x206162]), np.array([0x20616263, 0x20616264]), np.array([3, 2])), 4: (np.zeros(0, int),) * 3}
    model = context_tree.compile_model((runs, n), deep)
    p = lambda before: 10.0 ** model.log10((before << 8) | np.arange(256))
    for before in (0x6162, 0x206162, 0x41206162, 0x2061, 0, 0x6100):
        assert np.isclose(p(before).sum(), 1, atol=1e-4)
    assert p(0x6162)[0x63] > p(0x6162)[0x64] > p(0x6162)[0x65]


def test_deeper_contexts_predict_held_out_text_better(spark, monkeypatch):
    docs = rows_of(spark, "documents").limit(400)
    held = lambda: sum(r.score for r in context_tree.score(docs).where("held_out").collect())
    deep = held()
    monkeypatch.setattr(context_tree, "DEEP", {3: 0, 4: 0})
    assert deep > held()


def test_context_tree_keeps_every_context():
    """More contexts than any fixed number of nodes: each of three and four bytes is one, and predicts what follows it."""
    r = np.random.default_rng(0)
    contexts = np.unique(r.integers(0, 1 << 32, 60_000))
    runs = contexts << 8 | r.integers(0, 256, len(contexts))
    model = context_tree.whole_model(runs, np.full(len(runs), 3))
    assert (model.log10(runs) > -3 * math.log10(2)).mean() > 0.99
    assert len(np.unique(model.nodes[3][0] >> 8)) == len(np.unique(contexts & 0xFFFFFF)) > 1 << 15


def test_every_context_is_learned_from_text(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2000))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = context_tree.learn(context_tree.training_counts(docs))
    train = [t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {s[i - 4 : i] for t in train for s in [b"\xff" * 4 + t + b"\xff"] for i in range(4, len(s))}
    assert len(seen) > 1 << 15 and set((model.runs >> 8).tolist()) == {int.from_bytes(c, "big") for c in seen}
    p = 10.0 ** model.log10((int.from_bytes(next(iter(seen)), "big") << 8) | np.arange(256))
    assert np.isclose(p.sum(), 1, atol=1e-4)


def test_context_tree_without_training(spark):
    got = context_tree.score(spark.createDataFrame([(7, "ab")], "doc_id long, text string").where("doc_id < 0"))
    assert got.collect() == []


@pytest.mark.parametrize("top", [0, 50, 1 << 20])
def test_runs_score_alike_wherever_they_are_kept(spark, monkeypatch, top):
    """The table of runs in parts, the runs sent to the scorers and those joined give what the model in one object gives."""
    monkeypatch.setattr(context_tree, "TOP_RUNS", top)
    rows = [(r.doc_id, r.text) for r in rows_of(spark, "documents").limit(60).collect()] + ODD
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, row int, key int")
    model = context_tree.learn(context_tree.training_counts(docs))
    got = context_tree.score(docs).collect()
    want = []
    for i, t in rows:
        number, _ = context_tree.grams([lower(t).encode()])
        want.append((-1 if i is None else i, float(model.log10(number).sum())))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
    for x, y in zip(have, sorted(want), strict=True):
        assert x[0] == y[0] and x[1] == pytest.approx(y[1], rel=1e-5, abs=1e-4)
    assert sum(r.held_out for r in got) > 5


def test_scoring_stores_two_tables(spark, monkeypatch):
    """Each stored partition makes an executor start other programs; counts and subtrees are read again, scores and rows are not."""
    stored = []
    monkeypatch.setattr(context_tree, "cut", lambda df: stored.append(df.columns) or cut(df))
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)], "doc_id long, text string")
    assert context_tree.score(docs).count() == 20
    assert stored == [["kind", "key", "n"], ["kind", "key", "n", "p", "n0", "n1", "weight"]]


def test_a_long_text_scores_in_steps_as_in_one(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh \n") for _ in range(2 * context_tree.STEP_BYTES + 7))
    rows = [(1, long), (2, long[: context_tree.STEP_BYTES]), (3, long[::-1]), (4, None)]  # 3 is held out
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = context_tree.learn(context_tree.training_counts(docs))
    got = {x.doc_id: x for x in context_tree.score(docs).collect()}
    for i, t in rows:
        number, _ = context_tree.grams([(t or "").encode()])
        assert got[i].score == pytest.approx(float(model.log10(number).sum()), rel=1e-6) and got[i].n_tokens == len(words(t or "")) + 1


def test_runs_are_counted_in_bounded_memory(monkeypatch):
    """Steps of a long text give the runs of the whole text, and the arrays of distinct runs stay small."""
    text = random.Random(6).randbytes(12 << 20).replace(b"\xff", b" ")
    table, n, sent = context_tree.RunCounts(1 << 20), 0, Counter()
    tracemalloc.start()
    for number, _ in context_tree.gram_steps([text]):
        n += len(number)
        if table.add(number, 1):
            keys, times = table.sums()
            sent["runs"] += int(times.sum())
            table.clear()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text) + 1 == sent["runs"] + int(table.sums()[1].sum())
    assert peak < 150e6
    monkeypatch.setattr(context_tree, "STEP_BYTES", 100)
    for size in (0, 1, 99, 100, 101, 250, 300):
        small = text[:size]
        assert np.concatenate([x for x, _ in context_tree.gram_steps([small])]).tolist() == context_tree.grams([small])[0].tolist()
    table, want = context_tree.RunCounts(1 << 20), Counter()
    for i, part in enumerate([text[:300] * 2, b"abab", text[:50]]):
        number, _ = context_tree.grams([part])
        table.add(number, i % 2)
        want.update({k: 0 for k in number.tolist()} if not i % 2 else Counter(number.tolist()))
    assert dict(zip(*(x.tolist() for x in table.sums()), strict=True)) == dict(want)


def test_word_caches_are_bounded_in_bytes():
    known = context_tree.WordHashes()
    assert len(known.of([b"x" * 1_000_000, b"a", b"b" * 64])) == 3 and sorted(known) == [b"a", b"b" * 64]


def test_long_pre_tokens_are_not_remembered(tokens):
    ranks, library = tokens
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    long = "ab" * 5000
    for batch in ({long, "cat"}, {"dog", long}, {"emu"}):
        encoder.learn(batch)
        assert all(encoder.known[t][0] == len(library.encode_ordinary(t)) for t in batch)
    assert sorted(encoder.known) == ["cat", "dog", "emu"]


def test_pairs_of_bytes_are_looked_up_for_a_whole_batch(tokens):
    ranks, library = tokens

    class Counted(dict):
        calls = 0

        def get(self, key):
            self.calls += 1
            return super().get(key)

    encoder, r = bpe.Encoder(ranks, public_tokenizers.PATTERN), random.Random(8)
    encoder.merges = Counted(encoder.merges)
    batch = {"".join(r.choice("etaoinshr\u00e9\u4e2d") for _ in range(r.randrange(8, 40))) for _ in range(300)}
    encoder.learn(batch)
    ids = {t: library.encode_ordinary(t) for t in batch}
    assert all(encoder.known[t][0] == len(ids[t]) for t in batch)
    assert encoder.merges.calls <= sum(2 * (len(t.encode()) - len(ids[t])) for t in batch)  # two neighbours a merge


def test_pre_tokens_found_again_outlast_new_ones(tokens, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    encoder = bpe.Encoder(tokens[0], public_tokenizers.PATTERN)
    new = lambda n: {f"zq{n}x{i}" for i in range(12)}
    for n, extra in enumerate(({"again"}, {"again"}, set(), set(), set())):
        encoder.learn(new(n) | extra)
    assert "again" in encoder.known and "zq0x0" not in encoder.known
    for n in range(5, 100):  # all are found again: no more than a batch above the bound is kept
        encoder.learn(new(n) | new(n - 1))
        assert max(len(encoder.often), len(encoder.known) - len(encoder.often), len(encoder.before) / 2) <= 10 + 24


def test_bpe_digests_with_sparse_ranks(tokens):
    ranks, library = tokens
    sparse = {k: 7 * r + 100_000 for k, r in ranks.items()}
    texts = ["", "Some words, zqxj \u4e2d\u00e9 " * 3, "", "w" * 300 + " qzj", "\n"]
    counts, ids, decoded = bpe.Encoder(sparse, public_tokenizers.PATTERN).digests(texts)
    want = [[7 * i + 100_000 for i in library.encode_ordinary(t)] for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids == [hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest() for w in want]
    assert decoded == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert bpe.Encoder(sparse, public_tokenizers.PATTERN).encode(texts[1]) == want[1]
