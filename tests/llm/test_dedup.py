"""Exact and near dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from casframe.llm import exact_dedup, near_dedup
from casframe.llm.common import WordHashes
from casframe.llm.mph import PerfectHash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in "\x20\x09\x0a\x0b\x0c\x0d":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out + ([word] if word else [])


def brute_near(rows):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True)}


def near(spark, rows):
    out = near_dedup.near_dedup(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.kept == (r.doc_id == r.component_id)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in out}


def test_near_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert near(spark, rows) == brute_near(rows)


def group_of_copies(n, seed=3):
    """Edits of one text whose pairs are linked by way of the first only, some edits of edits, and texts that share a passage."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(200)]
    rows = [(500, " ".join(base))]
    for i in range(n):
        w = list(base)
        for _ in range(r.choice((1, 2, 3))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            w[r.randrange(len(w))] = "y"
            rows.append((600 + i, " ".join(w).upper()))
    for i in range(40):
        rows.append((1000 + i, " ".join(base[:120] + [f"z{r.randrange(10**6)}" for _ in range(60)])))
    return rows


@pytest.mark.parametrize("small, block", [(16, 128), (2, 8)])
def test_near_in_a_large_group(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = group_of_copies(60)
    assert near(spark, rows) == brute_near(rows)


def test_near_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "a b c d"), (7, "a b c d"), (8, "\xa0 b"), (9, "b \xa0"), (10, "x " * 30000), (11, "X " * 29000), (12, "\u00c4 b c d e"), (13, "\u00e4 b c d e")]
    assert near(spark, rows) == brute_near(rows)


def test_near_on_empty_null_and_repeated(spark):
    assert near(spark, []) == {}
    out = near_dedup.near_dedup(spark.createDataFrame([(None, "a b", "", "", 0), (7, "a b", "", "", 0), (7, "a b", "", "", 0), (None, None, "", "", 0)], DOCS)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in out) == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True)]


@pytest.mark.parametrize("small", [16, 1])
def test_near_at_another_similarity(spark, monkeypatch, small):
    """Pairs of Jaccard 0.8 to 0.85 are linked where the caller asks for 0.8, and only there."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)
    r = random.Random(5)
    rows, want = [], {}
    for i in range(0, 80, 2):
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        x = list(w)
        for k in range(6):
            x[20 + 50 * k] = "x"  # 30 of 296 shingles
        rows += [(i, " ".join(w)), (i + 1, " ".join(x))]
        want |= {i: i, i + 1: i}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    assert {x.doc_id: x.component_id for x in near_dedup.near_dedup(docs, (80, 100)).collect()} == want
    assert {x.doc_id: x.component_id for x in near_dedup.near_dedup(docs).collect()} == {i: i for i in want}


def test_bands_fit_the_similarity():
    assert near_dedup.banding((85, 100)) == (28, 6) and near_dedup.banding((80, 100)) == (34, 5)
    for similar in ((5, 10), (7, 10), (8, 10), (9, 10)):
        bands, rows = near_dedup.banding(similar)
        assert (1 - (similar[0] / similar[1]) ** rows) ** bands <= near_dedup.MISSED


def test_signature_is_the_plain_algorithm():
    """The vectorised levels give what one pass over the elements, each with its own permutation, gives."""
    r = np.random.default_rng(0)
    for n in (1, 3, 50, 700):
        x = r.integers(0, 1 << 63, n, dtype=np.uint64)
        m = 24
        held = near_dedup.signatures(x, np.zeros(n, int), 1, m)[0]
        plain = [np.iinfo(np.uint64).max] * m
        for e in x:
            perm = list(range(m))
            for level in range(m):
                v = int(near_dedup.stream64(np.array([e]), level)[0])
                k = level + (((v & 0xFFFFFFFF) * (m - level)) >> 32)
                perm[level], perm[k] = perm[k], perm[level]
                plain[perm[level]] = min(plain[perm[level]], level << 32 | v >> 32)
        assert [int(h) for h in held] == plain


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(30):
        x = np.unique(r.integers(0, 1 << 63, 600, dtype=np.uint64))
        a, b = x[:500], x[100:600]
        s = near_dedup.signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 168)
        errors.append((s[0] == s[1]).mean() - 400 / 600)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.045


def test_shingles():
    known = WordHashes()
    assert len(near_dedup.shingle_hashes(b"a b c d e f a b c d e".split(), known)) == 6 + 0
    assert len(near_dedup.shingle_hashes(b"a b".split(), known)) == 1
    assert len(near_dedup.shingle_hashes([], known)) == 0


def test_components_of_a_path(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    pairs = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:])], "a long, b long").repartition(7)
    got = {r.id: r.component for r in near_dedup.components(pairs).collect()}
    assert got == {i: 0 for i in range(1, n)}


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    ph = PerfectHash.load(PerfectHash.build(keys).dump())
    assert sorted(ph.numbers(keys)) == list(range(5000))
    with pytest.raises(ValueError):
        PerfectHash.build([b"a", b"a"])
    assert PerfectHash.build([]).numbers([b"x"]).tolist() == [-1]


def brute_exact(rows):
    best, n = {}, {}
    for i, t in rows:
        k = lower(t)
        best[k], n[k] = max(best.get(k, i), i), n.get(k, 0) + 1
    return sorted((i, best[lower(t)], n[lower(t)], i == best[lower(t)], hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def test_exact(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_A_LOOKUP", 5)  # copies of hot shards
    rows = [(i, random.Random(i % 17).choice(["a", "A", "b\n", "\u00c4", "\u00e4", "", None, "long " * 5000])) for i in range(100)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_exact(rows)
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_exact_against_history(spark):
    rows = exact_dedup.digests(spark.createDataFrame([(1, "old"), (5, "older"), (6, "OLDER")], "doc_id long, text string"))
    index = exact_dedup.build_index(rows, 3)
    new = spark.createDataFrame([(10, "Old"), (11, "new"), (12, "NEW"), (13, "other"), (None, "other")], "doc_id long, text string")
    got = exact_dedup.exact_dedup(new, index, 3).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(10, 1, 1, False), (11, 12, 2, False), (12, 12, 2, True), (13, 13, 2, True), (None, 13, 2, False)], key=str)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "A", "y"), (2, "A", "y"), (3, None, None)], "doc_id long, text string, __rank string")
    got = exact_dedup.keep_first_rows(docs, exact_dedup.exact_dedup(docs)).collect()
    assert sorted(map(tuple, got)) == [(2, "A", "y"), (3, None, None)]


def test_rows_that_stay_keep_all_their_values(spark):
    docs = spark.createDataFrame([(i, f"t{i % 7}", 77, i, "w") for i in range(20)] + [(19, "t5", 77, 19, "w")] * 3, "doc_id long, text string, __digest int, __key long, __whole string")
    got = exact_dedup.keep_first_rows(docs, exact_dedup.exact_dedup(docs))
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(i, f"t{i % 7}", 77, i, "w") for i in range(13, 20)]


def test_history_and_arrivals_both_give_rows(spark, monkeypatch):
    """Groups within the history, within the arrivals and across both, hot ones and null ids among them."""
    seen = []
    lookup = exact_dedup.lookup
    monkeypatch.setattr(exact_dedup, "lookup", lambda *a: (seen.append(out := lookup(*a)), out)[1])
    r = random.Random(4)
    rows = [(i if r.random() < 0.95 else None, r.choice(["hot"] * 8 + [f"T{r.randrange(40)}", f"t{r.randrange(900)}"])) for i in range(700)] + [(699, "hot")] * 200
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    best, n = {}, {}
    for i, t in rows:
        k = lower(t)
        best[k], n[k] = max(best.get(k, -1), -1 if i is None else i), n.get(k, 0) + 1
    want = [(i, b if (b := best[lower(t)]) >= 0 else None, n[lower(t)], (-1 if i is None else i) == b, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kinds = {r.member: r["count"] for r in seen[0].groupBy("member").count().collect()}
    assert kinds[True] > 100 and kinds[False] > 20


def passage_rows(n, seed=9):
    """Texts that share 70 of 100 words and are not linked, with a linked pair for each twentieth."""
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(n):
        own = passage + [f"o{r.randrange(10**7)}" for _ in range(30)]
        rows.append((i, " ".join(own)))
        if i % 20 == 0:
            own[99 - r.randrange(3)] = "edit"
            rows.append((10_000 + i, " ".join(own)))
    return rows


def test_a_large_bucket_of_unlinked_documents_is_not_compared_in_full(spark, monkeypatch):
    """What meets by prefixes grows with the documents, and the links are those of brute force."""
    met = []
    verified = near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda pairs, *a: (met.append(pairs.count()), verified(pairs, *a))[1])
    blocks = []
    monkeypatch.setattr(near_dedup, "_block_links", lambda similar: blocks.append(1) or (lambda group: group))
    for n in (400, 1600):
        rows = passage_rows(n)
        met.clear()
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
        crowd = docs.selectExpr("doc_id AS rep", "doc_id AS component")
        links = {(x.a, x.b) for x in near_dedup.by_prefixes(crowd, docs, near_dedup.SIMILAR).collect()}
        assert links == {(i, 10_000 + i) for i in range(0, n, 20)}
        assert sum(met) <= n // 10 and not blocks
        if n == 400:
            assert near(spark, rows) == brute_near(rows)


@pytest.mark.parametrize("block", [8, 200])
def test_groups_that_share_rare_shingles(spark, monkeypatch, block):
    """Groups of one prefix shingle that are compared in blocks give the links of brute force."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = group_of_copies(40, seed=6)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = {(x.a, x.b) for x in near_dedup.by_prefixes(docs.selectExpr("doc_id AS rep", "doc_id AS component"), docs, near_dedup.SIMILAR).collect()}
    sets = {i: {tuple(w[k : k + 5]) for w in [words(lower(t))] for k in range(len(w) - 4)} for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 100


def test_near_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i % 3}", 5, 6, 7) for i in range(9)] + [(1, "text 1", 5, 6, 7)] * 4, "doc_id long, text string, rep int, hub int, __id int")
    got = near_dedup.one_of_each(docs, near_dedup.near_dedup(docs))
    assert got.columns == docs.columns and sorted({tuple(r) for r in got.collect()}) == [(i, f"text {i}", 5, 6, 7) for i in range(3)]


def test_few_links_are_grouped_in_one_task_as_stars_group_them(spark):
    """The same components with and without rounds of stars; few links take far fewer jobs."""
    r = random.Random(31)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + r.randrange(400), 1500 + r.randrange(400)) for _ in range(350)] + [(5000, 4000)]
    links = spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long").repartition(7)
    least = {}
    for a, b in pairs * 2:
        x, y = least.get(a, {a}), least.get(b, {b})
        both = x | y
        least.update(dict.fromkeys(both, both))
    want = {i: min(own) for i, own in least.items() if i != min(own)}
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for few in (0, near_dedup.LINKS_OF_A_TASK):
        spark.sparkContext.setJobGroup(f"components-{few}", "")
        assert {x.id: x.component for x in near_dedup.components(links, few).collect()} == want
        jobs.append(len(tracker.getJobIdsForGroup(f"components-{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] * 4 < jobs[0]
