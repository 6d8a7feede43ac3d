"""Column expressions and relational operators."""

import hashlib
import json
import os
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from casframe.functions import codecs, delta, hashing, lexical, text
from casframe.functions.codecs import Entry
from casframe.operators import diff, fsck, graph, locate, repack, search, trees
from casframe.repository import cache_hits
from casframe.sources import objects as store
from test_codecs import BLOB, EMPTY, ENTRIES, MIXED

LEAF = "path string, kind tinyint, executable boolean, object_id string"


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_ids_in_columns(spark):
    assert values(spark, hashing.blob_id("b"), [(bytearray(b"hello world\n"),)], "b binary") == [BLOB]
    entry = F.struct(hashing.utf16_key("name").alias("key"), hashing.tree_entry_bytes(F.col("name"), F.col("kind"), F.col("executable"), F.col("id")).alias("bytes"))
    rows = spark.createDataFrame([(e.name, e.kind, e.executable, e.object_id) for e in ENTRIES], "name string, kind int, executable boolean, id string")
    payload = rows.agg(F.collect_list(entry).alias("e")).select(hashing.tree_payload(F.col("e")).alias("p"))
    assert payload.select(hashing.object_id("tree", "p")).first()[0] == MIXED
    commit = hashing.commit_payload(F.col("t"), F.col("p"), F.col("s"), F.col("n"), F.col("m"))
    rows = [(MIXED, [], 1700000000, 123456789, "First\n\nBody line"), (EMPTY, [BLOB], -7, 0, "\u00e9")]
    got = values(spark, commit, rows, "t string, p array<string>, s long, n int, m string")
    assert [bytes(x) for x in got] == [codecs.encode_commit(codecs.Commit(t, tuple(p), s, n, m)) for t, p, s, n, m in rows]


def test_numbers_and_checks(spark):
    assert values(spark, hashing.fnv1a("s"), [("foobar",), ("",), ("\u00e9",)], "s string") == [lexical.fnv1a(x.encode()) for x in ("foobar", "", "\u00e9")]
    data = [(bytearray((-5).to_bytes(4, "big", signed=True) + (-7).to_bytes(8, "big", signed=True)),), (bytearray((5).to_bytes(4, "big") + (1 << 40).to_bytes(8, "big")),)]
    assert values(spark, hashing.big_endian(F.col("b"), 1, 4), data, "b binary") == [-5, 5]
    assert values(spark, hashing.big_endian(F.col("b"), 5, 8), data, "b binary") == [-7, 1 << 40]
    assert values(spark, hashing.is_id("s"), [(BLOB,), (BLOB + "\n",), (BLOB.upper(),), (None,)], "s string") == [True, False, False, False]
    assert values(spark, hashing.name_is_safe("s"), [("a",), ("",), (".",), ("..",), ("a/b",), ("a\\b",), ("a\0",), (None,)], "s string") == [True] + [False] * 7
    names = [("\ufffd",), ("\U00010000",), ("a",)]
    assert [r[0] for r in spark.createDataFrame(names, "s string").orderBy(hashing.utf16_key("s")).collect()] == ["a", "\U00010000", "\ufffd"]


def test_text_columns(spark):
    rows = [("\u0130stanbul \u03a3\u0391\u03a3 a1-the_\u0663",), ("",)]
    assert values(spark, text.tokens("s"), rows, "s string")[0] == ["istanbul", "\u03c3\u03b1\u03c3", "a1", "the", "\u0663"]
    assert values(spark, text.content_tokens("s"), [("the cat and the cat",)], "s string") == [["cat", "cat"]]
    assert values(spark, text.message_lines("s"), [("a\r\nb\rc\n",), ("",), ("x\n\n",)], "s string") == [["a", "b", "c"], [], ["x", ""]]
    assert values(spark, text.first_line("s"), [("a\nb",), ("",)], "s string") == ["a", ""]
    assert values(spark, text.human_bytes("n"), [(0,), (1023,), (1024,), (1536,), (1280,), (1 << 20,), (5 << 30,), (3 << 40,)], "n long") == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.2 KB", "1.0 MB", "5.0 GB", "3.0 TB"]
    assert values(spark, text.iso_timestamp("s", "n"), [(1700000000, 123456789), (0, 0), (60, 500000000)], "s long, n int") == ["2023-11-14T22:13:20.123456789Z", "1970-01-01T00:00:00Z", "1970-01-01T00:01:00.5Z"]
    assert values(spark, text.printable_path("s"), [("a\tb\\c\r\n\x1b",)], "s string") == ["a\\tb\\\\c\\r\\n\x1b"]
    assert values(spark, text.printable_snippet("s"), [("\x1b[0m\u00e9",)], "s string") == ["\\x1b[0m\u00e9"]
    assert values(spark, text.normal_message("s"), [(" a ",), ("  ",), ("a\0b",), (None,)], "s string") == ["a", None, None, "Snapshot"]
    assert values(spark, text.is_printable("s"), [("ab\x01",), ("a" * 10,), ("",), (None,)], "s string") == [False, True, False, False]
    data = [(bytearray(b"ok \xc3\xa9"),), (bytearray(b"\xff"),), (bytearray(b""),), (bytearray(b"\x01" * 9),), (bytearray(b"x" + "\u00e9".encode() * 600_000),)]
    got = values(spark, text.utf8_text("b"), data, "b binary")
    assert got[:4] == ["ok \u00e9", None, None, None] and len(got[4].encode()) == (1 << 20) - 1


def leaves(spark, rows):
    return spark.createDataFrame([(p, k, x, i) for p, k, x, i in rows], LEAF)


def test_diff_kinds(spark):
    before = leaves(spark, [("keep", 1, False, "a"), ("modify", 1, False, "a"), ("delete", 1, False, "a"), ("becomes-dir", 1, False, "a"), ("mode", 1, False, "a"), ("link", 1, False, "a"), ("hollow", 2, False, "e"), ("gone", 2, False, "e"), ("full/x", 1, False, "a")])
    after = leaves(spark, [("keep", 1, False, "a"), ("modify", 1, False, "b"), ("add", 1, False, "a"), ("becomes-dir/in", 1, False, "a"), ("mode", 1, True, "a"), ("link", 3, False, "a"), ("hollow/child", 1, False, "a"), ("new", 2, False, "e"), ("full", 2, False, "e")])
    got = [(r.status, r.path) for r in diff.in_order(diff.compare(before, after)).collect()]
    assert got == sorted([("A", "add"), ("D", "becomes-dir"), ("A", "becomes-dir/in"), ("D", "delete"), ("D", "full/x"), ("D", "gone"), ("A", "hollow/child"), ("T", "link"), ("M", "mode"), ("M", "modify"), ("A", "new")], key=lambda x: x[1])
    assert {r.status: r.n for r in diff.summary(diff.compare(before, after)).collect()} == {"A": 4, "D": 4, "T": 1, "M": 2}
    assert diff.compare(before, before).collect() == []


def test_roll_up_and_flatten(spark):
    rows = [("a.txt", 1, True, BLOB), ("d/e/f", 1, False, BLOB), ("d/e-f", 3, False, BLOB), ("d/hollow", 2, False, EMPTY), ("\U00010000", 1, False, BLOB), ("\ufffd", 1, False, BLOB)]
    made = trees.roll_up(leaves(spark, rows)).collect()
    ids = {r.dir: r.id for r in made}
    inner = codecs.encode_tree([Entry("f", 1, False, BLOB)])
    d = codecs.encode_tree([Entry("e", 2, False, codecs.object_id("tree", inner)), Entry("e-f", 3, False, BLOB), Entry("hollow", 2, False, EMPTY)])
    root = codecs.encode_tree([Entry("a.txt", 1, True, BLOB), Entry("d", 2, False, codecs.object_id("tree", d)), Entry("\U00010000", 1, False, BLOB), Entry("\ufffd", 1, False, BLOB)])
    assert ids == {"d/e": codecs.object_id("tree", inner), "d": codecs.object_id("tree", d), "d/hollow": EMPTY, "": codecs.object_id("tree", root)}
    assert {r.dir: bytes(r.payload) for r in made}[""] == root
    stored = spark.createDataFrame([(r.id, "tree", r.payload) for r in made], "id string, type string, payload binary")
    start = spark.createDataFrame([("r", ids[""])], "root string, tree_id string")
    got = trees.flatten(start, trees.tree_entries(stored), stored).drop("root").collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    assert trees.roll_up(leaves(spark, [])).first().id == EMPTY


def test_flatten_refuses_cycles_and_gaps(spark):
    entries = spark.createDataFrame([("t1", 0, "d", 2, False, "t2"), ("t2", 0, "d", 2, False, "t1")], "tree_id string, pos int, name string, kind int, executable boolean, object_id string")
    start = spark.createDataFrame([("r", "t1")], "root string, tree_id string")
    ids = spark.createDataFrame([("t1",), ("t2",)], "id string")
    with pytest.raises(codecs.Corrupt, match="cycle"):
        trees.flatten(start, entries, ids)
    with pytest.raises(codecs.Corrupt, match="missing"):
        trees.flatten(start, entries.where("tree_id = 't1'"), ids.where("id = 't1'"))


def commits(spark, edges):
    return spark.createDataFrame([(i, p) for i, p in edges.items()], "id string, parents array<string>")


def test_history_and_revisions(spark):
    # A merge: m has first parent c, second parent d; both come from b.
    ids = {k: codecs.object_id("blob", k.encode()) for k in "abcdm"}
    edges = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "m": ["c", "d"]}
    frame = commits(spark, {ids[k]: [ids[p] for p in v] for k, v in edges.items()})
    back = {v: k for k, v in ids.items()}
    walk = lambda start, n: "".join(back[r.id] for r in graph.history(frame, ids[start], n).collect())
    assert walk("m", 9) == "mcbad" and walk("m", 2) == "mc" and walk("d", 9) == "dba"
    with pytest.raises(ValueError):
        graph.history(frame, ids["m"], 0)
    find = lambda r: back[graph.resolve(frame, ids["m"], r)]
    assert [find(r) for r in ("HEAD", "@", "@~", "HEAD~2", "@~1~2", ids["d"], ids["d"].upper(), ids["d"][:7] + "~", "@~~~")] == list("mmcbaddba")
    for bad in ("@~4", "HEAD~x", ids["d"][:6], "0000000", "", "~", "HEAD^"):
        with pytest.raises(graph.Unknown):
            find(bad)
    twins = commits(spark, {"abcdef0" + "0" * 57: [], "abcdef0" + "1" * 57: []})
    with pytest.raises(graph.Unknown, match="ambiguous"):
        graph.resolve(twins, None, "abcdef0")
    with pytest.raises(graph.Unknown):
        graph.resolve(twins, None, "HEAD")


def test_newest_locations(spark):
    rows = [("c0", "b/x", "1"), ("c0", "b-x", "1"), ("c1", "z", "1"), ("c1", "old", "2"), ("c2", "older", "2")]
    frame = spark.createDataFrame([(c, p, 1, i) for c, p, i in rows], "root string, path string, kind int, object_id string")
    ranks = spark.createDataFrame([("c0", 0), ("c1", 1), ("c2", 2)], "id string, rank long")
    got = {r.blob_id: (r.commit_id, r.path) for r in locate.newest_locations(frame, ranks).collect()}
    assert got == {"1": ("c0", "b-x"), "2": ("c1", "old")}


def test_cache_hits(spark):
    schema = "path string, size long, mtime_ns long, dev long, ino long"
    files = spark.createDataFrame([("same", 1, 10, 1, 1), ("size", 2, 10, 1, 1), ("time", 1, 11, 1, 1), ("ino", 1, 10, 1, 2), ("unknown", 1, 10, 0, 0), ("racy", 1, 99, 1, 1), ("lost", 1, 10, 1, 1)], schema)
    cached = spark.createDataFrame([(p, 1, 99 if p == "racy" else 10, 1, 1, "x" if p == "lost" else "b") for p in ("same", "size", "time", "ino", "unknown", "racy", "lost")], schema + ", blob_id string")
    assert sorted(r.path for r in cache_hits(files, cached, 99, spark.createDataFrame([("b",)], "id string")).collect()) == ["same", "unknown"]


def test_candidates_and_window(spark):
    r = random.Random(2)
    rows = [(f"{i:04}", r.choice(["a", "b", "\ufffd", "\U00010000"]), r.choice([10, 64, 100, 200])) for i in range(300)]
    ranked = repack.candidates(spark.createDataFrame(rows, "id string, name string, size long"))
    want = sorted((x for x in rows if x[2] >= 64), key=lambda x: (codecs.utf16(x[1]), -x[2], x[0]))
    assert {x.id: x.rn for x in ranked.collect()} == {x[0]: i + 1 for i, x in enumerate(want)}
    pairs = {(p.id, p.base_id, p.back) for p in repack.window_pairs(ranked).collect()}
    assert pairs == {(want[i][0], want[i - k][0], k) for i in range(len(want)) for k in range(1, 11) if i >= k}


def test_plan_is_greedy_and_free_of_cycles():
    rows = [{"id": i, "stored_bytes": 1000, "full_bytes": 500} for i in "abc"]
    made = repack.plan(rows, {"b": [("a", 100)], "c": [("a", 90), ("b", 90)]}, {})
    assert [(c.form, c.base_id, c.after, c.depth) for c in made] == [("full", None, 500, 0), ("delta", "a", 100, 1), ("delta", "a", 90, 1)]
    kept = repack.plan([{"id": "a", "stored_bytes": 100, "full_bytes": 96}, {"id": "b", "stored_bytes": 1000, "full_bytes": 500}], {"b": [("a", 10)]}, {"a": "b"})
    assert [(c.form, c.base_id, c.depth) for c in kept] == [("keep", "b", 1), ("full", None, 0)]
    chain = [{"id": str(i), "stored_bytes": 1000, "full_bytes": 500} for i in range(14)]
    made = repack.plan(chain, {str(i): [(str(i - 1), 10)] for i in range(1, 14)}, {})
    assert [c.depth for c in made] == [*range(11), 0, 1, 2]
    assert not repack.saves_enough(100, 96) and repack.saves_enough(100, 95) and not repack.saves_enough(0, 0)


def test_plan_of_stretches_is_the_plan_by_rows(spark):
    """The driver gets one row of numbers for a stretch of texts, not one for each pair, and the plan is the same."""
    r = random.Random(5)
    line = [r.randbytes(40).hex() for _ in range(30)]
    texts = [("\n".join(r.choices(line, k=r.randrange(8, 14))) + str(i)).encode() for i in range(700)]
    made = [(hashlib.sha256(t).hexdigest(), "n", len(t), bytearray(t)) for t in texts]
    blobs = spark.createDataFrame([*made, made[0]], "id string, name string, size long, canonical binary")  # a text that comes twice
    ranked = repack.candidates(blobs.drop("canonical").distinct())
    full = repack.full_sizes(blobs.select("id", "canonical").distinct())
    want = repack.plan_frame(ranked.join(full.withColumnRenamed("full_bytes", "stored_bytes"), "id"), repack.pair_sizes(ranked, blobs.select("id", "canonical").distinct()), full)
    stretches = repack.sized_stretches(ranked, blobs, ["id"]).cache()
    assert stretches.count() == 3
    got = repack.plan_of_stretches(stretches)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.agg(F.max("depth")).first()[0] == 10


def test_delta_keys_find_every_block():
    """The encoder looks at places with a block's key only, in a tenth of the time of a look at each byte."""
    r = random.Random(7)
    base = r.randbytes(100_000)
    target = b"".join(r.randbytes(r.randrange(40)) + base[i : i + 60] for i in range(0, 90_000, 900)) + r.randbytes(1 << 20) + base[:5000]
    index = delta.index_of(base)
    want = [i for i in range(len(target) - 15) if target[i : i + 16] in index.places]
    for piece in (1 << 20, 1 << 22):
        found = [i for start in range(0, len(target), piece) for i in (start + index.maybe(delta.keys_of(target, start, start + piece))).tolist()]
        assert set(want) <= set(found) and len(found) < len(target) // 10
    packed = delta.encode(base, target)
    assert packed == delta.encode(base, target, index, delta.keys_of(target, 0, len(target))) and delta.apply(base, packed) == target


def test_chunks(spark):
    assert search.pieces("") == [] and search.pieces(" \n ") == [] and search.pieces(None) == []
    long = "word " * 1000
    spans = search.bounds(long)
    assert spans[0] == (0, 1200) and spans[1][0] == 1005 and all(b - a <= 1200 for a, b in spans) and spans[-1][1] == len(long)
    assert search.bounds("x" * 3000) == [(0, 1200), (1000, 2200), (2000, 3000)]
    assert search.bounds("x" * 1100 + " " + "y" * 1100) == [(0, 1101), (1101, 2201)]
    blank = "a" + " " * 5000 + "b"
    rows = search.chunks(spark.createDataFrame([("i", blank), ("j", "x\ny" * 100), ("k", None)], "blob_id string, text string")).collect()
    assert [(r.blob_id, r.seq, r.snippet[:3], len(r.snippet)) for r in rows] == [("i", 0, "a", 1), ("i", 1, "b", 1), ("j", 0, "x y", 160)]


def test_search(spark):
    rows = [("b1", 0, "near", [1.0, 0.0]), ("b1", 1, "nearer", [0.9, 0.1]), ("b0", 0, "same", [1.0, 0.0]), ("b2", 0, "far", [0.0, 1.0]), ("b3", 0, "zero", [0.0, 0.0]), ("b4", 0, "first", [1.0, 1.0]), ("b4", 1, "second", [1.0, 1.0])]
    index = spark.createDataFrame(rows, "blob_id string, seq int, snippet string, vec array<float>")
    got = search.search(index, np.array([1.0, 0.0], np.float32), 10).collect()
    assert [(r.blob_id, r.snippet, round(r.score, 4)) for r in got] == [("b0", "same", 1.0), ("b1", "near", 1.0), ("b4", "first", 0.7071), ("b2", "far", 0.0), ("b3", "zero", 0.0)]
    assert [r.blob_id for r in search.search(index, np.array([1.0, 0.0], np.float32), 2).collect()] == ["b0", "b1"]
    assert search.search(index, np.array([1.0], np.float32), 0).collect() == []


def test_sparse_vectors_are_the_dense_ones(spark):
    texts = [("a", 0, "Cat cat dog, the fish fish fish"), ("b", 0, "the of"), ("c", 0, "dog dog cat 42")]
    frame = spark.createDataFrame(texts, "blob_id string, seq int, text string")
    sparse = {}
    for r in search.sparse_vectors(search.term_frequencies(frame)).collect():
        sparse.setdefault(r.blob_id, np.zeros(512))[r.bucket] = r.weight
    dense = {r.blob_id: np.array(r.vec) for r in search.vectors(frame.withColumn("snippet", F.lit(""))).collect()}
    assert set(sparse) == {"a", "c"} and not dense["b"].any()
    assert all(np.allclose(sparse[k], dense[k], atol=1e-6) for k in sparse)
    best = search.sparse_search(search.sparse_vectors(search.term_frequencies(frame)), "a dog", 5).collect()
    assert [r.blob_id for r in best] == ["c", "a"]


class Server(BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        vector = {"short": [1.0], "none": []}.get(body["prompt"], [3.0, 4.0])
        self.send_response(500 if body["prompt"] == "fail" else 200)
        self.end_headers()
        self.wfile.write(json.dumps({"embedding": vector}).encode())

    def log_message(self, *_):
        pass


def test_remote_embedder():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = search.RemoteEmbedder("m", f"http://127.0.0.1:{server.server_port}")
    assert np.allclose(model.embed(["x"])[0], [0.6, 0.8]) and model.dim() == 2 and model.name() == "ollama:m"
    for bad in ("fail", "short", "none"):
        with pytest.raises(RuntimeError):
            model.embed([bad])
    server.shutdown()
    assert search.embedder("builtin-lexical-v1").dim() == 512
    for bad in ("ollama:", "other"):
        with pytest.raises(ValueError):
            search.embedder(bad)


def put(folder, kind, payload, data=None):
    id_ = codecs.object_id(kind, payload)
    store.put(folder, id_, data or codecs.pack_legacy(codecs.canonical(kind, payload)))
    return id_


def test_object_store(spark, tmp_path):
    folder = str(tmp_path / "objects")
    rows = spark.createDataFrame([(codecs.object_id("blob", b"one"), "blob", bytearray(b"one"))] * 2, "id string, type string, payload binary")
    assert store.write_objects(rows, folder) == 1 and store.write_objects(rows, folder) == 0
    text_ = [b"line %d of a text that is long enough\n" % i * 30 for i in range(4)]
    ids = [codecs.object_id("blob", t) for t in text_]
    put(folder, "blob", text_[0])
    for i in (1, 2):  # a chain of deltas
        store.put(folder, ids[i], codecs.pack_delta(ids[i - 1], delta.encode(codecs.canonical("blob", text_[i - 1]), codecs.canonical("blob", text_[i]))))
    store.put(folder, "aa" * 32, codecs.pack_delta("bb" * 32, b"x"))
    store.put(folder, "cc" * 32, codecs.pack_delta("dd" * 32, b"x"))
    store.put(folder, "dd" * 32, codecs.pack_delta("cc" * 32, b"x"))
    store.put(folder, "ee" * 32, codecs.pack_legacy(codecs.canonical("blob", b"other")))
    store.put(folder, "ff" * 32, b"junk")
    got = {r.id: r for r in store.read_objects(spark, folder).collect()}
    assert [(bytes(got[ids[i]].payload), got[ids[i]].depth, got[ids[i]].error) for i in range(3)] == [(text_[i], i, None) for i in range(3)]
    assert "missing" in got["aa" * 32].error and "cycle" in got["cc" * 32].error and "digest" in got["ee" * 32].error and got["ff" * 32].form == "corrupt"
    gated = {r.id: r.error for r in store.read_objects(spark, folder, 1).collect()}
    assert gated[ids[0]] is None and "format 1" in gated[ids[1]]
    forms = {r.id: (r.form, r.base_id) for r in store.forms(store.stored_files(spark, folder)).collect()}
    assert forms[ids[0]] == ("legacy", None) and forms[ids[1]] == ("delta", ids[0]) and forms["ff" * 32][0] == "corrupt"
    assert store.read_objects(spark, str(tmp_path / "none")).collect() == []
    everything = sorted(got)
    assert [r.id for r in store.stored_ids(spark, folder).collect()] == everything
    for prefix in ("a", "aa", ids[0][:9], "0123"):
        assert [r.id for r in store.stored_ids(spark, folder, prefix).collect()] == [i for i in everything if i.startswith(prefix)]
    assert {r.form: r.objects for r in store.form_counts(store.stored_files(spark, folder)).collect()} == {"legacy": 2, "full": 1, "delta": 5, "corrupt": 1}


def test_fsck_findings(spark, tmp_path):
    folder = str(tmp_path / "objects")
    blob = put(folder, "blob", b"data")
    lost = "ab" * 32
    tree = put(folder, "tree", codecs.encode_tree([Entry("a", 1, False, blob), Entry("b", 1, False, lost), Entry("c", 2, False, blob)]))
    first = put(folder, "commit", codecs.encode_commit(codecs.Commit(tree, (), 0, 0, "m")))
    head = put(folder, "commit", codecs.encode_commit(codecs.Commit(tree, (first,), 0, 0, "m")))
    stray = put(folder, "blob", b"stray")
    refs = spark.createDataFrame([("refs/x", head), ("refs/y", blob), ("refs/z", "nope")], "name string, id string")
    found = {(r.severity, r.object_id, r.message) for r in fsck.check(store.read_objects(spark, folder), refs).collect()}
    assert found == {("error", lost, "object is missing"), ("error", blob, "referenced object is not a tree"), ("error", blob, "referenced object is not a commit"), ("error", "nope", "ref is not an object id: refs/z"), ("warning", stray, "object is not reachable")}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "tree_id string, object_id string")
    assert sorted(r.id for r in fsck.cycles(edges).collect()) == ["a", "b", "c"]
    os.makedirs(f"{folder}/zz")
    open(f"{folder}/zz/x", "w").close()
    assert fsck.unexpected_files(folder) == ["zz/x"]
