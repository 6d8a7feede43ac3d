"""Mixing, URL rules, sharding, chat formatting and the pipeline."""

import hashlib
import json
import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from casframe.llm import chat, mixing, queries, sharding, url_rules
from test_dedup import words

SF = "/root/testdata/sf0.001"


def targets(sizes, weights=(5, 2, 1)):
    """Water filling by the letter: share by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, free = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total, more = sum(weight[s] for s in free), 0.0
        for s in list(free):
            out[s] += left * weight[s] / total
            if out[s] >= 2 * sizes[s]:
                more += out[s] - 2 * sizes[s]
                out[s] = 2 * sizes[s]
                free.discard(s)
        left = more
    return out


def mixed(spark, rows):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()


def test_mix(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice((1, 3, 10, 40, 300)), r.choice(["src0"] * 6 + ["a", "Z", "\u00e9", None])) for i in range(3000)]
    rows += [(9001, None, "a"), (9002, "", "empty"), (9003, "x", None)]
    got = {x.doc_id: x for x in mixed(spark, rows)}
    assert sorted(got) == sorted(i for i, _, _ in rows)
    sizes, taken, largest = {}, {}, {}
    for i, t, s in rows:
        n = len(words(t))
        assert got[i].size == n and got[i].taken in (0, n, 2 * n) and got[i].taken == n * got[i].copies
        sizes[s] = sizes.get(s, 0) + n
        taken[s] = taken.get(s, 0) + got[i].taken
        largest[s] = max(largest.get(s, 0), n)
    want = targets(sizes)
    for i, _, s in rows:
        assert got[i].source_size == sizes[s] and got[i].target == pytest.approx(want[s])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 10)
    assert sorted(map(tuple, mixed(spark, rows))) == sorted(map(tuple, got.values()))


def test_mix_is_even(spark):
    """Like documents of a source are taken alike often: here one of each two or so."""
    rows = [(i, "w w w", "a" if i < 400 else "b") for i in range(800)]
    got = mixed(spark, rows)
    b = [x.copies for x in got if x.doc_id >= 400]
    assert sum(b) == round(targets({"a": 1200, "b": 1200})["b"] / 3)
    assert abs(sum(b[:200]) - sum(b) / 2) < 45


def test_mix_of_nothing(spark):
    assert mixed(spark, []) == []
    assert [tuple(x) for x in mixed(spark, [(1, None, None)])] == [(1, 0, 0, 0.0, 0, 0)]


def test_mixed_documents(spark):
    rows = [(i, "w " * 9, "s%d" % (i % 3), i) for i in range(60)] + [(7, "w " * 9, "s1", 7)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __copy long")
    verdicts = mixing.mix(docs)
    out = mixing.mixed_documents(docs, verdicts)
    assert out.columns == docs.columns
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {r.doc_id: r.n for r in verdicts.groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r.n}


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    ends = [rest.find(c) for c in "?#" if c in rest]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[: min(ends)] if ends else rest


def plain_rule(host, path):
    best = None
    for verdict, h, p in url_rules.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return best


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/de/x", "http://a.com/DE/", "http://xcom/de/", "http://a.example.org/es/1?x#y", "http://example.org/es", "ftp://Example.org/en/12", "http://example.org/en/2", "http://org", "http://org?q=/x", "http://u@h.com:80/fr/?a=1&b=2", "x://a://b.com/fr/", "http://spam.net/en/1", "http://spam.net/en/1"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"http://{'spam' if i % 2 else 'fine'}.net/en/{i}") for i in range(60)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels).collect()}
    for i, u in rows:
        host, path = plain_url(u)
        rule = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), u
        assert got[i].verdict == (rule[0] if rule else "block" if host == "spam.net" else "allow"), u
    assert got[101].mined_rule == "host:spam" and got[101].confidence == 1.0


def test_mined_rules_are_those_of_brute_force(spark):
    r = random.Random(1)
    rows = [([t for t in "abcdef" if r.random() < 0.4] or ["a"],) for _ in range(400)]
    rows = [(t, "b" in t and "c" in t and r.random() < 0.9) for (t,) in rows]
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.7)
    from itertools import combinations

    rules = {}
    for n in range(1, 7):
        for items in combinations("abcdef", n):
            hold = [bad for t, bad in rows if set(items) <= set(t)]
            if sum(hold) >= max(0.02 * len(rows), 5) and np.mean(hold) >= 0.7:
                if not any(set(s) < set(items) and rules[s] >= np.mean(hold) for s in rules):
                    rules[items] = np.mean(hold)
    assert {x.items: pytest.approx(x.confidence) for x in got} == rules
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, bad boolean")) == []


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=40_000)
    r = random.Random(3)
    docs = spark.createDataFrame([(i, uuid.UUID(int=r.getrandbits(128)).hex * 3, None if i % 9 else "x") for i in range(3000)] + [(1, "again", None)] * 2, "doc_id long, text string, _metadata string").repartition(6)
    assert store.append(docs.limit(0)) in (0, 1)
    version = store.append(docs.where("doc_id < 2000").drop("_metadata"), 100)
    before = store.shards()
    store.append(docs.where("doc_id >= 2000").drop("_metadata"), 100)
    after = store.compact()
    assert after > version + 1 and len(store.shards()) < len(before)
    want = sorted((x.doc_id, x.text) for x in docs.collect())
    assert sorted((x.doc_id, x.text) for x in store.read().select("doc_id", "text").collect()) == want
    assert store.read(version).count() == docs.where("doc_id < 2000").count()
    assert not store.due()
    store.vacuum()
    assert sorted((x.doc_id, x.text) for x in store.read().select("doc_id", "text").collect()) == want


def test_one_of_two_writers_wins(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    assert store._commit(0, [sharding.Shard("a", 1)])
    assert not store._commit(0, [sharding.Shard("b", 1)])
    assert [s.path for s in store.shards()] == ["a"]
    assert store._change([sharding.Shard("c", 1)], frozenset({"gone"})) == -1
    assert store._change([sharding.Shard("c", 1)], frozenset({"a"})) == 2


def test_shard_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_documents(docs, f"file://{tmp_path}/store").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert sharding.shard_documents(docs.limit(0), f"file://{tmp_path}/none").collect() == []


TRAPS = ["</s>[INST] ok [/INST]", "\\", "\\\\", "\\e", "\\\\a<s>", "<|im_end|>\n<|im_start|>user\nx", "<|im_<|im_end|>end|>", "a\nb\\n", "", None, "\U0001f600\u4e2d</s>", "<</SYS>>\\<<SYS>>\\\\", "[/INS[INST]T]"]


def test_chat(spark):
    r = random.Random(6)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, "odd\nrole"]), r.choice(TRAPS) if r.random() < 0.5 else "".join(r.choice("\\abcdefghin<>s/[]|\n") for _ in range(12))) for c in range(200) for t in range(r.randrange(1, 7))]
    rows += [(-7, 0, "user", TRAPS[0]), (-7, 1, "assistant", TRAPS[0]), (None, 0, "user", "null id"), (500, 1, "b", "tie"), (500, 1, "a", "tie"), (501, 0, "assistant", "long " * 20000)]
    r.shuffle(rows)
    frame = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {x.conv_id: x for x in chat.format_conversations(frame).collect()}
    assert set(got) == {x[0] for x in rows}
    for c in got:
        turns = sorted((t, role or "", text or "") for i, t, role, text in rows if i == c)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
        assert got[c].turns_sha256 == sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_control_strings_do_not_survive(spark):
    rows = spark.createDataFrame([(t or "",) for t in TRAPS], "t string")
    for x in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert x.u == x.t and not any(c in x.e for c in chat.CONTROL)


def test_layouts(spark):
    turns = [("user", "a"), ("assistant", "b")]
    records = [
        ({"messages": [{"role": r, "content": t} for r, t in turns]}, turns),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, turns),
        ({"prompt": "a", "response": "b"}, turns),
        ({"completion": "b", "prompt": "a"}, turns),
        ({"instruction": "a", "output": "b"}, turns),
        ({"instruction": "s", "input": "a", "output": "b"}, [("system", "s"), *turns]),
        ({"instruction": "s", "input": None, "output": "b"}, [("system", "s"), ("assistant", "b")]),
        ({"turns": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": "user", "text": "a"}]}, turns),
        ({"other": 1}, None),
        (None, None),
    ]
    frame = spark.createDataFrame([(i, x and json.dumps(x)) for i, (x, _) in enumerate(records)], "id long, record string")
    got = {r.id: r for r in chat.canonical_turns(frame).collect()}
    for i, (_, want) in enumerate(records):
        assert (got[i].turns and [tuple(t) for t in got[i].turns]) == want, records[i]
    assert len({got[i].fingerprint for i in range(7)}) == 6


def test_chat_with_a_text_longer_than_json_holds(spark):
    n = 20_000_001
    rows = spark.range(1).select(F.lit(1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.expr(f"repeat('x', {n})").alias("text"))
    got = chat.format_conversations(rows).first()
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (1, n, hashlib.sha256(b"x" * n).hexdigest())


def test_records_that_cannot_be_parsed_are_not_lost(spark):
    rows = spark.createDataFrame([('{"prompt": "a", "response": "b"}',), ('{"prompt": ',)], "record string")
    with pytest.raises(Exception, match="MALFORMED"):
        chat.canonical_turns(rows).collect()


def test_typed_turns_are_those_of_the_record(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, None, "a"), (1, None, "user", None)], "conv_id long, turn long, role string, text string")
    record = json.dumps({"turns": [{"turn": None, "role": "user", "text": ""}, {"turn": 0, "role": "", "text": "a"}, {"turn": 1, "role": "assistant", "text": "b"}]})
    want = chat.canonical_turns(spark.createDataFrame([(record,)], "record string")).first()
    got = chat.typed_turns(rows).first()
    assert (got.fingerprint, got.turns) == (want.fingerprint, want.turns)


def test_every_query_runs(spark):
    for name, query in queries.queries().items():
        assert query(spark, SF).count() > 0, name


def test_pipeline(spark):
    pytest.importorskip("corpus_pipeline")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from casframe.llm import exact_dedup, near_dedup, quality_rules
    from test_dedup import brute_exact, brute_near

    state = docs
    stages = dict(p.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    kept = {r.doc_id for r in quality_rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.kept}
    state = stages["quality_rules"](spark, state, SF)
    rows = {r.doc_id: r.text for r in state.collect()}
    assert set(rows) == kept and state.columns == docs.columns
    want = {r[0] for r in brute_exact(list(rows.items())) if r[3]}
    state = stages["exact_dedup"](spark, state, SF)
    rows = {r.doc_id: r.text for r in state.collect()}
    assert set(rows) == want and state.columns == docs.columns
    want = {i for i, (_, c) in brute_near(list(rows.items())).items() if i == c}
    state = stages["near_dedup"](spark, state, SF)
    assert {r.doc_id for r in state.collect()} == want and state.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.mix(state).collect() if r.copies}
    final = p.run(spark, SF)
    assert {r.doc_id: r.n for r in final.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == copies


def test_pipeline_stages_on_odd_rows(spark):
    p = pytest.importorskip("corpus_pipeline")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (2, "w " * 80, None, None, None), (2, "w " * 80, None, None, None)], schema)
    for frame in (odd, odd.limit(0), odd.selectExpr("*", "1 AS kept", "2 AS __digest", "3 AS size")):
        for name, stage in p.STAGES:
            out = stage(spark, frame, SF)
            out.collect()
            assert name == "byte_bpe" or out.columns == frame.columns


def test_labels_without_relation_to_urls_give_no_rules(spark):
    """Random labels over many token combinations, among them a planted one, which alone is found."""
    r = random.Random(8)
    hosts = [f"h{i}" for i in range(40)]
    rows = [([f"host:{r.choice(hosts)}", f"path:{r.choice('abcd')}", f"query:{r.choice('xyz')}"], r.random() < 0.25) for _ in range(3000)]
    mined = lambda rows: url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.001, z=url_rules.Z, margin=url_rules.MARGIN)
    assert mined(rows) == []
    held = [(["host:farm", f"path:{r.choice('abcd')}", "query:x"], r.random() < 0.95) for _ in range(120)]
    found = mined(rows + held[:60])
    assert [x.items for x in found] == [("host:farm",)]
    match = url_rules.matcher(found)
    hit = [bad for items, bad in rows[:1000] + held[60:] if match(items)]
    assert np.mean(hit) > 0.25 + url_rules.MARGIN


def test_labels_by_number(spark):
    urls = ["http://a.org/en/7?x", "https://b.com/de/8.html", "http://c.net/", None, "http://d.net/en/99999999999999999999", "http://e.net/en/9#/fr/7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, None), (None, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, url_rules.labels_by_number(pages, labels).collect())) == [(0, 1, 0), (1, 0, None)]


def test_url_verdicts_of_no_pages_and_long_urls(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://org/" + "a/" * 50_000)], "page_id long, url string")
    assert [(r.host, len(r.path), r.verdict) for r in url_rules.judge_urls(pages, none).collect()] == [("org", 100_001, "allow")]
    assert url_rules.judge_urls(pages.limit(0), none).collect() == []


def test_formatted_turns_say_where_the_loss_is(spark):
    """The text and mask of layouts other than rows, by hand: every character is accounted for."""
    records = [(1, [("user", "a<s>"), ("assistant", "b\nc"), ("assistant", "")]), (2, []), (3, None), (4, [(None, None), ("odd\n", "\\")])]
    rows = spark.createDataFrame(records, "id long, turns array<struct<role:string,text:string>>")
    got = {r.id: r for r in chat.format_turns(rows, "id").collect()}
    for i, turns in records:
        if turns is None:
            assert got[i].formatted is None and got[i].loss_mask is None
            continue
        text, mask = "", []
        for role, said in turns:
            said = (said or "").replace("\\", "\\\\").replace("<s>", "\\d")
            text += "<|im_start|>" + (role or "").replace("\n", "\\n") + "\n"
            if role == "assistant":
                mask.append((len(text) + 1, len(said)))
            text += said + "<|im_end|>\n"
        assert got[i].formatted == text and [tuple(m) for m in got[i].loss_mask] == mask
    back = chat.read_back(chat.format_turns(rows, "id").where("formatted <> ''"), "id").orderBy("id", "at").collect()
    assert [(r.id, r.role, r.text) for r in back if r.role is not None] == [(i, a or "", b or "") for i, turns in records for a, b in turns or ()]
    assert sorted((r.id, r.loss) for r in back if r.loss is not None) == [(1, ""), (1, "b\nc")]


def test_a_conversation_of_many_turns_takes_linear_time(spark):
    """200 MB in 300,000 turns of one conversation, which JSON values could not hold, with its exact digests."""
    n, size = 300_000, 700
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.rpad(F.col("id").cast("string"), size, "x").alias("text"))
    got = chat.format_conversations(rows).first()
    said = loss = 0
    turns, losses = hashlib.sha256(), hashlib.sha256()
    for i in range(n):
        text = str(i).ljust(size, "x").encode()
        turns.update(b"assistant\n" if i % 2 else b"user\n")
        turns.update(text + b"\n")
        if i % 2:
            losses.update(text)
            loss += size
        said += len("<|im_start|>\n<|im_end|>\n") + size + (9 if i % 2 else 4)
    assert tuple(got) == (1, n, turns.hexdigest(), loss, losses.hexdigest(), said)


def test_mix_keeps_clashing_columns(spark):
    names = ("__copy", "__rows", "__sum", "__key", "__whole", "size", "copies")
    rows = [(i, "w " * (5 + i % 3), f"s{i % 2}", *(100 * k + i for k in range(len(names)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    out = mixing.mixed_documents(docs, mixing.mix(docs))
    assert out.columns == docs.columns and out.count() > 30
    assert {tuple(r) for r in out.collect()} <= set(rows)


def test_mix_of_one_hot_id(spark):
    """Rows of a null id and of one id, each a third of all, get their shares without meeting one by one."""
    rows = [(None, "w w w", "a")] * 300 + [(7, "w w w w", "a")] * 300 + [(100 + i, "w w w", "b") for i in range(300)]
    got = mixed(spark, rows)
    assert len(got) == 900
    want = targets({"a": 2100, "b": 900})
    for lo, hi, s in ((0, 100, "a"), (100, 1000, "b")):
        taken = sum(r.taken for r in got if (lo <= (r.doc_id or 0) < hi))
        assert abs(taken - want[s]) <= 8
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.mixed_documents(docs, mixing.mix(docs)).count() == sum(r.copies for r in got)


def test_pivotal_rounding_is_random_in_all_places(spark):
    """Of 64 units of one half each every place wins half of the time, and pairs of places win together about as often as not."""
    n, units = 600, 64
    r = random.Random(2)
    for p in (0.5, 0.3):
        blocks = [(b, [(p, (i + 0.5) / units, r.random()) for i in range(units)]) for b in range(n)]
        frame = spark.createDataFrame(blocks, "b int, items array<struct<p:double,u:double,coin:double>>")
        won = np.zeros((n, units))
        for row in mixing._round(frame).select("b", "r.ones").collect():
            won[row.b, row.ones] = 1
        assert np.abs(won[:, :-1].mean(axis=0) - p).max() < 5 * math.sqrt(p * (1 - p) / n)
        assert set(won.sum(axis=1)) <= {math.floor(p * units + 1e-9), math.floor(p * units + 1e-9) - 1, math.ceil(p * units)}
        far = np.corrcoef(won[:, 2], won[:, 40])[0, 1]
        assert abs(far) < 0.2


def test_order_and_coin_of_a_unit_are_independent(spark):
    u = np.array([tuple(x) for x in spark.range(4000).select(mixing.uniform("id", F.lit(3), F.lit(0)), mixing.uniform("id", F.lit(3), F.lit(1))).collect()])
    assert abs(np.corrcoef(u.T)[0, 1]) < 0.06 and abs((u[:, 0] < 0.5).mean() - 0.5) < 0.04


def test_an_empty_arrival_commits_nothing(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert store.append(docs.limit(0)) == 0 and store.versions() == [] and store.append(docs) == 1
    assert store.append(docs.where("doc_id > 99")) == 1 and store.versions() == [1]
    assert sharding.shard_documents(docs.limit(0), f"file://{tmp_path}/none").collect() == []


def test_writers_that_race(spark, tmp_path):
    """Of several writers at once each gets a version of its own, and no shard is lost."""
    from concurrent.futures import ThreadPoolExecutor

    stores = [sharding.ShardStore(spark, f"file://{tmp_path}/store") for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda i: stores[i]._change([sharding.Shard(f"s{i}", i)]), range(6)))
    assert sorted(versions) == stores[0].versions() == [1, 2, 3, 4, 5, 6]
    assert {s.path for s in stores[0].shards()} == {f"s{i}" for i in range(6)}


def test_vacuum_spares_what_may_be_committed(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    store.append(docs)
    pending = store._written(docs)  # of another writer
    store.vacuum()
    assert store._change(pending) == 2 and store.read().count() == 20
    again = store._written(docs)
    store.vacuum(grace=0)
    assert store.versions() == [2] and store.read().count() == 20 and not any(store._fs.exists(store._path(s.path)) for s in again)


def test_arrivals_are_cut_by_bytes(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    docs = spark.range(1000).repartition(1).select(F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 400).alias("text"))
    assert 80 <= store.rows_a_shard(docs, 100_000) <= 95
    store.append(docs, n_bytes=100_000)
    assert 10 <= len(store.shards()) <= 13


def test_tiers_are_merged_as_in_a_plain_model(spark, monkeypatch, tmp_path):
    """Which shards are due, round by round, on made-up sizes, against the rule written out."""
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20)
    r = random.Random(1)
    held = [sharding.Shard(f"s{i}", r.choice((900, 5_000, 5_500, 70_000, 80_000, 300_000, 600_000, 2 << 20))) for i in range(40)]
    monkeypatch.setattr(store, "shards", lambda version=None: held)
    rounds = 0
    while due := store.due():
        tiers = {}
        for s in held:
            if s.bytes < (1 << 20) // 2:
                tier = 0
                while 4 ** (tier + 1) <= s.bytes:
                    tier += 1
                tiers.setdefault(tier, []).append(s)
        want = tiers[min(t for t in tiers if len(tiers[t]) >= 4)]
        assert due == want
        total = sum(s.bytes for s in due)
        n = min(max(1, round(total / (1 << 20))), len(due) // 2)
        held = [s for s in held if s not in due] + [sharding.Shard(f"m{rounds}-{k}", total // n) for k in range(n)]
        rounds += 1
    assert rounds >= 3


def test_shards_of_documents_have_their_sizes(spark, tmp_path):
    import os

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.shard_documents(docs, f"file://{tmp_path}/store").collect()
    sizes = {f: os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "store/data") for f in names}
    assert {r.shard_bytes for r in got} and all(sizes[r.shard] == r.shard_bytes for r in got)
    assert len({r.version for r in got}) == 1 and max(r.version for r in got) >= 3


def test_rules_are_mined_from_all_tokens_of_long_urls(spark):
    """What tells bad URLs stands behind 40 other tokens, which no two labelled URLs have in the same choice; and brute force over alike and nested tokens."""
    r = random.Random(12)
    spam = lambda i: i % 4 == 0
    rows = [(i, f"http://h{i % 7}.net/en/{i}/" + "/".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60) if k <= i % 60) + ("/buy?now=1" if spam(i) else "/read")) for i in range(600)]
    rows += [(9000, "http://x.net/en/1/" + "/".join(f"u{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)) + "/buy")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not spam(i)), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {x.page_id: x for x in url_rules.judge_urls(pages, labels).collect()}
    assert {i for i, x in got.items() if x.verdict == "block"} == {i for i in range(600) if spam(i)} | {9000}
    assert got[0].mined_rule == "query:now" and got[9000].mined_rule == "path:buy"

    from itertools import combinations

    names = "abcdefghijkl"
    rows = []
    for _ in range(300):
        t = {x for x in names[:7] if r.random() < 0.5} | {"a"}
        t |= {"i"} if "h" in t or "c" in t else set()
        t |= {"j"} if "c" in t else set()  # alike c
        t |= {"k", "l"} if "d" in t and "e" in t else set()
        rows.append((sorted(t), ("c" in t and "f" in t and r.random() < 0.9) or r.random() < 0.1))
    rules = {}
    for n in range(1, 6):
        for items in combinations(names, n):
            hold = [bad for t, bad in rows if set(items) <= set(t)]
            if sum(hold) >= max(0.02 * len(rows), 5) and np.mean(hold) >= 0.6 and not any(set(s) < set(items) and rules[s] >= np.mean(hold) for s in rules):
                rules[items] = np.mean(hold)
    assert rules and {x.items: pytest.approx(x.confidence) for x in url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6) if len(x.items) < 6} == rules


def test_conversations_are_read_as_their_fingerprint_says(spark):
    """Rows of three layouts give the same digests, by the mapping that the fingerprint of their columns selects; an unknown layout gives nulls."""
    turns = [(1, 1, "assistant", "b<s>"), (1, 0, "user", "a"), (2, 0, "assistant", None)]
    layouts = {
        ("turn", "role", "text"): turns,
        ("turn", "role", "content"): turns,
        ("turn", "from", "value"): [(c, n, {"user": "human", "assistant": "gpt"}[role], text) for c, n, role, text in turns],
        ("turn", "role", "value"): turns,
    }
    got = []
    for names, rows in layouts.items():
        frame = spark.createDataFrame(rows, "conv_id long, {} long, {} string, {} string".format(*names))
        out = {r.conv_id: r.asDict() for r in chat.format_conversations(frame).collect()}
        record = json.dumps(dict.fromkeys(names, ""))
        want = chat.canonical_turns(spark.createDataFrame([(record,)], "record string")).first().fingerprint
        assert {r.fingerprint for r in chat.single_turns(frame, "conv_id").collect()} == {want} and set(out) == {1, 2}
        got.append(out)
    assert got[0] == got[1] == got[2] and (got[0][1]["n_turns"], got[0][1]["loss_chars"]) == (2, 4)
    assert all(v is None for r in got[3].values() for c, v in r.items() if c != "conv_id")
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(frame, mappings=()).where("n_turns IS NOT NULL").isEmpty()
