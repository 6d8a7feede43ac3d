"""Queries against their SQL on tables that the standard ones do not have: shared and missing ids, empty and missing texts."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from casframe import plans
from casframe.functions import lexical, pdf
from casframe.operators import diff, search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, path, rows):
    made = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(made, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")


def compared(spark, path, name):
    """Rows of the query and of its SQL, as text."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    cursor = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted(str(r) for r in cursor.fetchall())
    return sorted(str(tuple(r)) for r in plans.queries()[name](spark, str(path)).select(*(F.col(f"`{n}`") for n in names)).collect()), want


@pytest.mark.parametrize("name", ["lexical_embed", "best_chunk_topk", "find_end_to_end", "tokenize_tf"])
@pytest.mark.parametrize("shared", [False, True])
def test_terms_of_a_text_stay_in_its_task(spark, tmp_path, name, shared):
    """Terms were dealt out by document and token, and again by token: many times the input on disk.  Ids that come twice still make one document."""
    rows = [(i, f"payment systems and word{i % 7} café {'bank ' * (i % 5)}٣ {i * i}") for i in range(40)] + [(90, ""), (91, None), (92, "the of")]
    rows += [(3, "banks again, payment again"), (None, "merchants\nbetween"), (None, "payment")] if shared else []
    documents(spark, tmp_path, rows)
    got, want = compared(spark, tmp_path, name)
    assert got == want and got
    if name in ("lexical_embed", "tokenize_tf") and not shared:
        plan = plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert "HashAggregate" not in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_scores_are_rows_of_texts(spark):
    """A score is made where the text is; vectors of all texts are neither stored nor dealt out."""
    rows = spark.createDataFrame([(1, "a dog"), (2, "cat"), (3, ""), (4, "dog dog cat")], "k int, text string")
    scored = search.text_scores(rows, "k", search.query_weights("dog"))
    assert "Exchange" not in scored._jdf.queryExecution().toString()
    assert {r.k: round(r.score, 4) for r in scored.collect()} == {1: 1.0, 4: round((1 + 0.693147) / (1 + (1 + 0.693147) ** 2) ** 0.5, 4)}


def test_printable_filter_of_empty_and_missing_texts(spark, tmp_path):
    documents(spark, tmp_path, [(1, ""), (2, None), (3, "ab\x01"), (4, "a" * 9 + "\x00"), (5, "\n"), (6, "\u200b\U0001f600e\u0301"), (7, "a\u0870\u20c0\U00016ac0"), (8, "a\U0002ebf0\u2ffc"), (None, "a")])
    got, want = compared(spark, tmp_path, "printable_filter")
    assert got == want and "(1, nan, True)" in got and "(2, None, None)" in got and "(7, 1.0, True)" in got
    got, want = compared(spark, tmp_path, "tokenize_tf")
    assert got == want and len(got) == 5


def test_embedding_of_many_texts_at_once():
    """Hashes, places and sums were taken token by token; together they give the same bytes, also where three tokens meet in a bucket."""
    texts = [" ".join(f"w{i * k % 1500}" for i in range(1400)) for k in (1, 3, 7)] + ["", "the of", "é" * 100 + " x x x " + "y" * 65]
    for text, made in zip(texts, lexical.embed_each(texts), strict=True):
        want = np.zeros(512, np.float32)
        for token, n in sorted(lexical.term_counts(text).items()):
            sign = 1 if lexical.fnv1a(b"sign:" + token.encode()) % 2 == 0 else -1
            want[lexical.fnv1a(token.encode()) % 512] += np.float32(1 + np.log(n)) * np.float32(sign)
        norm = np.float32(np.sqrt((want.astype(float) ** 2).sum()))
        assert (made == (want / norm if norm else want)).all() and made.dtype == np.float32
    row, bucket, weight = lexical.weights(texts)
    for i, made in enumerate(lexical.embed_each(texts)):
        dense = np.zeros(512)
        dense[bucket[row == i]] = weight[row == i]
        assert np.allclose(dense, made, atol=1e-6)
    assert pdf.printable_share("".join(map(chr, range(200)))) == (200 - 33 - 33 + 3 - 1) / 200


def test_tasks_of_a_comparison_grow_in_number(spark, monkeypatch):
    """Adaptive plans merged all to about one task a core, so that a task's memory grew with the input."""
    monkeypatch.setattr(diff, "ROWS", 1000)
    frame = plans.queries()["empty_dir_suppression"](spark, "/root/testdata/sf0.001")
    assert frame.rdd.getNumPartitions() >= 7
    assert {r.status for r in frame.select("status").distinct().collect()} == {"A", "D"}
