"""The queries against their SQL, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from casframe import plans
from casframe.streaming import follow_blobs, windowed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, duck, name):
    frame = plans.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    assert rows
    if name in plans.oracle_sql():
        cursor = duck.execute(plans.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert rows == sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 189
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down(spark):
    plan = plans.queries()["blob_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "Python" not in plan and "Arrow" not in plan


def test_stream_of_events(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = windowed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.event_type): r.n for r in windowed(spark.read.parquet(f"{tmp_path}/in")).collect()}
    assert {(r.start, r.event_type): r.n for r in spark.table("windows").collect()} == want


def test_stream_of_blobs(spark, tmp_path):
    rows = lambda *xs: spark.createDataFrame([(i, bytearray(t.encode())) for i, t in xs], "blob_id string, data binary")
    rows(("a", "first text"), ("b", "second text")).write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema("blob_id string, data binary").parquet(f"{tmp_path}/in")
    for more in (None, rows(("b", "second text"), ("c", "third"))):
        if more:
            more.write.mode("append").parquet(f"{tmp_path}/in")
        q = follow_blobs(source(), f"{tmp_path}/index", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r.blob_id for r in spark.read.parquet(f"{tmp_path}/index").collect()) == ["a", "b", "c"]
