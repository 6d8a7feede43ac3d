"""Snapshots, trees and commits made of the standard tables.

A document is a file: its text is the content, lang/source/doc_id.txt the path.  The
second snapshot is the first after a change: every seventh document is moved, every fifth
ended with a line, every eleventh made executable, every thirteenth turned into a link.
Commits are months of orders, each the parent of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casframe.functions.hashing import blob_id


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_snapshot(docs: DataFrame) -> DataFrame:
    """Leaves: path, kind, executable, object_id."""
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("path"), F.lit(1).cast("tinyint").alias("kind"), F.lit(False).alias("executable"), blob_id("text").alias("object_id"))


def second_snapshot(docs: DataFrame) -> DataFrame:
    nth = lambda n: F.col("doc_id") % n == 0
    path = F.concat(F.when(nth(7), "moved/").otherwise(""), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    kind = F.when(nth(13), 3).otherwise(1).cast("tinyint")
    text = F.when(nth(5), F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    return docs.select(path.alias("path"), kind.alias("kind"), (nth(11) & ~nth(13)).alias("executable"), blob_id(text).alias("object_id"))


FIRST_SQL = r"""first_snapshot AS (
  SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, 1 AS kind, false AS executable,
    sha256(encode('blob ' || strlen(text)) || '\x00'::BLOB || encode(text)) AS object_id
  FROM documents)"""

SECOND_SQL = r"""second_snapshot AS (
  SELECT CASE WHEN doc_id % 7 = 0 THEN 'moved/' ELSE '' END || lang || '/' || source || '/' || doc_id || '.txt' AS path,
    CASE WHEN doc_id % 13 = 0 THEN 3 ELSE 1 END AS kind, doc_id % 11 = 0 AND doc_id % 13 <> 0 AS executable,
    sha256(encode('blob ' || strlen(t)) || '\x00'::BLOB || encode(t)) AS object_id
  FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) ELSE text END AS t FROM documents))"""


def month_commits(orders: DataFrame) -> DataFrame:
    """Commits: id, parents, tree_id, epoch_sec, message; ids are hashes of the month."""
    months = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    before = F.lag("month").over(Window.orderBy("month"))
    id_ = lambda m: F.sha2(F.concat(F.lit("commit "), m), 256)
    rows = months.withColumn("before", before)
    return rows.select(
        id_(F.col("month")).alias("id"), F.when(F.col("before").isNull(), F.array().cast("array<string>")).otherwise(F.array(id_(F.col("before")))).alias("parents"), F.col("month"), "n", F.concat(F.lit("Orders of "), "month").alias("message")
    )


COMMITS_SQL = """months AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1),
commits AS (
  SELECT sha256('commit ' || month) AS id, month, n,
    CASE WHEN lag(month) OVER (ORDER BY month) IS NULL THEN NULL ELSE sha256('commit ' || lag(month) OVER (ORDER BY month)) END AS parent
  FROM months)"""
