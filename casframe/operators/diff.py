"""Differences between two sets of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.functions.codecs import DIRECTORY
from casframe.functions.hashing import utf16_key

_LEAF = ("kind", "executable", "object_id")


def _ancestors(leaves: DataFrame, deal) -> DataFrame:
    """Every directory that lies above some path."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return deal(leaves.where(F.contains("path", F.lit("/"))).select(F.explode(ups).alias("ancestor")), "ancestor").distinct()


#: Rows that a task of compare() holds about, where their number is given.
ROWS = 250_000


def compare(before: DataFrame, after: DataFrame, rows: int | None = None) -> DataFrame:
    """One row per changed path: status, path, before, after, not yet in order.

    A added, D deleted, T another kind, M other content or executable flag.  An empty
    directory that comes or goes only because something below it goes or comes is no change;
    the search for such paths is an equi-join with all ancestors of the other side.  With rows, the number of leaves of
    both sides, tasks grow in number with it; else the session deals, and adaptive plans merge to about one task a core.
    """
    deal = lambda df, key: df.repartition(rows // ROWS + 1, key) if rows is not None else df
    b = before.select("path", F.struct(*_LEAF).alias("before"))
    a = after.select("path", F.struct(*_LEAF).alias("after"))
    status = (
        F.when(F.col("before").isNull(), "A")
        .when(F.col("after").isNull(), "D")
        .when(F.col("before.kind") != F.col("after.kind"), "T")
        .when((F.col("before.object_id") != F.col("after.object_id")) | (F.col("before.executable") != F.col("after.executable")), "M")
    )
    changes = deal(b, "path").join(deal(a, "path"), "path", "full_outer").withColumn("status", status).where("status IS NOT NULL").select("status", "path", "before", "after")
    lone = lambda s, side: changes.where(f"status = '{s}' AND {side}.kind = {DIRECTORY}")
    added = deal(lone("A", "after"), "path").join(_ancestors(before, deal), F.col("path") == F.col("ancestor"), "left_anti")
    gone = deal(lone("D", "before"), "path").join(_ancestors(after, deal), F.col("path") == F.col("ancestor"), "left_anti")
    others = changes.where(f"NOT (status = 'A' AND after.kind = {DIRECTORY}) AND NOT (status = 'D' AND before.kind = {DIRECTORY})")
    return others.unionByName(added).unionByName(gone)


def in_order(changes: DataFrame) -> DataFrame:
    """Changes by the UTF-16 order of the whole path."""
    return changes.orderBy(utf16_key("path"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n"))
