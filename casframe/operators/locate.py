"""Where a blob is found: its newest commit and path, and its latest name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.functions.codecs import DIRECTORY
from casframe.functions.hashing import path_walk_key


def newest_locations(leaves: DataFrame, ranks: DataFrame) -> DataFrame:
    """(blob_id, commit_id, path) of each blob among leaves (root = commit id).

    The commit that a walk from the refs meets first wins; within it the last path
    in the order of a walk through its tree.
    """
    rows = leaves.where(f"kind <> {DIRECTORY}").join(ranks, F.col("root") == F.col("id"))
    best = F.max_by(F.struct("root", "path"), F.struct((-F.col("rank")).alias("r"), path_walk_key("path").alias("k")))
    return rows.groupBy("object_id").agg(best.alias("at")).select(F.col("object_id").alias("blob_id"), F.col("at.root").alias("commit_id"), F.col("at.path").alias("path"))


def name_hints(leaves: DataFrame, ranks: DataFrame) -> DataFrame:
    """(blob_id, name): the name that a blob was last seen under, oldest commit first.

    A tree that several commits share counts for the oldest of them only, as a walk that
    visits each tree once has it; parent is the id of the tree that holds the entry.
    """
    rows = leaves.where(f"kind <> {DIRECTORY}").join(ranks, F.col("root") == F.col("id")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    first = rows.groupBy("parent", "object_id", "name").agg(F.max(F.struct("rank", path_walk_key("path").alias("k"))).alias("seen"))
    best = F.max_by("name", F.struct((-F.col("seen.rank")).alias("r"), F.col("seen.k").alias("k")))
    return first.groupBy("object_id").agg(best.alias("name")).select(F.col("object_id").alias("blob_id"), "name")
