"""Integrity checks over the object store, as tables of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions import codecs
from casframe.functions.hashing import is_id, name_is_safe, utf16_key
from casframe.operators import graph, trees
from casframe.operators.base import cut

FINDINGS = "severity string, object_id string, message string"
MAX_TREE_DEPTH = 1000


def _rows(df: DataFrame, severity: str, id_: str, message) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(severity).alias("severity"), F.col(id_).alias("object_id"), text.alias("message"))


def entry_violations(entries: DataFrame) -> DataFrame:
    """What is wrong with entries (tree_id, pos, name, kind, executable), one row for each that breaks a rule."""
    key = utf16_key("name")
    before = F.lag(key).over(Window.partitionBy("tree_id").orderBy("pos"))
    message = (
        F.when(~name_is_safe("name"), "invalid tree entry name")
        .when(~F.col("kind").isin(codecs.FILE, codecs.DIRECTORY, codecs.SYMLINK), "unknown tree entry kind")
        .when(F.col("executable") & (F.col("kind") != codecs.FILE), "executable flag on a non-file entry")
        .when(F.col("before") == key, "duplicate tree entry")
        .when(F.col("before") > key, "tree entries are not sorted")
    )
    return entries.withColumn("before", before).select(F.col("tree_id").alias("object_id"), message.alias("message")).where("message IS NOT NULL")


def check(objects: DataFrame, heads: DataFrame) -> DataFrame:
    """Findings (severity, object_id, message) of decoded objects and refs (name, id).

    Commits are followed from the refs, then trees level by level, each object once.  Objects that
    nothing reaches are warnings.
    """
    stored = cut(objects.select("id", "type", "error"))
    commits = cut(graph.commits(objects.where("error IS NULL")))
    parsed = cut(trees.decoded_trees(objects.where("error IS NULL"), strict=True))
    found = _rows(heads.where(~is_id("id")), "error", "id", F.concat(F.lit("ref is not an object id: "), F.col("name")))
    starts = [r.id for r in heads.where(is_id("id")).select("id").distinct().collect()]  # refs are few
    reached = cut(graph.discovery(commits.where("error IS NULL"), starts).select("id", F.lit("commit").alias("want")))
    good = commits.where("error IS NULL").join(reached.select("id"), "id", "left_semi")
    found = found.unionByName(_rows(commits.where("error IS NOT NULL").join(reached.select("id"), "id", "left_semi"), "error", "id", F.col("error")))

    entries = cut(parsed.where("error IS NULL").select("tree_id", F.explode("entries").alias("e")).select("tree_id", "e.kind", "e.object_id").distinct())
    front = cut(good.select(F.col("tree_id").alias("id")).distinct())
    seen, depth = front, 0
    while not front.isEmpty() and depth <= MAX_TREE_DEPTH:
        down = entries.where(f"kind = {codecs.DIRECTORY}").join(front, F.col("tree_id") == F.col("id")).select(F.col("object_id").alias("id")).distinct()
        front = cut(down.join(seen, "id", "left_anti"))
        seen = cut(seen.unionByName(front))
        depth += 1
    if depth > MAX_TREE_DEPTH:
        found = found.unionByName(_rows(front, "error", "id", "tree is nested too deeply"))
    edges = entries.where(f"kind = {codecs.DIRECTORY}").join(seen, F.col("tree_id") == F.col("id"), "left_semi")
    found = found.unionByName(_rows(cycles(edges), "error", "id", "tree cycle"))
    reached = reached.unionByName(seen.withColumn("want", F.lit("tree")))
    found = found.unionByName(_rows(parsed.where("error IS NOT NULL").join(seen, F.col("tree_id") == F.col("id"), "left_semi"), "error", "tree_id", F.col("error")))
    blobs = entries.where(f"kind <> {codecs.DIRECTORY}").join(seen, F.col("tree_id") == F.col("id"), "left_semi").select(F.col("object_id").alias("id")).distinct()
    reached = cut(reached.unionByName(blobs.withColumn("want", F.lit("blob"))))

    pairs = reached.join(stored.withColumnRenamed("id", "s"), F.col("id") == F.col("s"), "left")
    bad = pairs.withColumn(
        "message",
        F.when(F.col("s").isNull(), "object is missing").when(F.col("error").isNotNull(), F.col("error")).when(F.col("type") != F.col("want"), F.concat(F.lit("referenced object is not a "), F.col("want"))),
    )
    found = found.unionByName(_rows(bad.where("message IS NOT NULL"), "error", "id", F.col("message")))
    rest = stored.join(reached.select("id").distinct(), "id", "left_anti")
    found = found.unionByName(_rows(rest, "warning", "id", "object is not reachable"))  # sound or not
    return found.distinct()


def cycles(edges: DataFrame) -> DataFrame:
    """Ids of trees that lie on a cycle or lead to one: what is left when leaves are pruned again and again."""
    left = cut(edges.select("tree_id", "object_id").distinct())
    while not left.isEmpty():
        inner = left.select(F.col("tree_id").alias("t")).distinct()
        kept = cut(left.join(inner, F.col("object_id") == F.col("t"), "left_semi"))
        if kept.count() == left.count():
            break
        left = kept
    return left.select(F.col("tree_id").alias("id")).distinct()


def unexpected_folders(objects_dir: str) -> list[str]:
    """Paths of the folders below the object store that are none of its own."""
    import os
    import re

    found = (os.path.relpath(os.path.join(folder, d), objects_dir) for folder, dirs, _ in os.walk(objects_dir) for d in dirs)
    return sorted(x for x in found if not re.fullmatch("[0-9a-f]{2}", x))


def unexpected_files(objects_dir: str) -> list[str]:
    """Paths below the object store that are no object files."""
    import os
    import re

    out = []
    for folder, _, files in os.walk(objects_dir):
        for f in files:
            path = os.path.relpath(os.path.join(folder, f), objects_dir)
            if not re.fullmatch(r"[0-9a-f]{2}/[0-9a-f]{62}", path):
                out.append(path)
    return sorted(out)
