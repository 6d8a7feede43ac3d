"""Directory trees: decoding, roll-up from paths, and flattening to paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.functions import codecs
from casframe.functions.hashing import object_id, tree_entry_bytes, tree_payload, utf16_key
from casframe.operators.base import cut

ENTRY = "struct<pos:int,name:string,kind:tinyint,executable:boolean,object_id:string>"
LEAVES = "path, kind, executable, object_id"
MAX_DEPTH = 1000


def decoded_trees(objects: DataFrame, strict: bool = False) -> DataFrame:
    """(tree_id, entries, error) of the tree objects; strict checks order and flags as a verifier does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("pos", pa.int32()), ("name", pa.string()), ("kind", pa.int8()), ("executable", pa.bool_()), ("object_id", pa.string())])
        for b in batches:
            rows, errors = [], []
            for payload in b.column(1).to_pylist():
                try:
                    rows.append([(i, e.name, e.kind, e.executable, e.object_id) for i, e in enumerate(codecs.decode_tree(payload, strict))])
                    errors.append(None)
                except codecs.Corrupt as e:
                    rows.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(kind)), pa.array(errors, pa.string())], names=["tree_id", "entries", "error"])

    return objects.where("type = 'tree'").select("id", "payload").mapInArrow(run, f"tree_id string, entries array<{ENTRY}>, error string")


def stored_trees(roots: DataFrame, load: Callable[[str], bytes | None]) -> DataFrame:
    """(tree_id, entries) of the trees at and below the roots (id), level by level, each once; load gives a tree's payload.

    Nothing but trees is read.  Those without a payload that is sound have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(i, load(i)) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, p in got if p is not None], pa.string()), pa.array(["tree"] * sum(p is not None for _, p in got)), pa.array([p for _, p in got if p is not None], pa.binary())], names=["id", "type", "payload"])

    front = seen = cut(roots.select("id").distinct())
    rows = decoded_trees(roots.sparkSession.createDataFrame([], "id string, type string, payload binary"))
    for _ in range(MAX_DEPTH + 1):
        if front.isEmpty():
            break
        made = cut(decoded_trees(front.mapInArrow(run, "id string, type string, payload binary")).where("error IS NULL"))
        rows = rows.unionByName(made)
        down = made.select(F.explode("entries").alias("e")).where(f"e.kind = {codecs.DIRECTORY}").select(F.col("e.object_id").alias("id")).distinct()
        front = cut(down.join(seen, "id", "left_anti"))
        seen = cut(seen.unionByName(front))
    return rows.select("tree_id", "entries")


def tree_entries(objects: DataFrame) -> DataFrame:
    """One row per entry: tree_id, pos, name, kind, executable, object_id."""
    return decoded_trees(objects).select("tree_id", F.explode("entries").alias("e")).select("tree_id", "e.*")


def empty_tree_id() -> str:
    return codecs.object_id("tree", codecs.encode_tree([]))


def roll_up(leaves: DataFrame) -> DataFrame:
    """Tree objects of paths: (dir, id, payload), dir being empty for the root.

    leaves are (path, kind, executable, object_id); a directory among them is an empty
    one unless something lies below it.  Levels are joined from the deepest up, so there are as
    many rounds as path components; a directory's entries meet in one task, as they
    must for its bytes.
    """
    parts = F.split("path", "/")
    rows = leaves.select(
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("dir"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"), "kind", "executable", "object_id"
    )
    # All directories on the way to any path, and empty ones themselves.
    ups = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    own = leaves.where(f"kind = {codecs.DIRECTORY}").select(F.col("path").alias("dir"))
    dirs = cut(ups.unionByName(own).distinct().withColumn("depth", F.when(F.col("dir") == "", 0).otherwise(F.size(F.split("dir", "/")))))
    files = cut(rows.where(f"kind <> {codecs.DIRECTORY}"))
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return leaves.sparkSession.createDataFrame([("", empty_tree_id(), bytearray(codecs.encode_tree([])))], "dir string, id string, payload binary")
    done, below = None, None
    for depth in range(deepest, -1, -1):
        here = files.where(F.col("depth") == depth)
        if below is not None:
            here = here.unionByName(below)
        entry = F.struct(utf16_key("name").alias("key"), tree_entry_bytes(F.col("name"), F.col("kind"), F.col("executable"), F.col("object_id")).alias("bytes"))
        grouped = here.groupBy(F.col("dir").alias("d")).agg(F.collect_list(entry).alias("entries"))
        made = dirs.where(F.col("depth") == depth).join(grouped, F.col("dir") == F.col("d"), "left")
        payload = F.when(F.col("entries").isNull(), F.lit(bytearray(codecs.encode_tree([])))).otherwise(tree_payload(F.col("entries")))
        made = cut(made.select("dir", payload.alias("payload")).withColumn("id", object_id("tree", "payload")).select("dir", "id", "payload"))
        done = made if done is None else done.unionByName(made)
        up = F.split("dir", "/")
        below = made.select(
            F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("dir"), F.element_at(up, -1).alias("name"), F.lit(depth - 1).alias("depth"), F.lit(codecs.DIRECTORY).cast("tinyint").alias("kind"), F.lit(False).alias("executable"), F.col("id").alias("object_id")
        )
    return done


def flatten(roots: DataFrame, entries: DataFrame, tree_ids: DataFrame) -> DataFrame:
    """The leaves below each root: (root, path, kind, executable, object_id).

    roots are (root, tree_id) rows, tree_ids the (id) of all trees.  Each round joins the directories met to their entries;
    a directory without entries is a leaf.  Raises where a tree is its own ancestor,
    is missing, or lies too deep.
    """
    front = roots.select("root", F.col("tree_id").alias("at"), F.lit("").alias("path"), F.array(F.col("tree_id")).alias("above"), F.lit(False).alias("cyclic"))
    full = entries.select(F.col("tree_id").alias("full")).distinct()
    known = cut(tree_ids.select(F.col("id").alias("known")).distinct().join(full, F.col("known") == F.col("full"), "left").select("known", F.col("full").isNull().alias("empty")))
    leaves = None
    for _ in range(MAX_DEPTH + 1):
        front = cut(front.join(known, F.col("at") == F.col("known"), "left"))
        n, missing, cyclic = front.agg(F.count("*"), F.min(F.when(F.col("known").isNull(), F.col("at"))), F.min(F.when(F.col("cyclic"), F.col("at")))).first()
        if missing:
            raise codecs.Corrupt(f"tree is missing: {missing}")
        if cyclic:
            raise codecs.Corrupt(f"tree cycle at {cyclic}")
        if not n:
            break
        empty = front.where("empty AND path <> ''")
        empty = empty.select("root", "path", F.lit(codecs.DIRECTORY).cast("tinyint").alias("kind"), F.lit(False).alias("executable"), F.col("at").alias("object_id"))
        below = front.where("NOT empty").join(entries, F.col("at") == F.col("tree_id")).withColumn("path", F.concat("path", F.when(F.col("path") != "", "/").otherwise(""), "name"))
        found = below.where(f"kind <> {codecs.DIRECTORY}").select("root", *LEAVES.split(", ")).unionByName(empty)
        leaves = found if leaves is None else leaves.unionByName(found)
        dirs = below.where(f"kind = {codecs.DIRECTORY}")
        front = dirs.select("root", F.col("object_id").alias("at"), "path", F.concat("above", F.array("object_id")).alias("above"), F.array_contains("above", F.col("object_id")).alias("cyclic"))
    else:
        raise codecs.Corrupt("tree lies too deep")
    return leaves if leaves is not None else roots.sparkSession.createDataFrame([], "root string, path string, kind tinyint, executable boolean, object_id string")
