"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards.  Shards of about the same
size form a tier; a tier that holds enough of them is merged, and files
that have reached the target size are left alone.  Each state of the store is a
numbered manifest that lists its shards.  A manifest is written under another name
and then given its number in one step that fails where the number is taken: a hard link
on local and NFS folders, a rename that does not overwrite on HDFS.  So of two writers one wins
and the other starts over, and readers see whole versions only.  Stores without such
a step (object stores that copy to rename) need another catalog and are not supported.

Data goes through Hadoop's file system.  Defined cases: an empty arrival commits nothing; nulls,
repeated rows, very long texts and columns of any name are stored as they are; all arrivals have
the first one's columns; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import time
import uuid
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.llm.common import shared_folder

#: Bytes of a finished shard, text bytes of an arriving one, shards of a tier that are merged, and the tiers' ratio.
TARGET_BYTES = 64 << 20
ARRIVAL_BYTES = 8 << 20
FAN_IN = 4
RATIO = 4
#: Seconds that files stay which no kept version lists: another writer may be about to commit them.
GRACE = 24 * 3600
#: Parts in which the query's documents arrive.
ARRIVALS = 3


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES) -> None:
        self.spark, self.root, self.target = spark, root.rstrip("/"), target_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def versions(self) -> list[int]:
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def shards(self, version: int | None = None) -> list[Shard]:
        have = self.versions()
        if not have:
            return []
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{have[-1] if version is None else version:08d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(text)]

    def _commit(self, base: int, shards: list[Shard]) -> bool:
        """Whether version base + 1 is now this list."""
        draft = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps([asdict(s) for s in sorted(shards, key=lambda s: s.path)]).encode()))
        stream.close()
        final = self._path(f"{self.root}/manifests/v{base + 1:08d}.json")
        try:
            return self._published(draft, final)
        finally:
            self._fs.delete(draft, False)

    def _published(self, draft, final) -> bool:
        """Whether final did not exist and is draft now, in one step."""
        if self._fs.getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), final.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def _change(self, new: list[Shard], old: frozenset[str] = frozenset()) -> int:
        """Commit the newest list without old and with new; the version, or -1 where old is no longer there."""
        while True:
            base = (self.versions() or [0])[-1]
            now = self.shards()
            if not old <= {s.path for s in now}:
                return -1
            if self._commit(base, [s for s in now if s.path not in old] + new):
                return base + 1

    def _written(self, df: DataFrame, rows: int = 0) -> list[Shard]:
        """The shards that df makes, without those that hold no row."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        found = [Shard(str(x.getPath().toString()), int(x.getLen())) for x in self._fs.listStatus(self._path(folder))]
        found = [s for s in found if s.path.endswith(".parquet")]
        if len(found) == 1 and self.spark.read.parquet(folder).isEmpty():  # Spark writes a file for a frame without rows
            self._fs.delete(self._path(folder), True)
            return []
        return found

    def rows_a_shard(self, arrivals: DataFrame, n_bytes: int) -> int:
        """Rows of the arrivals that hold about so many bytes of text."""
        texts = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)).cast("long") for c, kind in arrivals.dtypes if kind in ("string", "binary")]
        n, total = arrivals.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0).cast("long"))), F.lit(0))).first()
        return max(1, n * n_bytes // max(total, 1)) if n else 0

    def append(self, arrivals: DataFrame, rows: int | None = None, n_bytes: int = ARRIVAL_BYTES) -> int:
        """Store the arrivals as shards of about n_bytes of text, or of at most so many rows; the version."""
        new = self._written(arrivals, self.rows_a_shard(arrivals, n_bytes) if rows is None else rows)
        return self._change(new) if new else (self.versions() or [0])[-1]

    def tier(self, shard: Shard) -> int:
        return int(math.log(max(shard.bytes, 1), RATIO))

    def due(self) -> list[Shard]:
        """The shards of the lowest tier that has enough of them to merge."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.bytes < self.target // 2:
                tiers.setdefault(self.tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= FAN_IN), [])

    def compact(self) -> int:
        """Merge until no tier has enough shards; the version.

        The files of a run are of like size, so they are merged without a shuffle: each
        task reads as many of them as make up the target.
        """
        while run := self.due():
            n = max(1, round(sum(s.bytes for s in run) / self.target))
            n = min(n, len(run) // 2)
            merged = self._written(self.spark.read.parquet(*(s.path for s in run)).coalesce(n))
            if len(merged) >= len(run):  # no gain
                break
            self._change(merged, frozenset(s.path for s in run))
        return (self.versions() or [0])[-1]

    def vacuum(self, versions: int = 1, grace: float = GRACE) -> None:
        """Delete files that none of the newest versions lists and that are older than the grace, and older manifests.

        What another writer has written and not committed yet is younger, or that writer must start over.
        """
        have = self.versions()
        kept = have[-versions:] if versions else have[-1:]
        held = {s.path for v in kept for s in self.shards(v)}
        before = (time.time() - grace) * 1000
        if not self._fs.exists(self._path(f"{self.root}/data")):
            return
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            for x in self._fs.listStatus(folder.getPath()):
                if str(x.getPath().toString()) not in held and x.getModificationTime() <= before:
                    self._fs.delete(x.getPath(), False)
        for v in have:
            path = self._path(f"{self.root}/manifests/v{v:08d}.json")
            if v not in kept and self._fs.getFileStatus(path).getModificationTime() <= before:
                self._fs.delete(path, False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with _metadata for the shard's name."""
        return self.spark.read.parquet(*(s.path for s in self.shards(version)))


def shard_documents(docs: DataFrame, root: str | None = None, target_bytes: int = TARGET_BYTES, arrivals: int = ARRIVALS) -> DataFrame:
    """Store all documents, which arrive in parts, compacting after each; one row per document: doc_id, shard, shard_bytes, version.

    The store that this makes has no other writer, so nothing needs a grace.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}", target_bytes)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(arrivals))
    version = 0
    for i in range(arrivals):
        store.append(docs.where(part == i))
        version = store.compact()
        store.vacuum(grace=0)
    if not store.shards():
        return docs.limit(0).select("doc_id", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("version"))
    return store.read().select("doc_id", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).cast("long").alias("version"))
