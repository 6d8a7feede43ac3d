"""A working tree as a table: a Python data source over lstat.

    spark.dataSource.register(WorktreeSource)
    spark.read.format("worktree").option("path", root).option("metadata", ".casframe").load()

The driver lists directories only until there are enough of them to deal out; tasks
walk the rest.  Symbolic links are not followed, and empty directories are rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from casframe.functions.codecs import DIRECTORY, FILE, SYMLINK

SCHEMA = "path string, name string, kind tinyint, executable boolean, size long, mtime_ns long, dev long, ino long, link_target string"
_BAD_UTF8 = re.compile("[\udc80-\udcff]+")
READ_BYTES = 1 << 20


def clean(name: str) -> str:
    """Each run of bytes that are not UTF-8 becomes one replacement character."""
    return _BAD_UTF8.sub("�", name)


def row(root: str, path: str, st: os.stat_result) -> tuple:
    mode = st.st_mode
    if stat.S_ISREG(mode):
        kind = FILE
    elif stat.S_ISDIR(mode):
        kind = DIRECTORY
    elif stat.S_ISLNK(mode):
        kind = SYMLINK
    else:
        raise ValueError(f"unsupported file type: {path}")
    link = clean(os.readlink(os.path.join(root, path))) if kind == SYMLINK else None
    shown = clean(path)
    return shown, shown.rsplit("/", 1)[-1], kind, kind == FILE and bool(mode & 0o111), st.st_size, st.st_mtime_ns, st.st_dev, st.st_ino, link


def children(root: str, folder: str, metadata: str) -> Iterator[tuple[str, os.stat_result]]:
    """The entries of a folder, without the repository's own metadata and that of nested repositories."""
    with os.scandir(os.path.join(root, folder)) as entries:
        for e in entries:
            if e.name == metadata and (not folder or os.path.isfile(os.path.join(e.path, "format"))):
                continue
            yield f"{folder}/{e.name}" if folder else e.name, e.stat(follow_symlinks=False)


class Part(InputPartition):
    def __init__(self, folders: list[str], rows: list[tuple]) -> None:
        self.folders, self.rows = folders, rows


class WorktreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.metadata = options["path"], options.get("metadata", ".casframe")
        self.wanted = int(options.get("partitions", "64"))

    def partitions(self) -> list[Part]:
        open_, rows = [""], []
        while open_ and len(open_) < self.wanted:
            deeper = []
            for folder in open_:
                for path, st in children(self.root, folder, self.metadata):
                    rows.append(row(self.root, path, st))
                    if stat.S_ISDIR(st.st_mode):
                        deeper.append(path)
            open_ = deeper
        return [Part(open_[i :: self.wanted], rows[i :: self.wanted]) for i in range(min(self.wanted, max(len(open_), len(rows), 1)))]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from partition.rows
        pending = list(partition.folders)
        while pending:
            for path, st in children(self.root, pending.pop(), self.metadata):
                yield row(self.root, path, st)
                if stat.S_ISDIR(st.st_mode):
                    pending.append(path)


class WorktreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorktreeReader(self.options)


def read_worktree(spark, root: str, metadata: str = ".casframe") -> DataFrame:
    spark.dataSource.register(WorktreeSource)
    return spark.read.format("worktree").option("path", root).option("metadata", metadata).load()


def identity(st: os.stat_result) -> tuple:
    return st.st_size, st.st_mtime_ns, st.st_dev, st.st_ino


def file_id(path: str) -> tuple[str, tuple]:
    """A file's blob id, read in pieces, and its size, mtime, device and inode; raises where it changes meanwhile."""
    before = os.lstat(path)
    digest, n = hashlib.sha256(b"blob %d\0" % before.st_size), 0
    with open(path, "rb") as f:
        while piece := f.read(READ_BYTES):
            digest.update(piece)
            n += len(piece)
    if n != before.st_size or identity(os.lstat(path)) != identity(before):
        raise ValueError(f"file changed while it was read: {path}")
    return digest.hexdigest(), identity(before)


def hashed(files: DataFrame, root: str) -> DataFrame:
    """The file rows with blob_id, each read once where its task runs."""
    own = files.schema.names
    at = {c: own.index(c) for c in ("path", "size", "mtime_ns", "dev", "ino")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for path, *seen in zip(*(b.column(at[c]).to_pylist() for c in at), strict=True):
                id_, now = file_id(os.path.join(root, path))
                if tuple(seen) != now:
                    raise ValueError(f"file changed while it was scanned: {path}")
                ids.append(id_)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.string())], names=[*own, "blob_id"])

    return files.mapInArrow(run, files.schema.simpleString()[7:-1].replace(":", " ") + ", blob_id string")
