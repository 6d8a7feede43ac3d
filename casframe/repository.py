"""A repository on disk, and its commands, composed of the operators.

Object contents are read and written by tasks; the driver holds the lock and
moves refs, last of all.  The name of the metadata folder and the word in its format
file are parameters.
"""

from __future__ import annotations

import contextlib
import fcntl
import os
import re
import shutil
import stat
import time
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.functions import codecs, delta
from casframe.operators import diff, fsck, graph, locate, repack, search, trees
from casframe.operators.base import cut
from casframe.sources import objects as store
from casframe.sources import worktree

LEAF = "path string, kind tinyint, executable boolean, object_id string"
MAX_REF_BYTES = 200


class RepositoryError(RuntimeError):
    pass


@dataclass(frozen=True)
class Layout:
    metadata: str = ".casframe"
    token: str = "casframe"
    branch: str = "refs/heads/main"


def sync_write(path: str, data: bytes) -> None:
    """Replace a file in one step."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(draft, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)
    folder = os.open(os.path.dirname(path), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


class Repository:
    def __init__(self, spark: SparkSession, root: str, layout: Layout = Layout()) -> None:
        self.spark, self.root, self.layout = spark, os.path.realpath(root), layout
        self.meta = os.path.join(self.root, layout.metadata)
        self.objects_dir = os.path.join(self.meta, "objects")
        self.clock = time.time_ns

    # Opening

    @classmethod
    def init(cls, spark: SparkSession, root: str, layout: Layout = Layout()) -> Repository:
        r = cls(spark, root, layout)
        if os.path.lexists(r.meta):
            raise RepositoryError(f"repository already exists: {r.meta}")
        os.makedirs(r.objects_dir)
        os.makedirs(os.path.dirname(os.path.join(r.meta, layout.branch)))
        sync_write(os.path.join(r.meta, "HEAD"), f"ref: {layout.branch}\n".encode())
        sync_write(os.path.join(r.meta, "format"), f"{layout.token} 1\n".encode())
        return r

    @classmethod
    def open(cls, spark: SparkSession, start: str, layout: Layout = Layout()) -> Repository:
        """The repository of the nearest folder at or above start that has one."""
        at = os.path.realpath(start)
        while not os.path.isdir(os.path.join(at, layout.metadata)):
            up = os.path.dirname(at)
            if up == at:
                raise RepositoryError(f"no repository at or above {start}")
            at = up
        r = cls(spark, at, layout)
        r.format_version  # noqa: B018
        r._ref()
        return r

    @property
    def format_version(self) -> int:
        try:
            text = open(os.path.join(self.meta, "format")).read().strip()
        except OSError:
            raise RepositoryError("repository has no format file") from None
        m = re.fullmatch(rf"{re.escape(self.layout.token)} ([12])", text)
        if not m:
            raise RepositoryError(f"unsupported repository format: {text}")
        return int(m[1])

    def _ref(self) -> str:
        try:
            text = open(os.path.join(self.meta, "HEAD")).read(MAX_REF_BYTES).strip()
        except OSError:
            raise RepositoryError("HEAD is missing") from None
        name = text.removeprefix("ref: ")
        if name == text or not name.startswith("refs/") or any(p in ("", ".", "..") for p in name.split("/")):
            raise RepositoryError("HEAD is malformed")
        return os.path.join(self.meta, name)

    def head(self) -> str | None:
        try:
            text = open(self._ref()).read(MAX_REF_BYTES).strip()
        except FileNotFoundError:
            return None
        if text and not re.fullmatch("[0-9a-f]{64}", text):
            raise RepositoryError("ref does not hold an object id")
        return text or None

    def refs(self) -> list[tuple[str, str]]:
        """(name, id) of every ref that is not empty, by id."""
        out = []
        for folder, _, files in os.walk(os.path.join(self.meta, "refs")):
            for f in files:
                path = os.path.join(folder, f)
                text = open(path).read(MAX_REF_BYTES).strip()
                if text:
                    out.append((os.path.relpath(path, self.meta), text))
        return sorted(out, key=lambda r: r[1])

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        """Held by one process at a time; a second one fails at once."""
        with open(os.path.join(self.meta, "lock"), "a") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise RepositoryError("another operation holds the repository lock") from None
            yield

    # Tables

    def objects(self) -> DataFrame:
        return store.read_objects(self.spark, self.objects_dir, self.format_version)

    def commits(self) -> DataFrame:
        rows = graph.commits(self.objects()).where("error IS NULL")
        return rows.drop("error")

    def commit(self, id_: str) -> codecs.Commit | None:
        """One commit, read from its own file; None where there is no such commit."""
        try:
            kind, payload = store.load(self.objects_dir, id_, self.format_version)
            return codecs.decode_commit(payload) if kind == "commit" else None
        except (FileNotFoundError, codecs.Corrupt):
            return None

    def walk(self, heads: list[str], limit: int | None = None) -> list[tuple[str, codecs.Commit]]:
        """The first commits that a walk from the heads meets, each read once; nothing else is."""
        out: dict[str, codecs.Commit] = {}

        def parents(id_: str) -> tuple[str, ...]:
            return out[id_].parents if id_ in out else ()

        for id_ in graph.walk(parents, heads):  # asks for a commit's parents after it has been given
            if found := self.commit(id_):
                out[id_] = found
                if len(out) == limit:
                    break
        return list(out.items())

    def commit_rows(self, walked: list[tuple[str, codecs.Commit]]) -> DataFrame:
        """A walk as a table: rank, id, tree_id, parents, epoch_sec, nano, message."""
        rows = [(n, i, c.tree_id, list(c.parents), c.epoch_sec, c.nano, c.message) for n, (i, c) in enumerate(walked)]
        return self.spark.createDataFrame(rows, "rank long, id string, tree_id string, parents array<string>, epoch_sec long, nano int, message string")

    def resolve(self, revision: str) -> str:
        """A commit's id; only files of ids with its prefix, and of commits on the way up, are read."""
        base, up = graph.parsed_revision(revision)
        head = self.head()
        if base in ("HEAD", "@"):
            if not head:
                raise graph.Unknown("no snapshots yet")
            found = [head]
        elif re.fullmatch(rf"[0-9a-fA-F]{{{graph.LEAST_PREFIX},64}}", base):
            found = [i for i in store.listed_ids(self.objects_dir, base.lower()) if self.commit(i)]
        else:
            found = []
        if len(found) != 1:
            raise graph.Unknown(f"{'ambiguous' if found else 'unknown'} revision: {revision}")
        at = found[0]
        for _ in range(up):
            parents = c.parents if (c := self.commit(at)) else ()
            if not parents:
                raise graph.Unknown("revision goes past the first snapshot")
            at = parents[0]
        return at

    def leaves(self, commits: DataFrame) -> DataFrame:
        """Leaves of commits (id, tree_id), with root = commit id; no blob is read."""
        objects_dir, version = self.objects_dir, self.format_version

        def load(id_: str) -> bytes | None:
            try:
                kind, payload = store.load(objects_dir, id_, version)
                return payload if kind == "tree" else None
            except (FileNotFoundError, codecs.Corrupt):
                return None

        found = cut(trees.stored_trees(commits.select(F.col("tree_id").alias("id")), load))
        entries = cut(found.select("tree_id", F.explode("entries").alias("e")).select("tree_id", "e.*"))
        return trees.flatten(commits.select(F.col("id").alias("root"), "tree_id"), entries, found.select(F.col("tree_id").alias("id")))

    def leaves_of(self, commit_id: str | None) -> DataFrame:
        if commit_id is None:
            return self.spark.createDataFrame([], LEAF)
        return self.leaves(self.commit_rows(self.walk([commit_id], 1))).drop("root")

    # Scanning

    def _cache_path(self) -> str:
        return os.path.join(self.meta, "cache")

    def cache(self) -> tuple[int, DataFrame]:
        try:
            data = open(self._cache_path(), "rb").read()
        except OSError:
            data = b""
        written, entries = codecs.decode_cache(data)
        return written, self.spark.createDataFrame([(e.path, e.size, e.mtime_ns, e.dev, e.ino, e.blob_id) for e in entries], "path string, size long, mtime_ns long, dev long, ino long, blob_id string")

    def stored_ids(self) -> DataFrame:
        return store.stored_ids(self.spark, self.objects_dir)

    def scan(self) -> DataFrame:
        """The working tree's rows with blob_id; unchanged files are taken from the cache without being read."""
        rows = cut(worktree.read_worktree(self.spark, self.root, self.layout.metadata))
        written, cached = self.cache()
        hits = cache_hits(rows.where(f"kind = {codecs.FILE}"), cached, written, self.stored_ids())
        files = rows.where(f"kind = {codecs.FILE}").join(hits.select("path", F.col("blob_id").alias("known")), "path", "left").select(*rows.columns, "known")
        old = files.where("known IS NOT NULL").withColumnRenamed("known", "blob_id")
        new = worktree.hashed(files.where("known IS NULL").drop("known"), self.root)
        links = rows.where(f"kind = {codecs.SYMLINK}").withColumn("blob_id", F.sha2(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length("link_target").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode("link_target", "UTF-8")), 256))
        dirs = rows.where(f"kind = {codecs.DIRECTORY}").withColumn("blob_id", F.lit(None).cast("string"))
        return cut(old.unionByName(new).unionByName(links).unionByName(dirs))

    @staticmethod
    def scan_leaves(scan: DataFrame) -> DataFrame:
        """Leaves of a scan: files, links, and directories in which nothing lies."""
        parts = F.split("path", "/")
        holding = scan.where(F.contains("path", F.lit("/"))).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("held")).distinct()
        empty = scan.where(f"kind = {codecs.DIRECTORY}").join(holding, F.col("path") == F.col("held"), "left_anti")
        empty = empty.withColumn("blob_id", F.lit(trees.empty_tree_id()))
        rows = scan.where(f"kind <> {codecs.DIRECTORY}").unionByName(empty.select(scan.columns))
        return rows.select("path", "kind", "executable", F.col("blob_id").alias("object_id"))

    def _refuse_if_restoring(self) -> None:
        try:
            lines = open(os.path.join(self.meta, "restore-in-progress")).read().splitlines()
        except FileNotFoundError:
            return
        if len(lines) > 1 and lines[1] == self.root:
            raise RepositoryError(f"a restore of {lines[0][:12]} was interrupted; run it again first")

    # Commands

    def snapshot(self, message: str = "Snapshot") -> str:
        """Store the working tree and a commit of it; the commit's id."""
        message = message.strip()
        if not message or "\0" in message:
            raise RepositoryError("message must not be empty or hold a NUL")
        with self.lock():
            self._refuse_if_restoring()
            now = self.clock()
            scan, version = self.scan(), self.format_version
            self._store_blobs(scan, version)
            made = cut(trees.roll_up(self.scan_leaves(scan)))
            store.write_objects(made.select("id", F.lit("tree").alias("type"), "payload"), self.objects_dir, version)
            root = made.where("dir = ''").first().id
            parent = self.head()
            payload = codecs.encode_commit(codecs.Commit(root, (parent,) if parent else (), now // 10**9, now % 10**9, message))
            id_ = codecs.object_id("commit", payload)
            store.put(self.objects_dir, id_, store.packed("commit", payload, version))
            rows = scan.where(f"kind = {codecs.FILE}").select("path", "size", "mtime_ns", "dev", "ino", "blob_id").toLocalIterator()
            sync_write(self._cache_path(), codecs.encode_cache(now, [codecs.CacheEntry(*r) for r in rows]))
            os.makedirs(os.path.dirname(self._ref()), exist_ok=True)
            sync_write(self._ref(), f"{id_}\n".encode())
            return id_

    def _store_blobs(self, scan: DataFrame, version: int) -> None:
        """Read and store each content that is new, from the tasks; a file that has changed since its scan is refused."""
        root, objects_dir = self.root, self.objects_dir
        known = self.stored_ids().select(F.col("id").alias("k"))
        new = scan.where(f"kind <> {codecs.DIRECTORY}").join(known, F.col("blob_id") == F.col("k"), "left_anti").dropDuplicates(["blob_id"]).select("path", "link_target", "blob_id")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, link, id_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    full = os.path.join(root, path)
                    if link is None and os.path.getsize(full) > codecs.MAX_PAYLOAD - codecs.MAX_HEADER:
                        store.put_file(objects_dir, id_, full)
                        continue
                    data = link.encode() if link is not None else open(full, "rb").read()
                    if codecs.object_id("blob", data) != id_:
                        raise ValueError(f"file changed while it was read: {path}")
                    store.put(objects_dir, id_, store.packed("blob", data, version))
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        new.mapInArrow(run, "n long").agg(F.sum("n")).first()

    def log(self, revision: str = "HEAD", limit: int = 50) -> DataFrame:
        """The first commits of the walk from a revision, with rank; only their files are read."""
        if limit < 1:
            raise ValueError("limit must be positive")
        return self.commit_rows(self.walk([self.resolve(revision)], limit)).orderBy("rank")

    def diff(self, before: str | None = None, after: str | None = None) -> DataFrame:
        """Changes in order; without after against the working tree, without before from HEAD."""
        if after is not None:
            return diff.in_order(diff.compare(self.leaves_of(self.resolve(before)), self.leaves_of(self.resolve(after))))
        with self.lock():
            self._refuse_if_restoring()
            start = self.resolve(before) if before is not None else self.head()
            return diff.in_order(diff.compare(cut(self.leaves_of(start)), cut(self.scan_leaves(self.scan()))))

    def upgrade(self) -> bool:
        with self.lock():
            if self.format_version == 2:
                return False
            sync_write(os.path.join(self.meta, "format"), f"{self.layout.token} 2\n".encode())
            return True

    def preflight(self, commit_id: str) -> DataFrame:
        """Leaves of a commit, once every object that it needs has been found sound."""
        leaves = cut(self.leaves_of(commit_id))
        blobs = leaves.where(f"kind <> {codecs.DIRECTORY}").select("object_id").distinct()
        objects_dir, version = self.objects_dir, self.format_version

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([blob_fault(objects_dir, i, version) for i in ids], pa.string())], names=["object_id", "error"])

        wrong = blobs.mapInArrow(run, "object_id string, error string").where("error IS NOT NULL").first()
        if wrong:
            raise RepositoryError(f"object {wrong.object_id} cannot be restored: {wrong.error}")
        clash = colliding_names(leaves).first()
        if clash:
            raise RepositoryError(f"names differ in case only: {clash.path}")
        return leaves

    def restore(self, revision: str, target: str | None = None, force: bool = False) -> str:
        """Write a commit's tree into the repository's own folder, or another one; HEAD stays."""
        own = target is None
        goal = self.root if own else os.path.abspath(target)
        with self.lock():
            self._guard(goal, own)
            commit_id = self.resolve(revision)
            rows = cut(self.preflight(commit_id))
            marker = os.path.join(self.meta, "restore-in-progress")
            again = os.path.exists(marker) and open(marker).read().splitlines()[:2] == [commit_id, goal]
            if not force and not again:
                if own:
                    changed = diff.compare(cut(self.leaves_of(self.head())), cut(self.scan_leaves(self.scan())))
                    if not changed.isEmpty():
                        raise RepositoryError("working tree has changes; use force to overwrite them")
                elif os.path.isdir(goal) and os.listdir(goal):
                    raise RepositoryError(f"target is not empty: {goal}")
            sync_write(marker, f"{commit_id}\n{goal}\n".encode())
            os.makedirs(goal, exist_ok=True)
            for name in os.listdir(goal):
                if own and name == self.layout.metadata:
                    continue
                path = os.path.join(goal, name)
                shutil.rmtree(path) if os.path.isdir(path) and not os.path.islink(path) else os.remove(path)
            materialise(rows, goal, self.objects_dir, self.format_version)
            if own:
                with contextlib.suppress(FileNotFoundError):
                    os.remove(self._cache_path())
            os.remove(marker)
            return commit_id

    def _guard(self, goal: str, own: bool) -> None:
        real = os.path.realpath(goal)
        if real == os.path.sep or real == os.path.realpath(os.path.expanduser("~")):
            raise RepositoryError(f"refusing to restore over {real}")
        if own:
            return
        if os.path.islink(goal):
            raise RepositoryError("target is a symbolic link")
        if os.path.exists(goal) and not os.path.isdir(goal):
            raise RepositoryError("target is not a directory")
        if os.path.commonpath([real, self.root]) in (real, self.root):
            raise RepositoryError("target overlaps the repository")

    def repack(self, dry_run: bool = False) -> DataFrame:
        """Rewrite reachable objects in their smallest form; the plan, with id, form, before and after."""
        if self.format_version != 2:
            raise RepositoryError("repository has format 1; upgrade it first")
        with self.lock():
            objects = cut(self.objects())
            head = self.head()
            if head is None:
                return self.spark.createDataFrame([], "id string, form string, base_id string, before long, after long, depth int")
            good = objects.where("error IS NULL AND payload IS NOT NULL")  # larger ones stay legacy
            commits = cut(graph.commits(good))
            ranks = cut(graph.discovery(commits, [head]))
            hints, tree_ids = self._reachable(good, commits, ranks)
            canonical = good.select("id", F.concat(F.encode(F.concat("type", F.lit(" "), F.col("size").cast("string")), "UTF-8"), F.unhex(F.lit("00")), "payload").alias("canonical"), "type", "stored_bytes", "base_id")
            wanted = cut(hints.select("id").unionByName(tree_ids).unionByName(ranks.select("id")).distinct())
            canonical = cut(canonical.join(wanted, "id", "left_semi"))
            full = cut(repack.full_sizes(canonical))
            blobs = canonical.where("type = 'blob'").join(hints, "id").select("id", "name", F.octet_length("canonical").cast("long").alias("size"), "stored_bytes", "base_id")
            ranked = cut(repack.candidates(blobs))
            sizes = cut(repack.pair_sizes(ranked, canonical))
            chosen = repack.plan_frame(ranked, sizes, full)
            rest = canonical.join(ranked.select("id"), "id", "left_anti").join(full, "id")
            small = F.col("full_bytes") < F.col("stored_bytes")
            enough = small & (F.col("stored_bytes") - F.col("full_bytes") >= F.col("stored_bytes") * repack.LEAST_SAVING)
            others = rest.where(enough).select("id", F.lit("full").alias("form"), F.lit(None).cast("string").alias("base_id"), F.col("stored_bytes").alias("before"), F.col("full_bytes").alias("after"), F.lit(0).alias("depth"))
            plan = cut(chosen.unionByName(others))
            if not dry_run:
                self._rewrite(plan.where("form <> 'keep'"), canonical)
            return plan

    def _reachable(self, good: DataFrame, commits: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, name) of the blobs that commits reach, and the ids of their trees.

        Trees are walked oldest commit first and each once; the last name that a blob has then
        is its hint.
        """
        entries = cut(trees.tree_entries(good.where("type = 'tree'")))
        at = commits.join(ranks, "id").groupBy("tree_id").agg(F.max("rank").alias("rank")).select("tree_id", "rank", F.array().cast("array<binary>").alias("walk"))
        seen = front = cut(at)
        named = None
        while not front.isEmpty():
            below = cut(front.join(entries, "tree_id").withColumn("walk", F.concat("walk", F.array(F.encode("name", "UTF-16BE")))))
            rows = below.where(f"kind <> {codecs.DIRECTORY}").select(F.col("object_id").alias("id"), "name", "rank", "walk")
            named = rows if named is None else named.unionByName(rows)
            first = below.where(f"kind = {codecs.DIRECTORY}").groupBy("object_id").agg(F.max("rank").alias("rank"), F.min_by("walk", F.struct(-F.col("rank"), F.col("walk"))).alias("walk"))
            up = first.select(F.col("object_id").alias("tree_id"), "rank", "walk").join(seen.select(F.col("tree_id").alias("t"), F.col("rank").alias("r")), F.col("tree_id") == F.col("t"), "left")
            front = cut(up.where("r IS NULL OR rank > r").select("tree_id", "rank", "walk"))
            seen = cut(seen.unionByName(front).groupBy("tree_id").agg(F.max("rank").alias("rank")).withColumn("walk", F.array().cast("array<binary>")))
        last = F.max_by("name", F.struct((-F.col("rank")).alias("r"), F.col("walk").alias("w")))
        return cut(named.groupBy("id").agg(last.alias("name"))), seen.select(F.col("tree_id").alias("id"))

    def _rewrite(self, plan: DataFrame, canonical: DataFrame) -> None:
        """Encode, decode again, and only then replace the files."""
        bases = canonical.select(F.col("id").alias("base_id"), F.col("canonical").alias("base"))
        rows = plan.select("id", "base_id").join(canonical.select("id", "canonical"), "id").join(bases, "base_id", "left").select("id", "base_id", "canonical", "base")
        objects_dir = self.objects_dir

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for id_, base_id, data, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    packed = codecs.pack_delta(base_id, delta.encode(base, data)) if base_id else codecs.pack_full(data)
                    back = delta.apply(base, codecs.unpack(packed)) if base_id else codecs.unpack(packed)
                    if back != data:
                        raise ValueError(f"object does not decode to itself: {id_}")
                    store.put(objects_dir, id_, packed, replace=True)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        rows.mapInArrow(run, "n long").agg(F.sum("n")).first()

    def _all_commits(self) -> tuple[DataFrame, DataFrame]:
        """All commits that refs reach, with rank, and their leaves."""
        heads = self.refs()
        for name, id_ in heads:
            if not re.fullmatch("[0-9a-f]{64}", id_):
                raise RepositoryError(f"ref does not hold an object id: {name}")
        commits = cut(self.commit_rows(self.walk([i for _, i in heads])))
        return commits, cut(self.leaves(commits))

    def _index_path(self) -> str:
        return os.path.join(self.meta, "index", "vectors")

    def index(self, embedder: str = search.LEXICAL) -> DataFrame:
        """Rebuild the search index; blobs, chunks and skipped."""
        model = search.embedder(embedder)
        with self.lock():
            objects = cut(self.objects().where("error IS NULL"))
            _, leaves = self._all_commits()
            ids = leaves.where(f"kind <> {codecs.DIRECTORY}").select(F.col("object_id").alias("id")).distinct()
            blobs = objects.where("type = 'blob'").join(ids, "id", "left_semi").select(F.col("id").alias("blob_id"), F.col("payload").alias("data"))
            texts = cut(search.extracted(blobs))
            made = cut(search.vectors(search.chunks(texts), model))
            draft = f"{self._index_path()}-{uuid.uuid4().hex}"
            made.withColumn("embedder", F.lit(model.name())).write.parquet(f"file://{draft}")
            with open(f"{draft}/_embedder", "w") as f:
                f.write(model.name())
            shutil.rmtree(self._index_path(), ignore_errors=True)
            os.replace(draft, self._index_path())
            return texts.agg(F.count("text").alias("blobs"), F.count_if(F.col("text").isNull()).alias("skipped")).crossJoin(made.agg(F.count("*").alias("chunks")))

    def export_index(self, path: str) -> None:
        """Write the index as one file in the interchange format."""
        rows = self.spark.read.parquet(f"file://{self._index_path()}").orderBy("blob_id", "seq")
        name = open(f"{self._index_path()}/_embedder").read()
        entries = [codecs.VectorEntry(r.blob_id, r.seq, r.snippet, tuple(r.vec)) for r in rows.toLocalIterator()]
        dim = len(entries[0].vector) if entries else max(search.embedder(name).dim(), 1)
        sync_write(path, codecs.encode_index(codecs.VectorIndex(name, dim, entries)))

    def find(self, query: str, limit: int = 5) -> DataFrame:
        """The best matches where they are now: blob_id, path, commit_id, message, snippet, score."""
        with self.lock():
            if not os.path.exists(f"{self._index_path()}/_embedder"):
                raise RepositoryError("there is no search index yet")
            model = search.embedder(open(f"{self._index_path()}/_embedder").read())
            index = self.spark.read.parquet(f"file://{self._index_path()}")
            best = cut(search.search(index, model.embed([query])[0], limit))
            commits, leaves = self._all_commits()
            where = locate.newest_locations(leaves, commits.select("id", "rank"))
            return search.located(best, where, commits).select("blob_id", "path", "commit_id", "message", "snippet", "score").orderBy(F.desc("score"), "blob_id")

    def fsck(self) -> list[tuple[str, str | None, str]]:
        return fsck_folder(self.spark, self.root, self.layout)


def fsck_folder(spark: SparkSession, root: str, layout: Layout = Layout()) -> list[tuple[str, str | None, str]]:
    """All findings (severity, object id, message) about the repository of a folder."""
    r = Repository(spark, root, layout)
    if not os.path.isdir(r.meta):
        return [("error", None, "no metadata directory")]
    out: list[tuple[str, str | None, str]] = []
    version, refs = 2, []
    try:
        version = r.format_version
    except RepositoryError as e:
        out.append(("error", None, str(e)))
    try:
        r._ref()
    except RepositoryError as e:
        out.append(("error", None, str(e)))
    if os.path.exists(os.path.join(r.meta, "restore-in-progress")):
        out.append(("warning", None, "a restore was interrupted"))
    if os.path.isdir(os.path.join(r.meta, "refs")):
        refs = r.refs()
        if not refs:
            out.append(("note", None, "no refs"))
    else:
        out.append(("error", None, "refs directory is missing"))
    if not os.path.isdir(r.objects_dir):
        return [*out, ("error", None, "object database is missing")]
    out += [("warning", None, f"unexpected file in the object store: {p}") for p in fsck.unexpected_files(r.objects_dir)]
    out += [("warning", None, f"unexpected directory in the object store: {p}") for p in fsck.unexpected_folders(r.objects_dir)]
    objects = store.read_objects(spark, r.objects_dir, version)
    found = fsck.check(cut(objects), spark.createDataFrame(refs, "name string, id string"))
    return out + [tuple(x) for x in found.orderBy("severity", "object_id", "message").toLocalIterator()]


def cache_hits(files: DataFrame, cached: DataFrame, written_at: int, stored: DataFrame) -> DataFrame:
    """(path, blob_id) of files that need not be read again.

    Size and times must agree, device and inode where both are known, the file must
    be older than the cache, and its blob must be stored.
    """
    f, c = files.alias("f"), cached.alias("c")
    same = lambda x: (F.col(f"f.{x}") == F.col(f"c.{x}")) | (F.col(f"f.{x}") == 0) | (F.col(f"c.{x}") == 0)
    hit = (F.col("f.size") == F.col("c.size")) & (F.col("f.mtime_ns") == F.col("c.mtime_ns")) & (F.col("f.mtime_ns") < written_at) & same("dev") & same("ino")
    rows = f.join(c, (F.col("f.path") == F.col("c.path")) & hit).select(F.col("f.path").alias("path"), F.col("c.blob_id").alias("blob_id"))
    return rows.join(stored.select(F.col("id").alias("k")), F.col("blob_id") == F.col("k"), "left_semi")


def colliding_names(leaves: DataFrame) -> DataFrame:
    """Paths of a directory whose names fold to the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unicodedata.normalize("NFC", p).lower() for p in b.column(0).to_pylist()])], names=["path", "key"])

    parts = F.split("path", "/")
    ups = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("path")).distinct()
    return ups.mapInArrow(run, "path string, key string").groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n > 1")


def blob_fault(objects_dir: str, id_: str, version: int) -> str | None:
    """Why a blob cannot be restored, or None; large ones are read in pieces."""
    try:
        try:
            kind, _ = store.load(objects_dir, id_, version)
            return None if kind == "blob" else "it is not a blob"
        except codecs.TooLarge:
            for _ in store.read_pieces(objects_dir, id_):
                pass
            return None
    except FileNotFoundError:
        return "it is missing"
    except codecs.Corrupt as e:
        return str(e)


def materialise(rows: DataFrame, goal: str, objects_dir: str, version: int) -> None:
    """Write (path, kind, executable, object_id) below a folder, from the tasks, each file from its object's."""

    def pieces(id_: str) -> Iterator[bytes]:
        try:
            yield store.load(objects_dir, id_, version)[1]
        except codecs.TooLarge:
            yield from store.read_pieces(objects_dir, id_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, executable, id_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                to = os.path.join(goal, path)
                os.makedirs(to if kind == codecs.DIRECTORY else os.path.dirname(to), exist_ok=True)
                if kind == codecs.SYMLINK:
                    link = b"".join(pieces(id_)).decode()
                    if not link or "\0" in link:
                        raise ValueError(f"invalid link target: {path}")
                    with contextlib.suppress(FileNotFoundError):
                        os.remove(to)
                    os.symlink(link, to)
                elif kind == codecs.FILE:
                    draft = f"{to}.{uuid.uuid4().hex}.tmp"
                    with open(draft, "wb") as f:
                        for piece in pieces(id_):
                            f.write(piece)
                    os.chmod(draft, stat.S_IRUSR | stat.S_IWUSR | (0o111 if executable else 0))
                    os.replace(draft, to)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows.select("path", "kind", "executable", "object_id").mapInArrow(run, "n long").agg(F.sum("n")).first()
