"""The object store: one file for each object, under the first two digits of its id."""

from __future__ import annotations

import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casframe.functions import codecs, delta
from casframe.operators.base import cut

OBJECTS = "id string, type string, payload binary, size long, form string, base_id string, depth int, stored_bytes long, error string"


def _id():
    parts = [F.regexp_extract("path", r"([0-9a-f]{2})/([0-9a-f]{62})$", i) for i in (1, 2)]
    return F.concat(*parts).alias("id")


def stored_files(spark: SparkSession, objects_dir: str, prefix: str = "") -> DataFrame:
    """(id, data, stored_bytes) of every object file whose id has the prefix; its first digits choose the folders that are listed."""
    digit = "[0-9a-f]"
    folder = "".join(prefix[i : i + 1] or digit for i in range(2))
    files = spark.read.format("binaryFile").option("pathGlobFilter", digit * 62).load(f"{objects_dir}/{folder}/*")
    return files.select(_id(), F.col("content").alias("data"), F.col("length").alias("stored_bytes")).where(F.startswith("id", F.lit(prefix)))


def stored_ids(spark: SparkSession, objects_dir: str, prefix: str = "") -> DataFrame:
    """The ids alone, in order: no content is read."""
    if not any(True for _ in object_folders(objects_dir, prefix[:2])):
        return spark.createDataFrame([], "id string")
    return stored_files(spark, objects_dir, prefix).select("id").orderBy("id")


def form_counts(files: DataFrame) -> DataFrame:
    """Objects and bytes of each form."""
    return forms(files).groupBy("form").agg(F.count("*").alias("objects"), F.sum("stored_bytes").alias("bytes"))


def object_folders(objects_dir: str, prefix: str = "") -> Iterator[str]:
    """The folders with object files among those that begin with the prefix."""
    for d in sorted(os.listdir(objects_dir)) if os.path.isdir(objects_dir) else ():
        if re.fullmatch("[0-9a-f]{2}", d) and d.startswith(prefix) and any(re.fullmatch("[0-9a-f]{62}", f) for f in os.listdir(f"{objects_dir}/{d}")):
            yield d


def listed_ids(objects_dir: str, prefix: str) -> list[str]:
    """Ids with a prefix of two digits or more, from the listing of their one folder."""
    try:
        return sorted(i for f in os.listdir(f"{objects_dir}/{prefix[:2]}") if (i := prefix[:2] + f).startswith(prefix) and re.fullmatch("[0-9a-f]{64}", i))
    except FileNotFoundError:
        return []


def has_objects(objects_dir: str) -> bool:
    return next(object_folders(objects_dir), None) is not None


def forms(files: DataFrame) -> DataFrame:
    """id, form, base_id and stored_bytes, from the first bytes only."""
    head = F.hex(F.substring("data", 1, 38))
    known = head.rlike("^53564F320[12]0[12]")
    form = (
        F.when(F.substring(head, 2, 1) == "8", "legacy")
        .when(known & (F.substring(head, 9, 2) == "01"), "full")
        .when(known & (F.length(head) == 76), "delta")
        .otherwise("corrupt")
    )
    return files.select("id", form.alias("form"), F.when(form == "delta", F.lower(F.substring(head, 13, 64))).alias("base_id"), "stored_bytes")


def _opened(format_version: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, data, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                form, base, raw, error, large = codecs.form_of(data), None, None, None, None
                try:
                    if format_version < 2 and form in ("full", "delta"):
                        raise codecs.Corrupt("container object in a format 1 repository")
                    base, raw = codecs.base_of(data), codecs.unpack(data)
                except codecs.TooLarge:  # read in pieces; the payload stays in its file
                    try:
                        large = sum(map(len, codecs.payload_pieces(io.BytesIO(data).read, id_)))
                    except codecs.Corrupt as e:
                        error = str(e)
                except codecs.Corrupt as e:
                    error = str(e)
                out.append((id_, form, base, raw, size, error, large))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()))], names=["id", "form", "base_id", "raw", "stored_bytes", "error", "large"])

    return run


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got, errors = [], []
        for raw, base in zip(b.column("raw").to_pylist(), b.column("base").to_pylist(), strict=True):
            try:
                got.append(delta.apply(base, raw))
                errors.append(None)
            except delta.DeltaError as e:
                got.append(None)
                errors.append(f"invalid delta: {e}")
        keep = b.drop_columns(["raw", "base"])
        yield keep.append_column("canonical", pa.array(got, pa.binary())).append_column("error", pa.array(errors, pa.string()))


def resolved(files: DataFrame, format_version: int = 2, max_depth: int = codecs.MAX_DEPTH) -> DataFrame:
    """Canonical bytes of every stored object: deltas are joined to their bases, one level a round."""
    shape = "id string, form string, base_id string, raw binary, stored_bytes long, error string, large long"
    opened = cut(files.select("id", "data", "stored_bytes").mapInArrow(_opened(format_version), shape))
    whole = opened.where("form <> 'delta' OR error IS NOT NULL").select("id", "form", "base_id", "stored_bytes", F.lit(0).alias("depth"), F.col("raw").alias("canonical"), "error", "large")
    done, last = whole, whole.where("error IS NULL AND large IS NULL").select(F.col("id").alias("base_id"), F.col("canonical").alias("base"))
    left = opened.where("form = 'delta' AND error IS NULL").drop("error", "large")
    for depth in range(1, max_depth + 1):
        if left.isEmpty():
            break
        ready = left.join(last, "base_id").select("id", "form", "base_id", "stored_bytes", F.lit(depth).alias("depth"), "raw", "base")
        made = cut(ready.mapInArrow(_applied, "id string, form string, base_id string, stored_bytes long, depth int, canonical binary, error string"))
        if made.isEmpty():
            break
        done = done.unionByName(made, allowMissingColumns=True)
        left = cut(left.join(made.select("id"), "id", "left_anti"))
        last = made.where("error IS NULL").select(F.col("id").alias("base_id"), F.col("canonical").alias("base"))
    # What has no base that could be read: it is missing, broken, on a cycle, or too deep.
    bases = opened.select(F.col("id").alias("base_id"), F.lit(True).alias("stored"))
    bad = done.where("error IS NOT NULL").select(F.col("id").alias("base_id"), F.lit(True).alias("broken"))
    why = F.when(F.col("stored").isNull(), "delta base is missing").when(F.col("broken"), "delta base is corrupt").otherwise("delta chain is a cycle, broken, or too deep")
    rest = left.join(bases, "base_id", "left").join(bad, "base_id", "left").select("id", "form", "base_id", "stored_bytes", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("binary").alias("canonical"), why.alias("error"))
    return done.unionByName(rest, allowMissingColumns=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kinds, payloads, errors = [], [], []
        large = b.column("large").to_pylist()
        for data, error, n in zip(b.column("canonical").to_pylist(), b.column("error").to_pylist(), large, strict=True):
            kind = payload = None
            if not error and n is not None:
                kind = "blob"
            elif not error:
                try:
                    kind, payload = codecs.parse_canonical(data)
                except codecs.Corrupt as e:
                    error = str(e)
            kinds.append(kind)
            payloads.append(payload)
            errors.append(error)
        sizes = [n if p is None else len(p) for p, n in zip(payloads, large, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(kinds, pa.string()), pa.array(payloads, pa.binary()), pa.array(sizes, pa.int64()), b.column("form"), b.column("base_id"), b.column("depth"), b.column("stored_bytes"), pa.array(errors, pa.string())],
            names=["id", "type", "payload", "size", "form", "base_id", "depth", "stored_bytes", "error"],
        )


def read_objects(spark: SparkSession, objects_dir: str, format_version: int = 2) -> DataFrame:
    """Every object, decoded and checked against its id; error says what is wrong with the others.

    A legacy blob above MAX_PAYLOAD is checked in pieces and has its size and a null payload; read_pieces gives that.
    """
    if not has_objects(objects_dir):
        return spark.createDataFrame([], OBJECTS)
    return check_ids(resolved(stored_files(spark, objects_dir), format_version))


def check_ids(canonical: DataFrame) -> DataFrame:
    wrong = F.col("error").isNull() & (F.sha2("canonical", 256) != F.col("id"))
    rows = canonical.withColumn("error", F.when(wrong, "object digest does not match its id").otherwise(F.col("error")))
    return rows.mapInArrow(_parsed, OBJECTS)


def object_path(objects_dir: str, id_: str) -> str:
    return f"{objects_dir}/{id_[:2]}/{id_[2:]}"


def put(objects_dir: str, id_: str, data: bytes, replace: bool = False) -> bool:
    """Store an object's file under another name, sync it and rename it; whether it is new."""
    path = object_path(objects_dir, id_)
    if os.path.exists(path) and not replace:
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(draft, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)
    return True


def read_pieces(objects_dir: str, id_: str) -> Iterator[bytes]:
    """The payload of a legacy object of any size, from its file."""
    with open(object_path(objects_dir, id_), "rb") as f:
        yield from codecs.payload_pieces(f.read, id_)


def put_file(objects_dir: str, id_: str, source: str) -> bool:
    """Store a file of any size as a legacy blob, in pieces; whether it is new.  Raises ValueError where it is not that blob."""
    path = object_path(objects_dir, id_)
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path), exist_ok=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    head = codecs.header("blob", os.path.getsize(source))
    digest, stream = hashlib.sha256(head), zlib.compressobj()
    try:
        with open(source, "rb") as f, open(draft, "wb") as out:
            out.write(stream.compress(head))
            while piece := f.read(codecs.PIECE):
                digest.update(piece)
                out.write(stream.compress(piece))
            out.write(stream.flush())
            out.flush()
            os.fsync(out.fileno())
        if digest.hexdigest() != id_:
            raise ValueError(f"file changed while it was read: {source}")
        os.replace(draft, path)
    finally:
        if os.path.exists(draft):
            os.remove(draft)
    return True


def load(objects_dir: str, id_: str, format_version: int = 2) -> tuple[str, bytes]:
    """Type and payload of one stored object, from its file and those of its bases alone; raises Corrupt, or FileNotFoundError."""
    chain, at = [], id_
    while True:
        with open(object_path(objects_dir, at), "rb") as f:
            data = f.read()
        form = codecs.form_of(data)
        if format_version < 2 and form in ("full", "delta"):
            raise codecs.Corrupt("container object in a format 1 repository")
        chain.append((at, codecs.unpack(data)))
        if form != "delta":
            break
        if len(chain) > codecs.MAX_DEPTH:
            raise codecs.Corrupt("delta chain is a cycle, broken, or too deep")
        at = codecs.base_of(data)
    canonical = None
    for at, raw in reversed(chain):
        try:
            canonical = raw if canonical is None else delta.apply(canonical, raw)
        except delta.DeltaError as e:
            raise codecs.Corrupt(f"invalid delta: {e}") from None
        if hashlib.sha256(canonical).hexdigest() != at:
            raise codecs.Corrupt("object digest does not match its id")
    return codecs.parse_canonical(canonical)


def packed(kind: str, payload: bytes, format_version: int) -> bytes:
    data = codecs.canonical(kind, payload)
    return codecs.pack_legacy(data) if format_version < 2 or len(data) > codecs.MAX_PAYLOAD else codecs.pack_full(data)


def write_objects(objects: DataFrame, objects_dir: str, format_version: int = 2) -> int:
    """Store (id, type, payload) rows that are not stored yet, from the tasks; how many were new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = sum(put(objects_dir, i, packed(t, p, format_version)) for i, t, p in zip(*(c.to_pylist() for c in b.columns), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([new], pa.int64())], names=["new"])

    rows = objects.dropDuplicates(["id"]).select("id", "type", "payload")
    return rows.mapInArrow(run, "new long").agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0]
