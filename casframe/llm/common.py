"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at a time.
SLICE_BYTES = 2 << 20
#: Entries after which a word cache starts anew, and the bytes of a word that it remembers: together they bound a worker's memory.
CACHE_ENTRIES, CACHE_WORD = 300_000, 64
#: bytes.split() parts words at exactly these bytes, and no others.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def stream64(x: np.ndarray, step: int) -> np.ndarray:
    """The step-th value of a random stream seeded by each element."""
    with np.errstate(over="ignore"):
        return mix64(x + _GOLDEN * np.uint64(step + 1))


class WordHashes(dict):
    """Word bytes to a 64-bit hash; short words are remembered, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_WORD:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of (first row, texts as bytes) of a binary column of about max_bytes each."""
    lengths = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > max_bytes:
            yield start, column.slice(start, i - start).to_pylist()
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield start, column.slice(start).to_pylist()


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes, so that workers need not decode it."""
    return F.col(f"`{column}`").cast("binary")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a session in one process may do without and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="casframe-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, with its lineage cut.

    The files outlive lost executors, and Spark removes them with the frame.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of frames that are no longer held.

    It does so when the driver's JVM finds them unreachable, which may be long after a loop's round has left them.
    """
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: A key with more than one in so many rows is hot: there are fewer such keys than that.
HOT_SHARE = 1024


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """left joined to right, which has one row and the number of left's rows, n, for each key.

    Keys that hold more than 1 / HOT_SHARE of left's total rows, fewer than HOT_SHARE by that
    definition, are told by their hashes and broadcast, so their rows stay where they are; the others
    meet in a shuffle, whose keys are small.  Null keys are left out.  right should be stored.
    """
    hashed = F.xxhash64(*keys)
    found = [r[0] for r in right.where(F.col(n) > max(total // HOT_SHARE, 1)).select(hashed).collect()]
    if not found:
        return left.join(right, keys)
    hot = hashed.isin(found)
    return left.where(hot).join(F.broadcast(right.where(hot)), keys).unionByName(left.where(~hot).join(right.where(~hot), keys))


def remove_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def whole_rows(docs: DataFrame):
    """All columns of a row as one struct, so that no helper column can clash with any of them."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """All rows of distinct doc_id, or about so many of them, chosen by hash: no task gathers more than its own."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * most / n))


def kth_largest(rows: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a long column, by passes over counts of 16 bits each; null where there are fewer."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    if k <= 0 or low is None:
        return None
    bits = max(int(low).bit_length(), int(high).bit_length()) if low >= 0 else 64
    prefix, rest = None, k
    for shift in range(16 * max(-(-bits // 16) - 1, 0), -1, -16):
        some = rows if prefix is None else rows.where(F.shiftright(key, shift + 16) == prefix)
        for row in sorted(some.groupBy(F.shiftright(key, shift).alias("d")).count().collect(), reverse=True):  # 65,536 rows at most
            if row["count"] >= rest:
                prefix = row["d"]
                break
            rest -= row["count"]
        else:
            return None
    return prefix
