"""Exact dedup: a minimal perfect hash over the distinct digests seen so far.

The index is cut into shards by digest.  A shard is one row: the perfect hash
over its digests, and slots with the full digests, the winner's doc_id and
the number of rows.  A lookup numbers a digest, compares all its bytes with the
slot's, and so is exact.  Digests without a slot group among themselves.

A corpus is treated as history and arrivals, halves by hash.  The index is built over the
history; arrivals are looked up in it.  Those that repeat a historical text update
its slot: the winner, if theirs is larger, and the number of rows.  The others group
by themselves.  A last lookup gives the rows of the first kind their slots' verdicts.

Texts are equal when identical after lower-casing A-Z only.  The row with the
largest doc_id of equal texts stays.

Defined cases: a null text counts as empty, and all empty texts are equal; a
null doc_id is less than any other, and stays only where all are null; repeated rows
of one doc_id and text share one verdict (`keep_first_rows` leaves one of
them); an empty table gives no rows; other columns, whatever their names, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm.common import cut, join_by_count, whole_rows
from casframe.llm.mph import PerfectHash

#: Distinct digests in a shard, on average: a bound on what a lookup task holds.
SHARD_DIGESTS = 1024
#: Rows looked up against one copy of a shard; a hot shard is copied for each further run of rows.
ROWS_A_LOOKUP = 4096

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX_SCHEMA = "shard long, hash binary, digests binary, winners array<long>, sizes array<long>"


def digest(text="text"):
    """SHA-256 of the normalised text, as 64 hex digits."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), _AZ, _az), 256)


def shard(n: int):
    return F.pmod(F.conv(F.substring("__digest", 1, 15), 16, 10).cast("long"), F.lit(n))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, __digest, and __row, which tells rows apart, repeated ones too."""
    return docs.select("doc_id", digest().alias("__digest"), F.monotonically_increasing_id().alias("__row"))


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """The shards over the distinct digests of (doc_id, __digest)."""
    winners = rows.groupBy("__digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))

    def build(group: pa.Table) -> pa.Table:
        keys = [bytes.fromhex(x) for x in group["__digest"].to_pylist()]
        ph = PerfectHash.build(keys)
        order = np.empty(len(keys), np.int64)
        order[ph.numbers(keys)] = np.arange(len(keys))
        slots = group.take(pa.array(order))
        return pa.table(
            {
                "shard": group["shard"].slice(0, 1),
                "hash": pa.array([ph.dump()], pa.binary()),
                "digests": pa.array([b"".join(keys[i] for i in order)], pa.binary()),
                "winners": pa.array([slots["winner"].to_pylist()], pa.list_(pa.int64())),
                "sizes": pa.array([slots["size"].to_pylist()], pa.list_(pa.int64())),
            }
        )

    return winners.withColumn("shard", shard(shards)).groupBy("shard").applyInArrow(build, INDEX_SCHEMA)


def lookup(rows: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """(doc_id, __digest, __row, winner, size, member) of every row; a nonmember's winner and size are null."""
    rows = rows.select("doc_id", "__digest", "__row", shard(shards).alias("shard"))
    copies = rows.groupBy("shard").agg(F.ceil(F.count("*") / ROWS_A_LOOKUP).cast("int").alias("__copies"))
    rows = rows.join(copies, "shard").withColumn("__copy", F.pmod("__row", "__copies").cast("int")).drop("__copies")
    spread = index.join(copies, "shard").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).drop("__copies")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        winner, size, member = np.zeros(n, object), np.zeros(n, object), np.zeros(n, bool)
        if right.num_rows and n:
            keys = [bytes.fromhex(x) for x in left["__digest"].to_pylist()]
            at = PerfectHash.load(right["hash"][0].as_py()).numbers(keys)
            slots, winners, sizes = right["digests"][0].as_py(), right["winners"][0].as_py(), right["sizes"][0].as_py()
            for i, (k, s) in enumerate(zip(keys, at.tolist(), strict=True)):
                if s >= 0 and slots[32 * s : 32 * s + 32] == k:
                    winner[i], size[i], member[i] = winners[s], sizes[s], True
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "__digest": left["__digest"],
                "__row": left["__row"],
                "winner": pa.array([w if m else None for w, m in zip(winner, member, strict=True)], pa.int64()),
                "size": pa.array([s if m else None for s, m in zip(size, member, strict=True)], pa.int64()),
                "member": pa.array(member),
            }
        )

    return (
        rows.groupBy("shard", "__copy")
        .cogroup(spread.groupBy("shard", "__copy"))
        .applyInArrow(find, "doc_id long, __digest string, __row long, winner long, size long, member boolean")
    )


def updated(index: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """The index with (__digest, winner, size) added to the slots of digests that it has."""
    changes = changes.withColumn("shard", shard(shards))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left
        keys = [bytes.fromhex(x) for x in right["__digest"].to_pylist()]
        slots, winners, sizes = left["digests"][0].as_py(), left["winners"][0].as_py(), left["sizes"][0].as_py()
        for k, s, w, n in zip(keys, PerfectHash.load(left["hash"][0].as_py()).numbers(keys).tolist(), right["winner"].to_pylist(), right["size"].to_pylist(), strict=True):
            if s >= 0 and slots[32 * s : 32 * s + 32] == k:
                winners[s], sizes[s] = max((x for x in (w, winners[s]) if x is not None), default=None), sizes[s] + n
        return pa.table({"shard": left["shard"], "hash": left["hash"], "digests": left["digests"], "winners": pa.array([winners], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64()))})

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(add, INDEX_SCHEMA)


def shard_count(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // SHARD_DIGESTS))


def grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("__digest").agg(F.max("doc_id").alias("winner"), F.count("*").alias("size"))


def by_themselves(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, __digest) with winner and size of their group, large groups being joined where their rows are."""
    groups = cut(grouped(rows))
    return join_by_count(rows.select("doc_id", "__digest"), groups, ["__digest"], "size", rows.count())


def exact_dedup(docs: DataFrame, index: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    With an index of earlier texts, repeats of those give way to the earlier
    winner, and the rest is grouped by itself.  Without one, one half of the documents is the
    history of the other, and the largest doc_id of both stays.
    """
    rows = cut(digests(docs))
    columns = ("doc_id", "__digest", "winner", "size")
    if index is None:
        history, arrivals = (rows.where(F.pmod(F.xxhash64("doc_id", "__digest"), F.lit(2)) == part) for part in (0, 1))
        shards = shard_count(history)
        index = cut(build_index(history, shards))
        found = cut(lookup(arrivals, index, shards))
        repeats, rest = found.where("member").select("doc_id", "__digest", "__row"), found.where("NOT member")
        index = updated(index, grouped(repeats), shards)
        members = lookup(history.unionByName(repeats), index, shards)
    else:
        found = cut(lookup(rows, index, int(shards or 1)))
        members, rest = found.where("member"), found.where("NOT member")
    found = members.select(*columns).unionByName(by_themselves(rest).select(*columns))
    return found.select(
        "doc_id",
        F.col("winner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )


def keep_first_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of repeated rows one stays.

    Rows are told by digest and doc_id together.  Where those are unique, as nearly always,
    texts are moved once; repeats are then reduced to one row each.
    """
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("d")), 256)
    kept = verdicts.where("kept").select("doc_id", F.col("text_sha256").alias("d")).select(key.alias("__key"))
    kept = cut(kept.groupBy("__key").agg(F.count("*").alias("__n")))
    rows = docs.select(whole_rows(docs).alias("__whole"), "doc_id", digest().alias("d")).select("__whole", key.alias("__key"))
    found = join_by_count(rows, kept, ["__key"], "__n", kept.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0])
    repeats = found.where("__n > 1").groupBy("__key").agg(F.first("__whole").alias("__whole"))
    return found.where("__n = 1").select("__whole.*").unionByName(repeats.select("__whole.*"))
