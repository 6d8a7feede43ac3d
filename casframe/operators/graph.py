"""Commit graphs: decoding, history, revisions and reachability."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.functions import codecs
from casframe.operators.base import cut

COMMITS = "id string, tree_id string, parents array<string>, epoch_sec long, nano int, message string, error string"
LEAST_PREFIX = 7


class Unknown(ValueError):
    """A revision that names no commit, or more than one."""


def commits(objects: DataFrame) -> DataFrame:
    """Decoded commit objects; error is set, and the rest null, where one is invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id_, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    c = codecs.decode_commit(payload)
                    rows.append((id_, c.tree_id, list(c.parents), c.epoch_sec, c.nano, c.message, None))
                except codecs.Corrupt as e:
                    rows.append((id_, None, None, None, None, None, str(e)))
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["id", "tree_id", "parents", "epoch_sec", "nano", "message", "error"])

    return objects.where("type = 'commit'").select("id", "payload").mapInArrow(run, COMMITS)


def walk(parents_of: Callable[[str], Sequence[str]], heads: Sequence[str]) -> Iterator[str]:
    """Commits depth first, each head's first parents first, every commit once; parents are asked for when they are needed."""
    met: set[str] = set()
    for head in heads:
        stack = [head]
        while stack:
            now = stack.pop()
            if now not in met:
                met.add(now)
                yield now
                stack += reversed(parents_of(now))


def walk_order(parents: dict[str, list[str]], heads: list[str]) -> list[str]:
    return list(walk(lambda c: parents.get(c) or [], heads))


def discovery(commits_: DataFrame, heads: list[str]) -> DataFrame:
    """(id, rank): the order in which a walk from the heads meets the commits, stored or not.

    The order of a depth-first walk over merges is sequential by nature, and history is deep and
    narrow, so rounds of joins would be as many as commits.  Ids and parents alone, about
    a hundred bytes for each commit and no content, go to the driver for it.
    """
    order = walk_order({r.id: r.parents for r in commits_.select("id", "parents").toLocalIterator()}, heads)
    return commits_.sparkSession.createDataFrame(list(enumerate(order)), "rank long, id string").select("id", "rank")


def history(commits_: DataFrame, start: str, limit: int) -> DataFrame:
    """The first commits of the walk from start, with rank."""
    if limit < 1:
        raise ValueError("limit must be positive")
    return discovery(commits_, [start]).where(F.col("rank") < limit).join(commits_, "id").orderBy("rank")


def first_parent_chain(commits_: DataFrame) -> DataFrame:
    return commits_.select("id", F.get("parents", F.lit(0)).alias("parent"))


def ancestor(commits_: DataFrame, start: str, steps: int) -> str:
    """The commit so many first parents up, by doubling: each round composes the parent map with itself."""
    jump, at = None, start
    while steps:
        if jump is None:
            jump = cut(first_parent_chain(commits_).where("parent IS NOT NULL"))
        if steps & 1:
            row = jump.where(F.col("id") == at).first()
            if row is None:
                raise Unknown("revision goes past the first snapshot")
            at = row.parent
        steps >>= 1
        if steps:
            up = jump.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            jump = cut(jump.join(up, "parent").select("id", F.col("grand").alias("parent")))
    return at


def with_prefix(ids: DataFrame, prefix: str) -> DataFrame:
    return ids.where(F.startswith("id", F.lit(prefix.lower())))


def parsed_revision(revision: str) -> tuple[str, int]:
    """What a revision starts from, and how many first parents up it goes."""
    base, *steps = re.split(r"(~\d*)", revision.strip())
    if not re.fullmatch(r"(~\d*)*", "".join(steps)):
        raise Unknown(f"unknown revision: {revision}")
    return base, sum(int(s[1:] or 1) for s in steps if s)


def resolve(commits_: DataFrame, head: str | None, revision: str) -> str:
    """HEAD or @, a whole id, or a prefix of seven digits or more, with any number of ~ and ~N."""
    base, up = parsed_revision(revision)
    if base in ("HEAD", "@"):
        if not head:
            raise Unknown("no snapshots yet")
        found = [head]
    elif re.fullmatch(rf"[0-9a-fA-F]{{{LEAST_PREFIX},64}}", base):
        found = [r.id for r in with_prefix(commits_.select("id"), base).limit(2).collect()]
    else:
        found = []
    if len(found) != 1:
        raise Unknown(f"{'ambiguous' if found else 'unknown'} revision: {revision}")
    return ancestor(commits_, found[0], up)
