"""Planning of delta compression: candidates, sizes of pairs, and the greedy choice."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.functions import codecs, delta
from casframe.functions.hashing import utf16_key
from casframe.operators.base import cut

LEAST_SIZE = 64
WINDOW = 10
MAX_WRITE_DEPTH = 10
LEAST_SAVING = 0.05


def saves_enough(old: int, new: int) -> bool:
    return 0 < old and new < old and old - new >= old * LEAST_SAVING


def candidates(blobs: DataFrame) -> DataFrame:
    """Blobs (id, name, size) large enough for deltas, with rn: by name, largest first, then id.

    Ranks are counted within ranges of the order and then offset by the ranges before, so no
    task sees all rows.
    """
    key = (utf16_key("name"), F.desc("size"), F.asc("id"))
    rows = blobs.where(F.col("size") >= LEAST_SIZE)
    n = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    parted = rows.repartitionByRange(n, *key).withColumn("part", F.spark_partition_id())
    parted = cut(parted)
    sizes = parted.groupBy("part").count().collect()  # one row for each range
    starts, total = {}, 0
    for r in sorted(sizes):
        starts[r["part"]], total = total, total + r["count"]
    offset = F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)) if starts else F.create_map(F.lit(0), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return parted.withColumn("rn", (rank + offset[F.col("part")]).cast("long")).drop("part")


def window_pairs(ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, base_id, back): each candidate with the ones before it, back being 1 for the nearest.

    An equi-join: every candidate is offered to the next ranks.
    """
    offers = ranked.select(F.col("id").alias("base_id"), "rn", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("back")).withColumn("rn", F.col("rn") + F.col("back"))
    return ranked.select("id", "rn").join(offers, "rn")


#: Ranks that one task sizes in a row, with the WINDOW before them.
STRETCH = 256


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int, str, bytes, list[tuple[int, str, int]]]]:
    """at, only_base, rn, id and text of each row with (back, base_id, size) of the deltas from those before it, the nearest first;
    the last WINDOW rows are held, each with its index.  A rank that comes again is the same text and is passed over."""
    last: deque = deque(maxlen=WINDOW)
    stretch = None
    for b in batches:
        for at, only_base, rn, id_, data in zip(*b.columns, strict=True):
            at, only_base, rn, id_, data = at.as_py(), only_base.as_py(), rn.as_py(), id_.as_py(), data.as_py()
            if at != stretch:
                stretch = at
                last.clear()
            elif last and last[-1][0] == rn:
                continue
            sizes = []
            if not only_base:
                keys = delta.keys_of(data, 0, len(data)) if len(data) <= delta.PIECE else None
                sizes = [(rn - n, i, len(codecs.pack_delta(i, delta.encode(base, data, index, keys)))) for n, i, base, index in reversed(last) if rn - n <= WINDOW]
            last.append((rn, id_, data, delta.index_of(data)))
            yield at, only_base, rn, id_, data, sizes


def _stretched(ranked: DataFrame, canonical: DataFrame, on: list[str]) -> DataFrame:
    """(at, only_base, rn, id, canonical): ranks are cut into stretches; a text moves once, and once more where it is a base for the next stretch."""
    own = (F.col("rn") / STRETCH).cast("long")
    stretches = F.array_distinct(F.array(own, ((F.col("rn") + WINDOW) / STRETCH).cast("long")))
    rows = canonical.join(ranked.select(*on, "rn"), on).withColumn("at", F.explode(stretches))
    n = 8 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.select("at", (F.col("at") != own).alias("only_base"), "rn", "id", "canonical").repartition(n, "at").sortWithinPartitions("at", "rn")


def pair_sizes(ranked: DataFrame, canonical: DataFrame) -> DataFrame:
    """The pairs of the window (id, rn, base_id, back) with delta_bytes, the stored size of the delta; canonical is (id, canonical)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
        frame = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["id", "rn", "base_id", "back", "delta_bytes"])
        for _, _, rn, id_, _, sizes in _sized(batches):
            out += [(id_, rn, base_id, back, n) for back, base_id, n in sizes]
            if len(out) >= 10_000:
                yield frame()
                out = []
        yield frame()

    return _stretched(ranked, canonical.select("id", "canonical"), ["id"]).mapInArrow(run, "id string, rn long, base_id string, back int, delta_bytes long")


def sized_stretches(ranked: DataFrame, canonical: DataFrame, on: list[str]) -> DataFrame:
    """(at, ids, bases, numbers), one row for each stretch of ranks, in their order.

    ids are those of the bases from the stretch before, as many as bases says, and the stretch's own; numbers has
    1 + WINDOW longs for each own one: its size whole, and as a delta from the one back 1, 2, ..., 0 where there is none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            packed = np.array(numbers, "<i8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([stretch], pa.int64()), pa.array([ids], pa.list_(pa.string())), pa.array([len(ids) - len(numbers)], pa.int32()), pa.array([packed], pa.binary())], names=["at", "ids", "bases", "numbers"])

        stretch, ids, numbers = None, [], []
        for at, only_base, _, id_, data, sizes in _sized(batches):
            if at != stretch:
                if numbers:
                    yield row()
                stretch, ids, numbers = at, [], []
            ids.append(id_)
            if not only_base:
                of = {back: n for back, _, n in sizes}
                numbers.append([len(codecs.pack_full(data)), *(of.get(k, 0) for k in range(1, WINDOW + 1))])
        if numbers:
            yield row()

    return _stretched(ranked, canonical, on).mapInArrow(run, "at long, ids array<string>, bases int, numbers binary")


def full_sizes(canonical: DataFrame) -> DataFrame:
    """(id, full_bytes): what an object takes as a whole container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(codecs.pack_full(x)) for x in b.column(1).to_pylist()], pa.int64())], names=["id", "full_bytes"])

    return canonical.select("id", "canonical").mapInArrow(run, "id string, full_bytes long")


@dataclass
class Choice:
    id: str
    form: str  # keep, full or delta
    base_id: str | None
    before: int
    after: int
    depth: int


def plan(rows: list[dict], pairs: dict[str, list[tuple[str, int]]], base_of: dict[str, str]) -> list[Choice]:
    """The greedy choice over candidates in order; sizes are all there, so only numbers are walked.

    rows have id, stored_bytes, full_bytes; pairs the possible bases with sizes, the oldest
    first; base_of the deltas as they are stored, kept up to date with every choice, so
    that no chain ever comes back to where it began.
    """
    base_of, depth, out = dict(base_of), {}, []

    def chain(id_: str) -> list[str]:
        seen = []
        while id_ in base_of and id_ not in seen:
            seen.append(id_)
            id_ = base_of[id_]
        return [*seen, id_]

    for r in rows:
        id_, best, base = r["id"], r["full_bytes"], None
        for other, size in pairs.get(id_, ()):
            if size < best and depth.get(other, 0) < MAX_WRITE_DEPTH and id_ not in chain(other):
                best, base = size, other
        if not saves_enough(r["stored_bytes"], best):
            depth[id_] = len(chain(id_)) - 1
            out.append(Choice(id_, "keep", base_of.get(id_), r["stored_bytes"], r["stored_bytes"], depth[id_]))
            continue
        if base:
            base_of[id_], depth[id_] = base, depth.get(base, 0) + 1
        else:
            base_of.pop(id_, None)
            depth[id_] = 0
        out.append(Choice(id_, "delta" if base else "full", base, r["stored_bytes"], best, depth[id_]))
    return out


def plan_frame(ranked: DataFrame, sizes: DataFrame, full: DataFrame) -> DataFrame:
    """The plan as a table: id, form, base_id, before, after, depth.

    ranked has stored_bytes.  Ids and sizes alone go to the driver, some hundred bytes for
    each candidate; contents stay where they are.
    """
    rows = [r.asDict() for r in ranked.join(full, "id").select("id", "rn", "stored_bytes", "full_bytes").orderBy("rn").collect()]
    pairs: dict[str, list[tuple[str, int]]] = {}
    for r in sizes.orderBy("rn", F.desc("back")).select("id", "base_id", "delta_bytes").collect():
        pairs.setdefault(r.id, []).append((r.base_id, r.delta_bytes))
    stored = {r.id: r.base_id for r in ranked.where("base_id IS NOT NULL").select("id", "base_id").collect()} if "base_id" in ranked.columns else {}
    made = [(c.id, c.form, c.base_id, c.before, c.after, c.depth) for c in plan(rows, pairs, stored)]
    return ranked.sparkSession.createDataFrame(made, "id string, form string, base_id string, before long, after long, depth int")


def choose(numbers: np.ndarray, before: deque) -> tuple[bytes, bytes]:
    """The greedy choice over one stretch of objects that are stored whole: how far back the base of each is, 0 for none, and the depths.

    before has the depths of the last WINDOW ranks, the newest first, and is carried on.  Without stored deltas each
    chain leads to lower ranks, so none comes back to where it began, and these depths are all that matters.
    """
    backs, depths = bytearray(), bytearray()
    for full, *sizes in numbers.reshape(-1, 1 + WINDOW).tolist():
        best, back = full, 0
        for k in range(len(before), 0, -1):
            if 0 < sizes[k - 1] < best and before[k - 1] < MAX_WRITE_DEPTH:
                best, back = sizes[k - 1], k
        if not saves_enough(full, best):
            back = 0
        depth = before[back - 1] + 1 if back else 0
        backs.append(back)
        depths.append(depth)
        before.appendleft(depth)
    return bytes(backs), bytes(depths)


def plan_of_stretches(stretches: DataFrame) -> DataFrame:
    """The plan of objects that are stored whole, as plan_frame has it.

    The driver sees the sizes alone, one partition of stretches at a time and in order, and keeps two bytes for each object.
    """
    before: deque = deque(maxlen=WINDOW)
    chosen = [(r["at"], *map(bytearray, choose(np.frombuffer(r["numbers"], "<i8"), before))) for r in stretches.select("at", "numbers").orderBy("at").toLocalIterator()]
    choices = stretches.sparkSession.createDataFrame(chosen, "at long, backs binary, depths binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "form", "base_id", "before", "after", "depth"]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32())
        for b in batches:
            for ids, bases, packed, backs, depths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = []
                for i, (sizes, back, depth) in enumerate(zip(np.frombuffer(packed, "<i8").reshape(-1, 1 + WINDOW).tolist(), backs, depths, strict=True), bases):
                    out.append((ids[i], "delta" if back else "keep", ids[i - back] if back else None, sizes[0], sizes[back], depth))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=names)

    rows = stretches.join(F.broadcast(choices), "at").select("ids", "bases", "numbers", "backs", "depths")
    return rows.mapInArrow(run, "id string, form string, base_id string, before long, after long, depth int")


def stats(choices: DataFrame) -> DataFrame:
    """rewritten, before, after and percent saved of the choices that change something."""
    some = choices.where("form <> 'keep'").agg(F.count("*").alias("rewritten"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.coalesce(F.sum("after"), F.lit(0)).alias("after"))
    return some.withColumn("percent", F.when(F.col("before") > 0, 100.0 * (F.col("before") - F.col("after")) / F.col("before")).otherwise(0.0))
