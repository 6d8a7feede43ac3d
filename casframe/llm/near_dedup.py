"""Near dedup: SuperMinHash signatures, banding, verification, union-find grouping.

Each distinct shingle gives every slot of the signature one value, in the order of
a random permutation of its own: on level j it offers j plus a random fraction to
the j-th slot.  A slot keeps the least offer, so levels past the largest
held value change nothing, and long documents stop after the first or second.

Documents with the same shingles are one node.  Bands of the signature put nodes
into buckets.  Each bucket's members are compared with its hub, the member whose
buckets are the fullest.  Where that leaves a small bucket in several components, its
members of different components are compared by pairs.  The members of large ones meet
by prefix filtering, which is exact: two sets that are similar enough share one of the
rarest shingles of each, so many as the similarity leaves free to differ.  What shares no such
shingle is never compared, however large its bucket.  Of large groups that do share one, the members
outside the group's largest component are compared with the blocks that hold the others, each
block once whatever the number of shared shingles, within tasks that return links only.  No member is dropped.
A link is confirmed on the full shingle sets.  Keys that may be hot (nodes, buckets,
hubs, stars, shingles) are counted before they are joined.  Links are grouped by union-find
within partitions, and by stars across them until few enough are left for one task.

Defined cases: a null text, or one without words, has no shingles and is linked
with nothing; a row with a null doc_id takes the component of its text, and has a null
one and is kept where no row with an id has that text; repeated rows of one doc_id are one
document; an empty table gives no rows; very long texts are whole sets like any other;
other columns, whatever their names, are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casframe.llm.common import WordHashes, cut, join_by_count, mix64, release, slices, stream64, text_bytes, whole_rows

WORDS = 5
#: Linked from 85 % of the union on, as a fraction of whole numbers, unless the caller names another.
SIMILAR = (85, 100)
#: At the threshold a link is missed with this probability at most, (1 - similarity**rows)**bands, above it with less.
MISSED = 2e-6
#: Slots of a signature at most, unless one row a band needs more.
SLOTS = 176
#: A bucket with more members than this is compared by prefix filtering, and a larger group there in blocks of BLOCK.
SMALL_BUCKET, BLOCK = 16, 256
#: Shingles that a block's members have on average at most, or the group has more blocks.
BLOCK_SHINGLES = 1_000
#: Members that meet one copy of their hub's text.
HUB_MEMBERS = 32
#: Shingles counted at a time when two blocks are compared.
COLUMNS = 1 << 14
#: Links, of 16 bytes, that one task groups; more go through rounds of stars first.
LINKS_OF_A_TASK = 1 << 19

_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def banding(similar: tuple[int, int]) -> tuple[int, int]:
    """Bands and rows a band, as many rows as SLOTS allow."""
    need = lambda rows: max(math.ceil(math.log(MISSED) / math.log1p(-((similar[0] / similar[1]) ** rows))), 1)
    rows = max((r for r in range(2, SLOTS + 1) if r * need(r) <= SLOTS), default=1)
    return need(rows), rows


#: Of SIMILAR: 28 bands of 6.
BANDS, ROWS = banding(SIMILAR)


def shingle_hashes(words: list[bytes], known: WordHashes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; shorter texts are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    w = known.of(words)
    n = max(len(w) - k + 1, 1)
    out = np.full(n, np.uint64(min(len(w), k)))
    with np.errstate(over="ignore"):
        for i in range(min(k, len(w))):
            out = mix64(out * np.uint64(0x100000001B3) + w[i : i + n])
    return np.unique(out)


def signatures(elements: np.ndarray, owner: np.ndarray, documents: int, slots: int) -> np.ndarray:
    """SuperMinHash of each document: level << 32 | fraction for each slot.

    owner gives the document of each element, ascending.  Every document needs an element.
    """
    held = np.full((documents, slots), np.iinfo(np.uint64).max, np.uint64)
    flat, m = held.reshape(-1), np.uint64(slots)
    picks: list[np.ndarray] = []
    for level in range(slots):
        x = stream64(elements, level)
        pick = level + (((x & _LOW) * (m - np.uint64(level))) >> _32).astype(np.int64)
        slot = pick
        for i in range(level - 1, -1, -1):  # what earlier swaps have moved to that place
            slot = np.where(slot == picks[i], i, slot)
        np.minimum.at(flat, owner * slots + slot, (np.uint64(level) << _32) | (x >> _32))
        open_ = (held.max(axis=1) >> _32) > np.uint64(level)
        if not open_.any():
            break
        left = open_[owner]
        if not left.all():
            elements, owner, picks = elements[left], owner[left], [p[left] for p in picks]
            pick = pick[left]
        picks.append(pick)
    return held


def bands_of(held: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, other bands' keys being others."""
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(held), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mix64(out * np.uint64(0x100000001B3) + held[:, r : bands * rows : rows])
    return out


def sketch(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, node (128-bit hash of the shingle set) and bands of every row."""

    bands, rows = banding(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for start, part in slices(b.column(1)):
                sets = [shingle_hashes((t or b"").lower().split(), known) for t in part]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys, nodes = [None] * len(part), [None] * len(part)
                if len(full):
                    held = signatures(np.concatenate(sets), np.repeat(np.arange(len(full)), sizes[full]), len(full), bands * rows)
                    for i, key in zip(full, bands_of(held, bands, rows).view(np.int64), strict=True):
                        keys[i], nodes[i] = key, xxhash.xxh3_128_digest(sets[i].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(part)), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "bands"],
                )

    schema = "doc_id long, n_shingles long, node binary, bands array<bigint>"
    return docs.select("doc_id", text_bytes()).mapInArrow(run, schema)


def _similar(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> bool:
    common = len(x) + len(y) - len(np.union1d(x, y))
    return similar[1] * common >= similar[0] * (len(x) + len(y) - common)


def verified(pairs: DataFrame, docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links (a, b), a < b, of the pairs (hub, member, n) whose full shingle sets are similar enough.

    n is about how many members a hub has.  Texts move to their hub's task, HUB_MEMBERS of them for each copy of
    the hub's own text; tasks read them in order and hold one hub at a time.
    """
    chunk = F.pmod(F.xxhash64("member"), F.ceil(F.col("n") / HUB_MEMBERS)).cast("int")
    wanted = cut(pairs.select("hub", "member", chunk.alias("chunk")))
    wanted = wanted.select(F.col("member").alias("doc_id"), "hub", "chunk", F.lit(1).alias("of")).unionByName(wanted.select(F.col("hub").alias("doc_id"), "hub", "chunk", F.lit(0).alias("of")).distinct())
    rows = docs.select("doc_id", text_bytes().alias("t")).join(wanted, "doc_id")
    rows = rows.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "of").select("hub", "doc_id", "of", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hub, own = WordHashes(), None, None
        for b in batches:
            for start, part in slices(b.column(3)):
                links = []
                for h, i, of, t in zip(*(b.column(c).slice(start, len(part)).to_pylist() for c in range(3)), part, strict=True):
                    if of == 0:
                        if h != hub:
                            hub, own = h, shingle_hashes((t or b"").lower().split(), known)
                    elif _similar(own, shingle_hashes((t or b"").lower().split(), known), similar):
                        links.append((min(h, i), max(h, i)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: each node with the least of its tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for i in range(0, len(nodes), 1 << 16):
        some = nodes[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(x) for x in some], pa.int64())], names=["a", "b"])


def components(links: DataFrame, few: int = LINKS_OF_A_TASK) -> DataFrame:
    """(id, component) of every linked id but the least of each component, which names it.

    Alternates stars until nothing changes: each id's larger neighbours, then its smaller
    ones and itself, go to its least neighbour.  When no more than few links are left, one task groups them.
    """
    edges, held = cut(links.mapInArrow(_forest, "a long, b long").distinct()), None
    state = (F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")))
    while True:
        if (held[0] if held else edges.count()) <= few:
            return edges.coalesce(1).mapInArrow(_forest, "a long, b long").toDF("id", "component")
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n")))
        total = least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        large = join_by_count(both.where("b > a"), least.where("n > 0"), ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large)
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_by_count(large, least, ["a"], "n", large.count())
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = cut(small.where("a <> b").distinct())
        now = tuple(edges.agg(*state).first())
        if now == held:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
        held = now
        release(links.sparkSession)


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, as products of 0/1 matrices."""
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, column, n = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    shared = n > 1  # the others are in no intersection
    place = np.cumsum(shared) - 1
    rows, column = rows[shared[column]], place[column[shared[column]]]
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        now = (column >= start) & (column < start + COLUMNS)
        m = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        m[rows[now], column[now] - start] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out.astype(np.int64)


def _block_links(similar: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """Links between those of a group that ask and the members of their block, of different components."""

    def links(group: pa.Table) -> pa.Table:
        ids, comps, asks = (np.array(group[c]) for c in ("rep", "component", "asks"))
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        todo = comps[a][:, None] != comps[b][None, :]
        a, b, todo = a[todo.any(axis=1)], b[todo.any(axis=0)], todo[todo.any(axis=1)][:, todo.any(axis=0)]
        found = np.zeros((0, 2), np.int64)
        if todo.any():
            x, y = ([np.frombuffer(s, np.uint64) for s in group["packed"].take(pa.array(at)).to_pylist()] for at in (a, b))
            common = common_counts(x, y)
            union = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y])[None, :] - common
            i, j = np.nonzero(todo & (similar[1] * common >= similar[0] * union))
            found = np.stack([ids[a[i]], ids[b[j]]], axis=1)
        return pa.table({"a": pa.array(found.min(axis=1) if len(found) else found[:, 0]), "b": pa.array(found.max(axis=1) if len(found) else found[:, 0])})

    return links


def _in_blocks(many: DataFrame, sets: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links of large groups: many has a row (h, rep, component, s, n) for each member of each group.

    Any pair of different components has a member outside the group's largest component; that one asks.
    A document's block is one of the largest component of its largest group, so that groups of alike documents have the same blocks.
    """
    n_rows = many.count()
    parts = many.groupBy("h", "component").agg(F.count("*").alias("own"), F.sum("s").alias("s"))
    groups = parts.groupBy("h").agg(F.max_by("component", F.struct("own", "component")).alias("major"), F.sum("own").alias("n"))
    many = cut(join_by_count(many.drop("n"), cut(groups), ["h"], "n", n_rows))
    home = cut(many.groupBy("rep", "component").agg(F.max(F.struct("n", "major")).alias("of"), F.max("s").alias("s")).select("rep", "component", F.col("of.major").alias("home"), "s"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("s") / (BLOCK * BLOCK_SHINGLES))).cast("int")
    homes = cut(home.groupBy("home").agg(blocks.alias("blocks"), F.count("*").alias("n")))
    home = join_by_count(home.drop("s"), homes, ["home"], "n", home.count())
    home = cut(home.select("rep", "component", "home", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("part")))
    asking = many.where(F.col("component") != F.col("major")).select("h", "rep")
    holding = many.select("h", "rep").join(home.drop("component"), "rep").groupBy("h").agg(F.collect_set(F.struct("home", "part")).alias("held"))
    held = cut(asking.groupBy("h").agg(F.count("*").alias("n")).join(holding, "h"))
    asked = join_by_count(asking, held, ["h"], "n", n_rows).select("rep", F.explode("held").alias("b")).select("rep", "b.home", "b.part").distinct()
    asked = cut(asked)
    chunks = cut(asked.groupBy("home", "part").agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / BLOCK).cast("int")))
    asked = join_by_count(asked, chunks, ["home", "part"], "n", asked.count()).select("rep", "home", "part", F.pmod(F.xxhash64("rep", F.lit(1)), "chunks").cast("int").alias("chunk"), F.lit(True).alias("asks"))
    asked = asked.join(home.select("rep", "component"), "rep")
    own = home.join(chunks.drop("n"), ["home", "part"]).select("rep", "home", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"), "component")
    rows = asked.unionByName(own).join(sets.select("rep", "packed"), "rep")
    return rows.groupBy("home", "part", "chunk").applyInArrow(_block_links(similar), "a long, b long").distinct()


def by_prefixes(crowd: DataFrame, docs: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Links (a, b) between different components of crowd (rep, component), found on shared rare shingles.

    Sets of s and more shingles that are similar enough share all but s - ceil(similar * s) of them at most, so one
    of the s - ceil(similar * s) + 1 that are the first of each in any one order; the rarest are the first here.
    """
    num, den = similar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for start, part in slices(b.column(1)):
                sets = [shingle_hashes((t or b"").lower().split(), known) for t in part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["rep", "packed", "shingles"])

    texts = docs.select(F.col("doc_id").alias("rep"), text_bytes().alias("t")).join(crowd.select("rep"), "rep", "left_semi")
    sets = cut(texts.mapInArrow(run, "rep long, packed binary, shingles array<bigint>"))
    rows = sets.select("rep", F.size("shingles").alias("s"), F.explode("shingles").alias("h"))
    often = cut(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    rows = join_by_count(rows, often, ["h"], "df", sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0])
    order = Window.partitionBy("rep").orderBy("df", "h")
    rows = rows.withColumns({"place": F.row_number().over(order), "shared": F.count("*").over(Window.partitionBy("rep"))})
    first = F.col("s") - F.ceil(F.col("s") * num / den) + 1
    rows = rows.where(F.col("place") <= first - (F.col("s") - F.col("shared")))
    rows = cut(rows.select("rep", "h", F.col("s").cast("long").alias("s")).join(crowd, "rep"))
    groups = cut(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h", "n"))
    rows = join_by_count(rows, groups, ["h"], "n", rows.count())
    release(docs.sparkSession)

    few = rows.where(F.col("n") <= SMALL_BUCKET).select("h", "rep", "component", "s")
    x, y = (few.select("h", F.col("rep").alias(i), F.col("component").alias(f"c{i}"), F.col("s").alias(f"s{i}")) for i in ("a", "b"))
    near = F.least("sa", "sb") * den >= F.greatest("sa", "sb") * num
    pairs = cut(x.join(y, "h").where(near & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))).select(F.col("a").alias("hub"), F.col("b").alias("member"), F.lit(1).alias("n")).distinct())
    links = verified(pairs, docs, similar)
    many = rows.where(F.col("n") > SMALL_BUCKET)
    if many.isEmpty():
        return links
    return links.unionByName(_in_blocks(many, sets, similar))


def near_dedup(docs: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; similar is the least Jaccard similarity of a link, as a fraction."""
    docs = docs.select("doc_id", "text")
    rows = cut(sketch(docs, similar))
    nodes = cut(rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("bands").alias("bands")))
    total, n_nodes = nodes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not rows.groupBy("doc_id").count().where("doc_id IS NOT NULL AND count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id"])  # else each of a repeated id's rows would meet its hubs

    banded = nodes.where("rep IS NOT NULL").select("rep", F.explode("bands").alias("bucket"))
    full = cut(banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    live = cut(join_by_count(banded, full, ["bucket"], "n", n_nodes * banding(similar)[0]))
    n_live = live.count()
    score = live.groupBy("rep").agg(F.sum("n").alias("score"))
    hubs = live.join(score, "rep").groupBy("bucket").agg(F.max(F.struct("score", -F.col("rep"))).alias("top"), F.max("n").alias("n")).select("bucket", (-F.col("top")[F.lit("col2")]).alias("hub"), "n")
    # Of two members of several buckets the one with the higher score is the hub in all of them.
    tried = join_by_count(live.select("bucket", F.col("rep").alias("member")), cut(hubs), ["bucket"], "n", n_live).where("member <> hub")
    tried = cut(tried.groupBy("hub", "member").agg(F.max("n").alias("n")))
    links = cut(verified(tried, docs, similar))
    release(docs.sparkSession)

    # Buckets that the hubs have not joined into one component.
    comp = cut(components(links))
    known = cut(live.join(comp, live.rep == comp.id, "left").select("rep", "bucket", F.coalesce("component", "rep").alias("component")))
    apart = cut(known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n"))
    rest = cut(join_by_count(known, apart, ["bucket"], "n", n_live))
    release(docs.sparkSession)
    if not rest.isEmpty():
        few = rest.where(F.col("n") <= SMALL_BUCKET)
        x, y = (few.select("bucket", F.col("rep").alias(i), F.col("component").alias(f"c{i}")) for i in ("a", "b"))
        done = tried.select(F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"))
        pairs = x.join(y, "bucket").where("a < b AND ca <> cb").select("a", "b").distinct().join(done, ["a", "b"], "left_anti")
        more = verified(cut(pairs.select(F.col("a").alias("hub"), F.col("b").alias("member"), F.lit(1).alias("n"))), docs, similar)
        crowd = cut(rest.where(F.col("n") > SMALL_BUCKET).select("rep", "component").distinct())
        if not crowd.isEmpty():
            more = more.unionByName(by_prefixes(crowd, docs, similar))
        more = cut(more)
        release(docs.sparkSession)
        if not more.isEmpty():
            comp = cut(components(links.unionByName(more)))

    named = cut(nodes.join(comp, nodes.rep == comp.id, "left").select("node", "n", F.coalesce("component", "rep").alias("component_id")))
    own = join_by_count(rows.select("doc_id", "n_shingles", "node"), named, ["node"], "n", total).select("doc_id", "n_shingles", "component_id")
    own = own.unionByName(rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The documents that stay, with their columns; of rows with a null doc_id all or none."""
    ids = verdicts.where("kept").select(F.col("doc_id").alias("__id")).distinct()
    rows = docs.select(F.col("doc_id").alias("__doc"), whole_rows(docs).alias("__whole"))
    return rows.join(ids, F.col("__doc").eqNullSafe(F.col("__id")), "left_semi").select("__whole.*")
