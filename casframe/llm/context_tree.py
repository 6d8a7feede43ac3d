"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, one for each prefix of its bits.  Each decision
has a tree of contexts: none, the last byte, the last two, three and four.  Every node holds
a Krichevsky-Trofimov estimate, and a node's weighted probability is half its own
estimate's and half the product of its children's.  All contexts of up to DEPTH
bytes that the training rows hold are nodes, without a limit.  Learned over a corpus and
then held fixed, the mixture gives each byte in each context a probability.

The tree is a distributed table of the distinct runs of DEPTH + 1 bytes, scored ones
included.  Contexts that end in the same two bytes are a subtree, made by one task: it
returns what its subtree says of each run, and the subtree's top nodes.  The nodes of one
byte and of none, 65,280 at most, are added up from those.  The most frequent runs, TOP_RUNS at
most, travel to the scorers; all others meet their probabilities in a join, whose keys are
rare runs, and for each row one of its own that carries what the scorer knows of it.  Texts
are scored when the result is read, again at each reading.  With limits in DEEP only the most frequent contexts of three and four
bytes are nodes, what follows a node in other contexts is one more child of it, and
the model is one object that is sent to all scorers.

Next to it stands a word unigram score.  Words are counted over the whole
training part; the most frequent TOP_WORDS travel to the scorers, the others meet
their counts in the same join.

Defined cases: a null or empty text is just its end; an end is a byte 0xFF, which UTF-8
never holds; a null doc_id counts as the empty text in the split; repeated rows are
counted and scored each; without training rows all estimates are even; an empty table gives
no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casframe.llm.common import CACHE_ENTRIES, WordHashes, cut, kth_largest, slices, text_bytes

#: Words whose counts are sent to every scorer: 16 bytes each.
TOP_WORDS = 1 << 17
#: Runs of bytes whose probabilities are sent to every scorer: 12 bytes each.
TOP_RUNS = 1 << 20
#: One in FOLDS is held out: those whose crc32 leaves HELD.
FOLDS, HELD = 5, 1

#: Bytes of context, and the nodes of three and of four bytes at most: None for all.
DEPTH = 4
DEEP: dict[int, int | None] = {3: None, 4: None}
END = b"\xff"
END_KEY = xxhash.xxh3_64_intdigest(b"")  # no word is empty
_GRAM, _WORD, _ROW = 0, 1, 2
_BATCH = 1 << 16
#: Bytes of text whose runs are numbered at a time; the arrays for that take up to 50 times as much.
STEP_BYTES = 1 << 19


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end of the texts the bytes before and itself, as one number; and where texts start."""
    pad = END * DEPTH
    number = _numbers(pad + b"".join(part for t in texts for part in (t, pad)))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    inside = np.repeat(np.arange(len(texts)) * (DEPTH - 1), sizes)  # the other ends of a text are the next one's context only
    inside += np.arange(len(inside))
    return number[inside], starts


def _numbers(data: bytes) -> np.ndarray:
    """Each DEPTH + 1 bytes in a row as one number."""
    x = np.frombuffer(data, np.uint8)
    n = len(x) - DEPTH
    number = np.zeros(n, np.int64)
    for back in range(DEPTH, -1, -1):
        number <<= 8
        number |= x[DEPTH - back : DEPTH - back + n]
    return number


def gram_steps(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What grams gives, by pieces of STEP_BYTES of a single long text."""
    if len(texts) != 1 or len(texts[0]) <= STEP_BYTES:
        yield grams(texts)
        return
    data = END * DEPTH + texts[0] + END
    for i in range(0, len(texts[0]) + 1, STEP_BYTES):
        yield _numbers(data[i : i + STEP_BYTES + DEPTH]), np.zeros(1, np.int64)


#: Byte runs that a task counts before it passes them on.
GRAM_ENTRIES = 1_000_000


class RunCounts:
    """Distinct runs and their counts as sorted arrays; new ones are added up once they are a quarter of most."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.parts, self.new = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

    def add(self, number: np.ndarray, once: int) -> bool:
        """Count each occurrence once times; true if there are more than most runs now."""
        keys, n = np.unique(number, return_counts=True)
        self.parts.append((keys, n * once))
        self.new += len(keys)
        return self.new > self.most // 4 and len(self.sums()[0]) > self.most

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
        self.parts, self.new = [(keys[first], np.add.reduceat(n, first) if len(first) else n)], 0
        return self.parts[0]


def _lower(part: list[bytes | None]) -> list[bytes]:
    return [(t or b"").lower() for t in part]


def training_counts(docs: DataFrame, scored: bool = False) -> DataFrame:
    """(kind, key, n): runs of DEPTH + 1 bytes and words of all training rows, added up; with scored also the runs of the others, as n = 0."""

    most = GRAM_ENTRIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = RunCounts(most)
        words: Counter[bytes] = Counter()
        ends = 0

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), _BATCH):
                k = keys[i : i + _BATCH]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.astype(np.int64)), pa.array(n[i : i + _BATCH].astype(np.int64))], names=["kind", "key", "n"])

        def counted() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            yield from rows(_WORD, keys.view(np.int64), np.fromiter(words.values(), np.int64, len(words)))
            words.clear()

        def told_apart() -> Iterator[tuple[list[bytes], bool]]:
            for b in batches:
                for start, part in slices(b.column(0), STEP_BYTES):
                    held = b.column(1).slice(start, len(part)).to_pylist()
                    for some in (False, True):
                        if texts := _lower([t for t, h in zip(part, held, strict=True) if h == some]):
                            yield texts, some

        for texts, held in told_apart():
            for number, _ in gram_steps(texts):
                if table.add(number, 0 if held else 1):
                    yield from rows(_GRAM, *table.sums())
                    table.clear()
            if not held:
                ends += len(texts)
                for t in texts:
                    words.update(t.split())
                if len(words) > CACHE_ENTRIES:
                    yield from counted()
        yield from counted()
        yield from rows(_GRAM, *table.sums())
        if ends:
            yield from rows(_WORD, np.array([END_KEY], np.uint64).view(np.int64), np.array([ends]))

    some = docs if scored else docs.where(~held_out())
    flat = some.select(text_bytes().alias("t"), held_out().alias("h")).mapInArrow(run, "kind byte, key long, n long")
    return flat.groupBy("kind", "key").agg(F.sum("n").alias("n"))



#: log gamma(n + 1/2) - log gamma(1/2), and log gamma(n + 1), of small n; larger n go by Stirling's series.
_SMALL = 1 << 12
_HALF = np.array([math.lgamma(n + 0.5) - math.lgamma(0.5) for n in range(_SMALL)])
_WHOLE = np.array([math.lgamma(n + 1.0) for n in range(_SMALL)])


def _log_gamma(n: np.ndarray, table: np.ndarray, shift: float, less: float) -> np.ndarray:
    """log gamma(n + shift) - less of whole n >= 0, the table having it for small ones."""
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    if large.any():
        x = n[large] + shift
        r = 1 / (x * x)
        out[large] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / x - less
    return out


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    out = np.zeros(n0.shape)
    some = (n0 + n1) > 0
    a, b = n0[some], n1[some]
    half = math.lgamma(0.5)
    out[some] = _log_gamma(a, _HALF, 0.5, half) + _log_gamma(b, _HALF, 0.5, half) - _log_gamma(a + b, _WHOLE, 1.0, 0.0)
    return out


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 decisions (in the order of a heap, from 1) of byte counts (..., 256)."""
    n0, n1 = np.zeros(counts.shape), np.zeros(counts.shape)
    sums = counts.astype(float)
    for bits in range(7, -1, -1):
        n0[..., 1 << bits : 2 << bits], n1[..., 1 << bits : 2 << bits] = sums[..., 0::2], sums[..., 1::2]
        sums = sums[..., 0::2] + sums[..., 1::2]
    return n0, n1


def byte_log10(ones: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the decisions' probabilities of a one (..., 256)."""
    out = np.zeros((*ones.shape[:-1], 1))
    for bits in range(8):
        p = ones[..., 1 << bits : 2 << bits]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], axis=-1).reshape(*ones.shape[:-1], 2 << bits)
    return out


@dataclass
class Model:
    """log10 P(byte | context): rows, and which row a context of 2, 3 or 4 bytes has."""

    rows: np.ndarray
    pairs: np.ndarray  # row of each two bytes
    deep: dict[int, tuple[np.ndarray, int]]  # by depth the sorted contexts, and the first one's row

    def log10(self, number: np.ndarray) -> np.ndarray:
        """Of the last byte of each number after the others; runs that occur often are looked up once."""
        runs, at = np.unique(number, return_inverse=True)
        context = runs >> 8
        row = self.pairs[context & 0xFFFF].astype(np.int64)
        for depth, (known, first) in sorted(self.deep.items()):
            own = context & ((1 << 8 * depth) - 1)
            place = np.searchsorted(known, own)
            if len(known):
                hit = known[np.minimum(place, len(known) - 1)] == own
                row[hit] = first + place[hit]
        return self.rows[row, runs & 255].astype(float)[at]


def _kt(n: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (n[1] + 0.5) / (n[0] + n[1] + 1.0)


class _Node:
    """Estimates of the contexts of one depth that end in one byte, by row, with their children."""

    def __init__(self, counts: np.ndarray, parent: np.ndarray | None = None, below: _Node | None = None) -> None:
        self.parent, self.below = parent, below
        self.n = decisions(counts)
        own = _log_kt(*self.n)
        self.rest, self.stay, self.weight = None, np.ones_like(own), own
        if below is not None and len(below.parent):
            rest = counts.astype(float)
            np.subtract.at(rest, below.parent, below.counts)
            self.rest = decisions(rest)
            children = _log_kt(*self.rest)
            np.add.at(children, below.parent, below.weight)
            held = np.bincount(below.parent, minlength=len(counts)) > 0
            both = np.logaddexp(own, children) - math.log(2)
            self.weight = np.where(held[:, None], both, own)
            self.stay = np.where(held[:, None], np.exp(own - math.log(2) - both), 1.0)
        self.counts = counts

    def mixed(self, above) -> Iterator[tuple[int, np.ndarray]]:
        """(levels below this one, probabilities of a one): of contexts that end here, and of all nodes below."""
        keep, gone = self.stay * _kt(self.n), 1 - self.stay
        last = keep if self.rest is None else keep + gone * _kt(self.rest)
        yield 0, above(last, slice(None))
        if self.below is not None and len(self.below.parent):
            up = self.below.parent
            for level, p in self.below.mixed(lambda x, i: above(keep[up[i]] + gone[up[i]] * x, up[i])):
                yield level + 1, p


def compile_model(pairs: tuple[np.ndarray, np.ndarray], deep: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The table of a tree: pairs are counts of three-byte runs, deep by depth the nodes' sorted contexts,
    and counts of the runs of one byte more that begin with them.
    """
    keys, n = pairs
    last_of = (keys >> 8) & 255
    one = np.zeros((256, 256))
    np.add.at(one, (last_of, keys & 255), n)
    d1, d0 = decisions(one), decisions(one.sum(axis=0))

    def counted(contexts: np.ndarray, runs: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(contexts), 256))
        at = np.searchsorted(contexts, runs >> 8)
        np.add.at(out, (at, runs & 255), n)
        return out

    seen = np.unique(keys >> 8)
    by_last = {2: (seen, keys, n), **deep}
    parts = {}
    for depth, (contexts, runs, times) in by_last.items():
        order = np.argsort(contexts & 255, kind="stable")
        runs_order = np.argsort((runs >> 8) & 255, kind="stable")
        parts[depth] = (contexts[order], np.searchsorted(contexts[order] & 255, np.arange(257)), runs[runs_order], times[runs_order], np.searchsorted((runs[runs_order] >> 8) & 255, np.arange(257)))

    def tree(last: int) -> tuple[list[np.ndarray], _Node]:
        """The contexts by depth, from two bytes on, and the node of the shortest."""
        own, counts = [], []
        for depth in sorted(parts):
            contexts, starts, runs, times, run_starts = parts[depth]
            c, r = contexts[starts[last] : starts[last + 1]], slice(run_starts[last], run_starts[last + 1])
            own.append(c)
            counts.append(counted(c, runs[r], times[r]))
        node = None
        for depth in range(max(parts), 1, -1):
            c = own[depth - 2]
            up = np.searchsorted(own[depth - 3], c & ((1 << 8 * (depth - 1)) - 1)) if depth > 2 else None
            node = _Node(counts[depth - 2], up, node)
        return own, node

    children = np.stack([tree(last)[1].weight.sum(axis=0) for last in range(256)])
    e1, e0 = _log_kt(*d1), _log_kt(*d0)
    w1 = np.logaddexp(e1, children) - math.log(2)
    stay1 = np.exp(e1 - math.log(2) - w1)
    stay0 = np.exp(e0 - np.logaddexp(e0, w1.sum(axis=0)))
    first = {2: 256}
    for depth in sorted(parts)[1:]:
        first[depth] = first[depth - 1] + len(parts[depth - 1][0])
    rows = np.empty((first[max(parts)] + len(parts[max(parts)][0]), 256), np.float32)
    table = np.tile(np.arange(256, dtype=np.int32), 256)  # pairs not seen share their last byte's row
    for last in range(256):
        own, node = tree(last)

        def above(x: np.ndarray, _, last: int = last) -> np.ndarray:
            p = stay1[last] * _kt((d1[0][last], d1[1][last])) + (1 - stay1[last]) * x
            return stay0 * _kt(d0) + (1 - stay0) * p

        rows[last] = byte_log10(above(np.full(256, 0.5), None))
        for level, p in node.mixed(above):
            at = first[level + 2] + np.searchsorted(by_last[level + 2][0], own[level])
            rows[at] = byte_log10(p)
            if not level:
                table[own[0]] = at
    return Model(rows, table, {d: (by_last[d][0], first[d]) for d in deep})


#: Runs whose probabilities are mixed at a time.
MIXED = 1 << 16


@dataclass
class WholeModel:
    """log10 P(byte | context) with every counted context as a node."""

    runs: np.ndarray  # distinct runs of DEPTH + 1 bytes, sorted
    before: np.ndarray  # how often the smaller runs occur; one entry more than runs
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # by depth below DEPTH the sorted context << 8 | decision, its estimate and its own share
    known: np.ndarray  # log10 of each run

    def mix(self, runs: np.ndarray) -> np.ndarray:
        """log10 of the last byte of each run after the others, from the nodes."""
        out = np.zeros(len(runs))
        context, byte = runs >> 8 << 8, runs & 255
        for bits in range(8):
            top, size = byte >> (8 - bits), 256 >> bits
            start, mid, end = (self.before[np.searchsorted(self.runs, context + top * size + x)] for x in (0, size // 2, size))
            p = _kt((mid - start, end - mid))
            decision = context | 1 << bits | top
            for depth in range(DEPTH - 1, -1, -1):
                keys, estimate, stay = self.nodes[depth]
                own = decision & ((1 << 8 * (depth + 1)) - 1)
                place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                hit = keys[place] == own if len(keys) else np.zeros(len(own), bool)
                e, s = np.full(len(own), 0.5), np.full(len(own), 0.5)  # of decisions that training has not met
                e[hit], s[hit] = estimate[place[hit]], stay[place[hit]]
                p = s * e + (1 - s) * p
            one = (byte >> (7 - bits) & 1) == 1
            out += np.log10(np.where(one, p, 1 - p))
        return out

    def log10(self, number: np.ndarray) -> np.ndarray:
        """Of the last byte of each number after the others; runs that occur often are looked up once."""
        runs, at = np.unique(number, return_inverse=True)
        out, hit = np.zeros(len(runs)), np.zeros(len(runs), bool)
        if len(self.runs):
            place = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
            hit = self.runs[place] == runs
            out[hit] = self.known[place[hit]]
        new = np.flatnonzero(~hit)
        for i in range(0, len(new), MIXED):
            out[new[i : i + MIXED]] = self.mix(runs[new[i : i + MIXED]])
        return out[at]


def _shorter(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, weight: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """Keys, counts, weights and own shares of the nodes of a depth, from those one byte deeper."""
    up, at = np.unique(keys & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    n0, n1, children = (np.bincount(at, x, len(up)) for x in (n0, n1, weight))
    own = _log_kt(n0, n1)
    both = np.logaddexp(own, children) - math.log(2)
    return up, n0, n1, both, np.exp(own - math.log(2) - both)


def whole_model(runs: np.ndarray, n: np.ndarray) -> WholeModel:
    """The model of the counts n of distinct runs; contexts of one last byte at a time."""
    order = np.argsort(runs)
    runs, n = runs[order], n[order]
    before = np.concatenate([[0], np.cumsum(n)])
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(DEPTH)]
    by_last = np.argsort((runs >> 8) & 255, kind="stable")
    for some in np.split(by_last, np.searchsorted((runs[by_last] >> 8) & 255, np.arange(1, 256))):
        byte, context = runs[some] & 255, runs[some] >> 8 << 8
        keys = np.concatenate([context | 1 << bits | byte >> (8 - bits) for bits in range(8)])
        one = np.concatenate([byte >> (7 - bits) & 1 for bits in range(8)])
        keys, at = np.unique(keys, return_inverse=True)
        n0, n1 = (np.bincount(at, np.tile(n[some], 8) * x, len(keys)) for x in (1 - one, one))
        node = keys, n0, n1, _log_kt(n0, n1)
        for depth in range(DEPTH - 1, 0, -1):
            *node, stay = _shorter(*node, depth)
            parts[depth].append((*node, stay))
    top = [np.concatenate(x) for x in zip(*parts[1], strict=True)]
    parts[0].append(_shorter(*top[:4], 0))
    nodes = []
    for own in parts:
        keys, n0, n1, _, stay = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(keys)
        nodes.append((keys[order], _kt((n0, n1))[order], stay[order]))
    model = WholeModel(runs, before, nodes, np.zeros(len(runs), np.float32))
    for i in range(0, len(runs), MIXED):
        model.known[i : i + MIXED] = model.mix(runs[i : i + MIXED])
    return model


def subtree(runs: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Of distinct runs and their counts: the probability of a one that the nodes of DEPTH down to least bytes
    mix for each of a run's eight decisions, and by bit the nodes of least bytes: keys, zeros, ones, log weights.

    The key of a node is its context << 8 | decision.  Nodes that training has not met have even estimates.
    """
    context, byte = runs >> 8 << 8, runs & 255
    mixed, tops = np.empty((len(runs), 8)), []
    for bits in range(8):
        one = byte >> (7 - bits) & 1
        keys, at = np.unique(context | 1 << bits | byte >> (8 - bits), return_inverse=True)
        n0, n1 = (np.bincount(at, n * x, len(keys)) for x in (1 - one, one))
        weight, p = _log_kt(n0, n1), _kt((n0, n1))[at]
        for depth in range(DEPTH - 1, least - 1, -1):
            up, to = np.unique(keys & ((1 << 8 * (depth + 1)) - 1), return_inverse=True)
            n0, n1, weight = (np.bincount(to, x, len(up)) for x in (n0, n1, weight))
            weight, stay = _weighted(n0, n1, weight)
            keys, at = up, to[at]
            p = stay[at] * _kt((n0, n1))[at] + (1 - stay[at]) * p
        mixed[:, bits] = p
        tops.append((keys, n0, n1, weight))
    return mixed, tops


def _weighted(n0: np.ndarray, n1: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights of nodes whose children's add up to those given, and the shares of the nodes' own estimates."""
    own = _log_kt(n0, n1)
    both = np.logaddexp(own, children) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


#: Bytes of context that a task's contexts share.
SHARED = 2


def run_scores(counts: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Every counted run as (key, n, p), and what makes (key, log10) of such rows: the log10 probability of a run's last byte after the others."""
    runs = counts.where(f"kind = {_GRAM}").select("key", "n", F.shiftright("key", 8).bitwiseAND((1 << 8 * SHARED) - 1).alias("suffix"))

    def run(group: pa.Table) -> pa.Table:
        keys, n = (group[c].to_numpy().astype(np.int64) for c in ("key", "n"))
        mixed, tops = subtree(keys, n, SHARED)
        top = [np.concatenate(x) for x in zip(*tops, strict=True)]
        none, other = len(keys), len(top[0])
        ends = np.minimum(np.arange(none + other + 1), none).astype(np.int32) * 8
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(mixed.ravel()), mask=pa.array(np.arange(none + other) >= none))
        numbers = [pa.array(np.concatenate([np.zeros(none), x])) for x in top[1:]]
        return pa.table([pa.array(np.repeat([0, 1], [none, other]).astype(np.int8)), pa.array(np.concatenate([keys, top[0]])), pa.array(np.concatenate([n, np.zeros(other, np.int64)])), lists, *numbers], names=["kind", "key", "n", "p", "n0", "n1", "weight"])

    parts = cut(runs.groupBy("suffix").applyInArrow(run, "kind byte, key long, n long, p array<double>, n0 double, n1 double, weight double"))
    sums = parts.where("kind = 1").groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "weight"))).toArrow()  # 65,280 rows at most
    at, n0, n1, children = (sums[c].to_numpy() for c in ("key", "n0", "n1", "weight"))
    estimate, share = np.full(1 << 16, 0.5), np.full(1 << 16, 0.5)
    weight, share[at] = _weighted(n0, n1, children)
    estimate[at] = _kt((n0, n1))
    n0, n1, children = (np.bincount(at & 255, x, 256) for x in (n0, n1, weight))
    above = (estimate, share, _kt((n0, n1)), _weighted(n0, n1, children)[1])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e1, s1, e0, s0 = above
        for b in batches:
            runs = b.column(0).to_numpy()
            p = np.asarray(b.column(1).flatten()).reshape(len(runs), 8)
            byte, out = runs & 255, np.zeros(len(runs))
            for bits in range(8):
                decision = 1 << bits | byte >> (8 - bits)
                last = (runs >> 8 & 255) << 8 | decision
                q = s1[last] * e1[last] + (1 - s1[last]) * p[:, bits]
                q = s0[decision] * e0[decision] + (1 - s0[decision]) * q
                out += np.log10(np.where(byte >> (7 - bits) & 1 == 1, q, 1 - q))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["key", "log10"])

    return parts.where("kind = 0").select("key", "n", "p"), lambda some: some.select("key", "p").mapInArrow(finish, "key long, log10 double")


@dataclass
class KnownRuns:
    """log10 P(byte | context) of the most frequent runs; that of the others is not here."""

    keys: np.ndarray
    known: np.ndarray

    def look_up(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of runs, and which of them are known."""
        runs, at = np.unique(number, return_inverse=True)
        out, hit = np.zeros(len(runs)), np.zeros(len(runs), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, runs), len(self.keys) - 1)
            hit = self.keys[place] == runs
            out[hit] = self.known[place[hit]]
        return out[at], hit[at]


def _runs_left(number: np.ndarray, hit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text the distinct runs without a hit, and how often each occurs: text, run, times."""
    left = np.flatnonzero(~hit)
    text = np.searchsorted(starts, left, "right") - 1
    order = np.lexsort((number[left], text))
    run, text = number[left][order], text[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], run[first], np.diff(np.append(first, len(run)))


def most_frequent(rows: DataFrame, count: str, most: int | None, counted: DataFrame | None = None) -> DataFrame:
    """The rows with the largest counts: all if most is None or there are no more than most, else those above the next one's.

    counted has the same counts in shorter rows, if given.
    """
    if most is None:
        return rows
    if not most:
        return rows.limit(0)
    least = kth_largest(rows if counted is None else counted, count, most + 1)
    return rows if least is None else rows.where(F.col(count) > F.lit(least))


def learn(counts: DataFrame) -> Model | WholeModel:
    """The model of training_counts as one object: for limits in DEEP, or for corpora whose runs fit the driver."""
    runs = counts.where(f"kind = {_GRAM}").select("key", "n")
    if all(most is None for most in DEEP.values()):
        found = runs.toArrow()
        return whole_model(*(found[c].to_numpy().astype(np.int64) for c in ("key", "n")))
    byte = F.col("key").bitwiseAND(255)
    context = lambda depth: F.shiftright("key", 8).bitwiseAND((1 << 8 * depth) - 1)
    column = lambda t, c: t[c].to_numpy().astype(np.int64)
    triples = runs.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # 256 ** 3 rows at most
    deep, above = {}, None
    for depth, most in sorted(DEEP.items()):
        nodes = most_frequent(cut(runs.groupBy(context(depth).alias("c")).agg(F.sum("n").alias("m"))), "m", most)
        own = runs.withColumn("c", context(depth)).join(F.broadcast(nodes), "c").groupBy("c", byte.alias("b")).agg(F.sum("n").alias("n")).toArrow()  # 256 rows for each node at most
        c, b, n = column(own, "c"), column(own, "b"), column(own, "n")
        if above is not None:  # a node's shorter context is a node too
            inside = np.isin(c & ((1 << 8 * (depth - 1)) - 1), above)
            c, b, n = c[inside], b[inside], n[inside]
        above = np.unique(c)
        deep[depth] = (above, c << 8 | b, n)
    return compile_model((column(triples, "key"), column(triples, "n")), deep)


#: What the scorers know of a row itself.
_OWN = pa.struct([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_top", pa.int64()), ("top_score", pa.float64()), ("top_runs", pa.float64()), ("n_bytes", pa.int64())])


def score(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    whole = all(most is None for most in DEEP.values())
    counts = cut(training_counts(docs, whole))
    if whole:
        scored, finished = run_scores(counts)
        top = finished(most_frequent(scored, "n", TOP_RUNS, counts.where(f"kind = {_GRAM}").select("n"))).toArrow()
        order = np.argsort(top["key"].to_numpy())
        tree = KnownRuns(top["key"].to_numpy()[order], top["log10"].to_numpy()[order].astype(np.float32))
    else:
        tree = learn(counts)
    words = counts.where(f"kind = {_WORD}").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(words, "n", TOP_WORDS).toArrow()
    keys, n = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(keys)
    below = total + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast((tree, keys[order], np.log10((n[order] + 0.5) / below)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, known_keys, known_log10 = shared.value
        known = WordHashes()
        first = TaskContext.get().partitionId() << 36

        def flat(kind: int, text: np.ndarray, key: np.ndarray, times: np.ndarray, own: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(key), _BATCH):
                n = len(key[i : i + _BATCH])
                columns = [pa.array(first + text[i : i + n]), pa.array(np.full(n, kind, np.int8)), pa.array(key[i : i + n]), pa.array(times[i : i + n].astype(np.int32)), pa.nulls(n, _OWN) if own is None else own.slice(i, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "kind", "key", "times", "own"])

        for b in batches:
            for start, part in slices(b.column(2), STEP_BYTES):
                texts = _lower(part)
                model = np.zeros(len(texts))
                for number, starts in gram_steps(texts):
                    values, hit = tree.look_up(number) if whole else (tree.log10(number), np.ones(len(number), bool))
                    model += np.add.reduceat(values, starts)
                    yield from flat(_GRAM, *_runs_left(number, hit, starts))
                tokens, found, base, rare, times = [], [], [], [], []
                for t in texts:
                    k, c = np.unique(np.append(known.of(t.split()), np.uint64(END_KEY)), return_counts=True)
                    at = np.searchsorted(known_keys, k)
                    hit = np.zeros(len(k), bool)
                    if len(known_keys):
                        hit = known_keys[np.minimum(at, len(known_keys) - 1)] == k
                    tokens.append(int(c.sum()))
                    found.append(int(c[hit].sum()))
                    base.append(float((known_log10[at[hit]] * c[hit]).sum()))
                    rare.append(k[~hit].view(np.int64))
                    times.append(c[~hit])
                yield from flat(_WORD, np.repeat(np.arange(len(texts)), [len(k) for k in rare]), np.concatenate(rare), np.concatenate(times))
                own = b.slice(start, len(part))
                n_bytes = np.fromiter(map(len, texts), np.int64, len(texts))
                columns = [own.column(0), own.column(1), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(model), pa.array(n_bytes)]
                row = np.arange(len(texts))
                yield from flat(_ROW, row, first + row, np.zeros(len(texts), int), pa.StructArray.from_arrays(columns, fields=list(_OWN)))
                first += len(part)

    # A row's own columns pass the join under a key of their own, so that texts are scored once and nothing is stored for a second reading.
    own = "struct<doc_id: bigint, held_out: boolean, n_tokens: bigint, n_top: bigint, top_score: double, top_runs: double, n_bytes: bigint>"
    rows = docs.select("doc_id", held_out().alias("held_out"), text_bytes().alias("t")).mapInArrow(run, f"row long, kind byte, key long, times int, own {own}")
    values = words.select(F.lit(_WORD).cast("byte").alias("kind"), "key", F.col("n").cast("double").alias("value"))
    if whole:
        values = values.unionByName(finished(scored).select(F.lit(_GRAM).cast("byte").alias("kind"), "key", F.col("log10").alias("value")))
    is_word = F.col("kind") == _WORD
    found = rows.join(values, ["kind", "key"], "left").groupBy("row").agg(
        *(F.max(f"own.{c.name}").alias(c.name) for c in _OWN),  # of one row that has them
        F.sum(F.when(is_word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.when(is_word, F.col("times") * F.log10((F.coalesce("value", F.lit(0.0)) + 0.5) / F.lit(below))).otherwise(0.0)).alias("tail_score"),
        F.sum(F.when(F.col("kind") == _GRAM, F.col("times") * F.col("value")).otherwise(0.0)).alias("tail_runs"),
    )
    score_ = F.col("top_runs") + F.col("tail_runs")
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_top") + F.col("known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("top_score") + F.col("tail_score")).alias("base_score"),
        score_.alias("score"),
        (-score_ * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
