"""Byte-level BPE, encoded in two tiers, and decoded.

Pre-tokens that are vocabulary entries themselves are found by a minimal perfect
hash whose slots hold the entry's bytes and number.  The others are merged: a heap of
(number, place) over a linked list of byte parts, least rank and then leftmost
first.  Results of a batch's distinct pre-tokens are reused within a worker,
up to a bound; the ids of a batch are written out and decoded at once.

Defined cases: a null or empty text has no tokens; special tokens are ordinary
text; very long pre-tokens take time in proportion to n log n; other columns are
left out, and rows are kept as they are, repeats included.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from casframe.llm.common import CACHE_WORD, slices, text_bytes
from casframe.llm.mph import PerfectHash

#: Pre-tokens that a worker remembers, also between its tasks: so many new ones in each of two generations, and so many
#: that were found again, with what one batch adds to each: some 25 MB each.
REMEMBERED = 100_000
#: Bits of a place in a short pre-token; the heaps of all short ones are begun together.
SHORT = 7


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Byte strings, numbered in the order of their ranks, behind the perfect hash."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = sorted(ranks, key=ranks.__getitem__)
        self.hash = PerfectHash.build(keys)
        self.numbers = np.empty(len(keys), np.int64)
        self.slots: list[bytes] = [b""] * len(keys)
        for n, (key, at) in enumerate(zip(keys, self.hash.numbers(keys).tolist(), strict=True)):
            self.slots[at], self.numbers[at] = key, n
        self.number_of = {k: n for n, k in enumerate(keys)}
        self.pairs = np.full(1 << 16, -1, np.int64)  # numbers of the entries of two bytes
        for key, n in self.number_of.items():
            if len(key) == 2:
                self.pairs[key[0] << 8 | key[1]] = n
        self.ranks = [ranks[k] for k in keys]
        self.decimals = pa.array([b" %d" % r for r in self.ranks], pa.large_binary())
        self.bytes_of = pa.array(keys, pa.large_binary())

    def whole(self, tokens: list[bytes]) -> list[int]:
        """The number of each token that is an entry, else -1."""
        at = self.hash.numbers(tokens)
        numbers = self.numbers[np.maximum(at, 0)] if len(self.slots) else at
        return [n if a >= 0 and self.slots[a] == t else -1 for t, a, n in zip(tokens, at.tolist(), numbers.tolist(), strict=True)]


def spelled(table: pa.Array, numbers: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    """What the table says of the numbers, joined in runs that end where ends say."""
    taken = table.take(pa.array(numbers))
    data, start = memoryview(taken.buffers()[2] or b""), 0
    for end in np.frombuffer(taken.buffers()[1], np.int64)[ends].tolist() if len(numbers) else ends.tolist():
        yield data[start:end]
        start = end


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.vocabulary = Vocabulary(ranks)
        self.merges = self.vocabulary.number_of
        self.find = regex.compile(pattern).findall
        # Pre-tokens of now and of before: when the first is full it becomes the second, so that frequent ones stay.
        # Those that were found again in the second stay in the first from then on, until they are too many.
        # Long ones are forgotten after their batch, which bounds the bytes of all.
        self.long: list[str] = []
        self.known: dict[str, tuple[int, bytes]] = {}
        self.before: dict[str, tuple[int, bytes]] = {}
        self.often: dict[str, tuple[int, bytes]] = {}

    def begin(self, token: bytes, bits: int) -> list[int]:
        """The merges of a pre-token's single bytes: number, start and end of each in one integer."""
        rank = self.merges.get
        return [r << 2 * bits | i << bits | i + 2 for i in range(len(token) - 1) if (r := rank(token[i : i + 2])) is not None]

    def begin_short(self, tokens: list[bytes]) -> Iterator[list[int]]:
        """As begin() for each of many short pre-tokens, none of them empty."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        numbers = self.vocabulary.pairs[data << 8 | np.append(data[1:], 0)]
        numbers[ends - 1] = -1  # that pair is of two pre-tokens
        places = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
        found = numbers >= 0
        items = (numbers << 2 * SHORT | places << SHORT | places + 2)[found].tolist()
        start = 0
        for end in np.cumsum(found)[ends - 1].tolist():
            yield items[start:end]
            start = end

    def merge(self, token: bytes, heap: list[int], bits: int) -> list[int]:
        """Numbers of the parts that are left when no two neighbours can be merged; heap as begun with so many bits.

        ends[i] is the end of the part that starts at i, where none does that of the
        token; no part starts there, which ends[n] says.
        """
        n, rank = len(token), self.merges.get
        twice, mask = 2 * bits, (1 << bits) - 1
        ends, before = [*range(1, n + 1), 0], list(range(-1, n - 1))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            item = pop(heap)
            i, end = item >> bits & mask, item & mask
            j = ends[i]
            if ends[j] != end:
                continue  # one of the two has changed since
            ends[i], ends[j] = end, n
            if end < n:
                before[end] = i
                after = ends[end]
                if (r := rank(token[i:after])) is not None:
                    push(heap, r << twice | i << bits | after)
            if i:
                h = before[i]
                if (r := rank(token[h:end])) is not None:
                    push(heap, r << twice | h << bits | end)
        out, i = [], 0
        while i < n:
            end = ends[i]
            out.append(self.merges[token[i:end]])
            i = end
        return out

    def numbers_of(self, tokens: list[str]) -> Iterator[list[int]]:
        """The ids of each pre-token, as numbers of entries."""
        raw = [t.encode() for t in tokens]
        whole = self.vocabulary.whole(raw)
        short = self.begin_short([b for b, n in zip(raw, whole, strict=True) if n < 0 and 0 < len(b) < 1 << SHORT])
        for b, n in zip(raw, whole, strict=True):
            if n >= 0:
                yield [n]
            elif 0 < len(b) < 1 << SHORT:
                yield self.merge(b, next(short), SHORT)
            else:
                bits = len(b).bit_length()
                yield self.merge(b, self.begin(b, bits), bits)

    def learn(self, tokens: set[str]) -> None:
        """Remember pre-tokens: number of ids, and the numbers of their entries in 32 bits each."""
        for token in self.long:
            self.known.pop(token, None)
        self.long = [token for token in tokens if len(token) > CACHE_WORD]
        if len(self.known) - len(self.often) > REMEMBERED:
            if len(self.often) > REMEMBERED:
                self.often = {}
            self.known, self.before = dict(self.often), self.known
        known, before, often = self.known, self.before, self.often
        new = []
        for token in tokens.difference(known):
            if token in before:
                known[token] = often[token] = before[token]
            else:
                new.append(token)
        for token, numbers in zip(new, self.numbers_of(new), strict=True):
            known[token] = (len(numbers), array("I", numbers).tobytes())

    def encode(self, text: str) -> list[int]:
        return [self.vocabulary.ranks[n] for numbers in self.numbers_of(self.find(text)) for n in numbers]

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Of each text, the number of ids, and the digests of the ids written out and of the bytes that they decode to."""
        tokens = list(map(self.find, texts))
        self.learn(set().union(*tokens))
        packed = [b"".join(map(itemgetter(1), map(self.known.__getitem__, t))) for t in tokens]
        del tokens
        counts = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        numbers, ends = np.frombuffer(b"".join(packed), np.uint32), np.cumsum(counts)
        ids = [hashlib.sha256(x[1:]).hexdigest() for x in spelled(self.vocabulary.decimals, numbers, ends)]
        return counts, ids, [hashlib.sha256(x).hexdigest() for x in spelled(self.vocabulary.bytes_of, numbers, ends)]


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def encoder_of(ranks: dict[bytes, int], pattern: str) -> Encoder:
    """This worker's encoder for a vocabulary: tasks that follow each other share what it has learned."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(*shared.value)
        for b in batches:
            for start, part in slices(b.column(1)):
                counts, ids, decoded = encoder.digests([(t or b"").decode("utf-8", "replace") for t in part])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, len(part)), pa.array(counts), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", text_bytes()).mapInArrow(run, schema)


def encode_ids(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id and the ids themselves."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for b in batches:
            for start, part in slices(b.column(1)):
                ids = [encoder.encode((t or b"").decode("utf-8", "replace")) for t in part]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(part)), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return docs.select("doc_id", text_bytes()).mapInArrow(run, "doc_id long, ids array<bigint>")


def decode_ids(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the text of each row of encode_ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {r: k for k, r in shared.value.items()}
        for b in batches:
            texts = [None if ids is None else b"".join(back[i] for i in ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
