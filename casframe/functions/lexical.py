"""The lexical embedding in numpy, for batches of texts in a worker."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa

from casframe.functions.text import STOPWORDS, category

DIM = 512
_STOP = frozenset(STOPWORDS)


def lower_each(text: str) -> str:
    return text.replace("İ", "i").replace("Σ", "σ").lower()


@lru_cache(1 << 16)
def in_token(c: str) -> bool:
    kind = category(c)
    return kind[0] == "L" or kind == "Nd"


_BLANKED = {i: c if in_token(c) else " " for i, c in enumerate(map(chr, range(128)))}
FEW = 64


def tokens(text: str) -> list[str]:
    text = lower_each(text)
    if text.isascii():
        return text.translate(_BLANKED).split()
    others = [c for c in set(text) if not in_token(c)]
    if len(others) > FEW:
        return "".join(c if in_token(c) else " " for c in text).split()
    for c in others:  # a scan for each kind of character is faster than a test of each character
        text = text.replace(c, " ")
    return text.split()


def term_counts(text: str | None) -> Counter:
    """How often each token comes, without stopwords."""
    counts = Counter(tokens(text or ""))
    for word in counts.keys() & _STOP:
        del counts[word]
    return counts


def fnv1a(data: bytes) -> int:
    h = 0x811C9DC5
    for b in data:
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h


LONG = 64


def fnv1a_each(tokens: list[str]) -> np.ndarray:
    """fnv1a of each token, byte by byte for all that have so many; long ones go alone."""
    a = pa.array(tokens, pa.large_string())
    ends = np.frombuffer(a.buffers()[1], np.int64)[: len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    start, h = ends[:-1][order], np.full(len(a), 0x811C9DC5, np.uint32)
    reach = np.searchsorted(-sizes[order], -np.arange(LONG), "left")  # how many have a byte at each place
    for k in range(LONG):
        if not (n := int(reach[k])):
            break
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint32(0x01000193)
    out = np.empty(len(a), np.uint32)
    out[order] = h
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = fnv1a(tokens[i].encode())
    return out


@lru_cache(1 << 12)
def damped(n: int) -> float:
    return float(np.float32(1 + np.log(n)))


def _cells(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct tokens of each text in turn, their places in a table of texts and buckets, and what they add there.

    A sign is that of the hash of "sign:" and the token.  FNV's lowest bit is that of all bytes together, so
    that hash is even where the token's own is odd.
    """
    counts = [term_counts(t) for t in texts]
    tokens_ = [t for c in counts for t in c]
    hashes = fnv1a_each(tokens_)
    cells = np.repeat(np.arange(len(counts)) * DIM, [len(c) for c in counts]) + hashes % DIM
    kinds, at = np.unique(np.fromiter((n for c in counts for n in c.values()), np.int64, len(tokens_)), return_inverse=True)
    return tokens_, cells, np.where(hashes & 1, 1.0, -1.0) * np.array([damped(n) for n in kinds.tolist()])[at]


def weights(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors in doubles: number of the text, bucket, weight of length 1; none where all cancel out.

    Sums of 32-bit terms are exact in doubles, so they do not depend on the order of tokens.
    """
    _, cells, terms = _cells(texts)
    sums = np.bincount(cells, terms, len(texts) * DIM).reshape(-1, DIM)
    norms = np.sqrt((sums * sums).sum(axis=1))
    row, bucket = np.nonzero((np.bincount(cells, minlength=len(texts) * DIM) > 0).reshape(-1, DIM) & (norms > 0)[:, None])
    return row, bucket, sums[row, bucket] / norms[row]


def embed_each(texts: list[str]) -> np.ndarray:
    """A float32 vector of length 1 for each text; tokens are added in sorted order, so that the sums are the same each time.

    Two terms have one sum in either order, so only what meets in threes is sorted.
    """
    tokens_, cells, terms = _cells(texts)
    out = np.zeros(len(texts) * DIM, np.float32)
    crowded = np.bincount(cells, minlength=len(out))[cells] > 2
    for at in (np.flatnonzero(~crowded), np.array(sorted(np.flatnonzero(crowded).tolist(), key=tokens_.__getitem__), np.intp)):
        np.add.at(out, cells[at], terms[at].astype(np.float32))
    out = out.reshape(-1, DIM)
    norms = np.sqrt((out.astype(float) ** 2).sum(axis=1)).astype(np.float32)
    return out / np.where(norms > 0, norms, np.float32(1))[:, None]


def embed(text: str) -> np.ndarray:
    return embed_each([text])[0]
