"""Binary deltas: copies from a base, and literal inserts.

A delta is two varints (base size, target size) and instructions.  A byte
below 0x80 inserts so many literal bytes; one from 0x80 copies, its low bits telling
which offset and size bytes follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 16
MAX_INSERT, MAX_COPY, ZERO_SIZE = 0x7F, 0xFFFFFF, 0x10000
MAX_BYTES = 256 << 20


class DeltaError(ValueError):
    pass


def put_varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            raise DeltaError("truncated varint")
        value |= (data[at + i] & 0x7F) << (7 * i)
        if data[at + i] < 0x80:
            if value >= 1 << 63:
                raise DeltaError("varint too large")
            return value, at + i + 1
    raise DeltaError("varint too long")


def apply(base: bytes, data: bytes) -> bytes:
    """The target; raises DeltaError for anything but a well-formed delta of this base."""
    source, at = get_varint(data, 0)
    size, at = get_varint(data, at)
    if source != len(base):
        raise DeltaError("base size differs")
    if size > MAX_BYTES:
        raise DeltaError("target too large")
    out, made = [], 0
    while at < len(data):
        op = data[at]
        at += 1
        if op == 0:
            raise DeltaError("opcode zero")
        if op < 0x80:
            piece = data[at : at + op]
            if len(piece) != op:
                raise DeltaError("truncated insert")
            at += op
        else:
            numbers = [0, 0]
            for bit in range(7):
                if op >> bit & 1:
                    if at >= len(data):
                        raise DeltaError("truncated copy")
                    which, place = divmod(bit, 4)
                    numbers[which] |= data[at] << (8 * place)
                    at += 1
            start, n = numbers[0], numbers[1] or ZERO_SIZE
            if start + n > len(base):
                raise DeltaError("copy past the base")
            piece = base[start : start + n]
        made += len(piece)
        if made > size:
            raise DeltaError("target size exceeded")
        out.append(piece)
    if made != size:
        raise DeltaError("target size differs")
    return b"".join(out)


def _insert(literal: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for i in range(0, len(literal), MAX_INSERT) if (part := literal[i : i + MAX_INSERT]))


def _copy(start: int, n: int) -> bytes:
    out = bytearray()
    while n:
        now = min(n, MAX_COPY)
        op, rest = 0x80, bytearray()
        for bit in range(7):
            left = start >> 8 * bit if bit < 4 else now >> 8 * (bit - 4)
            if left:  # bytes below the highest one that is not zero are written, zeros too
                op |= 1 << bit
                rest.append(left & 0xFF)
        out.append(op)
        out += rest
        start, n = start + now, n - now
    return bytes(out)


def _same_after(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], found by halving."""
    most = min(len(a) - i, len(b) - j)
    low, step = 0, 64
    while low < most:
        n = min(step, most - low)
        if a[i + low : i + low + n] == b[j + low : j + low + n]:
            low += n
            step *= 2
        elif n == 1:
            break
        else:
            most, step = low + n - 1 if n > 1 else low, max(n // 2, 1)
    return low


#: Bytes of a target that are keyed at a time, and the least bits of a base's marks.
PIECE, LEAST_BITS = 1 << 20, 16
_LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def keys_of(data: bytes, start: int, stop: int, step: int = 1) -> np.ndarray:
    """A 32-bit key of the block at each place from start to stop; equal blocks have equal keys."""
    n = len(range(start, min(stop, len(data) - BLOCK + 1), step))
    if not n:
        return np.zeros(0, np.intp)
    low, high = (np.ndarray(n, "<u8", data, start + at, (step,)) for at in (0, 8))
    mixed = low * _LOW ^ high * _HIGH
    return ((mixed ^ mixed >> np.uint64(29)) * _LOW >> np.uint64(32)).astype(np.intp)


class Index:
    """The last place of each block of a base, and marks at the keys of its blocks, which tell nearly all other blocks at once."""

    def __init__(self, base: bytes) -> None:
        self.places = {base[i : i + BLOCK]: i for i in range(0, len(base) - BLOCK + 1, BLOCK)}
        self.shift = 32 - min(32, max(LEAST_BITS, (8 * len(self.places)).bit_length()))
        self.marks = np.zeros(1 << 32 - self.shift, bool)
        for start in range(0, len(base), PIECE):
            self.marks[keys_of(base, start, start + PIECE, BLOCK) >> self.shift] = True

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """The places, among those of keys, where a block of the base may be."""
        return np.flatnonzero(self.marks[keys >> self.shift])


def index_of(base: bytes) -> Index:
    return Index(base)


def _places(index: Index, target: bytes, keys: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
    for start in range(0, len(target) - BLOCK + 1, PIECE):
        yield start, index.maybe(keys_of(target, start, start + PIECE) if keys is None else keys)


def encode(base: bytes, target: bytes, index: Index | None = None, keys: np.ndarray | None = None) -> bytes:
    """A delta from base to target: blocks of the base are found by their bytes, and matches grown both ways.

    keys are those of the whole target, of PIECE bytes at most, where it is encoded from several bases.
    """
    index = index_of(base) if index is None else index
    places = index.places
    out = [put_varint(len(base)), put_varint(len(target))]
    done = 0
    for start, maybe in _places(index, target, keys):
        k = 0
        while k < len(maybe):
            at = start + int(maybe[k])
            if at < done:
                k += int(np.searchsorted(maybe[k:], done - start))
                continue
            hit = places.get(target[at : at + BLOCK])
            if hit is None:
                k += 1
                continue
            back = 0
            while back < min(at - done, hit) and base[hit - back - 1] == target[at - back - 1]:
                back += 1
            n = back + BLOCK + _same_after(base, hit + BLOCK, target, at + BLOCK)
            out += [_insert(target[done : at - back]), _copy(hit - back, n)]
            done = at - back + n
    out.append(_insert(target[done:]))
    return b"".join(out)
