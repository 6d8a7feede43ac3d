"""Content ids, sort keys and token hashes, as Column expressions.

Everything here stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_PATTERN = r"\A[0-9a-f]{64}\z"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def header(kind: str, size: Column) -> Column:
    """`<kind> <size>` and a NUL, as bytes."""
    return F.concat(F.encode(F.concat(F.lit(kind + " "), size.cast("string")), "UTF-8"), F.unhex(F.lit("00")))


def object_id(kind: str, payload: Column | str) -> Column:
    """Lowercase hex SHA-256 of an object's canonical bytes."""
    payload = col(payload)
    return F.sha2(F.concat(header(kind, F.octet_length(payload)), payload), 256)


def blob_id(content: Column | str) -> Column:
    """The id of text or bytes stored as a blob."""
    return object_id("blob", col(content).cast("binary"))


def is_id(x: Column | str) -> Column:
    return F.coalesce(F.regexp_like(col(x), F.lit(ID_PATTERN)), F.lit(False))


def utf16_key(x: Column | str) -> Column:
    """Orders names and paths by UTF-16 code unit, which is not their UTF-8 order above U+FFFF."""
    return F.encode(col(x), "UTF-16BE")


def path_walk_key(path: Column | str) -> Column:
    """Orders paths as a walk through the tree meets them, level by level."""
    return F.transform(F.split(col(path), "/"), lambda c: F.encode(c, "UTF-16BE"))


def int_bytes(x: Column, width: int = 4) -> Column:
    """A non-negative whole number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 2 * width, "0"))


def signed_bytes(x: Column) -> Column:
    """A long as eight big-endian bytes in two's complement; hex() of a negative long has 16 digits already."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def big_endian(data: Column, at: Column | int, width: int) -> Column:
    """The big-endian number of width bytes at a 1-based place: 32 bits are signed, 64 bits too."""
    digits = F.hex(F.substring(data, at, width) if isinstance(at, int) else F.substr(data, at, F.lit(width)))
    if width == 8:
        return F.conv(digits, 16, -10).cast("long")
    n = F.conv(digits, 16, 10).cast("long")
    return F.when(n >= 1 << (8 * width - 1), n - (1 << (8 * width))).otherwise(n) if width == 4 else n


_FNV_PRIME, _FNV_START, _32 = 16777619, 2166136261, 4294967295


def fnv1a(x: Column | str) -> Column:
    """FNV-1a of 32 bits over the UTF-8 bytes, as a long."""
    digits = F.hex(F.encode(col(x), "UTF-8"))
    bytes_ = F.transform(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    return F.aggregate(bytes_, F.lit(_FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(_FNV_PRIME).cast("long")).bitwiseAND(F.lit(_32).cast("long")))


def name_is_safe(name: Column | str) -> Column:
    """Whether a directory entry may have this name."""
    n = col(name)
    return F.coalesce(F.is_valid_utf8(n) & ~n.isin("", ".", "..") & ~F.regexp_like(n, F.lit(r"[/\\\x00]")), F.lit(False))


def tree_entry_bytes(name: Column, kind: Column, executable: Column, child: Column) -> Column:
    """One encoded entry: name length, name, kind, executable, child id."""
    raw = F.encode(name, "UTF-8")
    flag = F.when(executable, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00")))
    return F.concat(int_bytes(F.octet_length(raw)), raw, int_bytes(kind, 1), flag, F.unhex(child))


def tree_payload(entries: Column) -> Column:
    """The payload of an array of (key, bytes) entries, key being the UTF-16 name."""
    parts = F.transform(F.array_sort(entries), lambda e: e["bytes"])
    body = F.unhex(F.array_join(F.transform(parts, F.hex), ""))  # one pass; concatenating one by one would copy all before each
    return F.concat(F.unhex(F.lit("53565431")), int_bytes(F.size(entries)), body)


def commit_payload(tree: Column, parents: Column, seconds: Column, nanos: Column, message: Column) -> Column:
    raw = F.encode(message, "UTF-8")
    ids = F.unhex(F.array_join(parents, ""))
    return F.concat(F.unhex(F.lit("53564331")), F.unhex(tree), int_bytes(F.size(parents)), ids, signed_bytes(seconds), int_bytes(nanos), int_bytes(F.octet_length(raw)), raw)
