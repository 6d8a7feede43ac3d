"""Golden values, round trips, and bytes that must be refused."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from casframe.functions import codecs, delta, lexical, pdf
from casframe.functions.codecs import Commit, Corrupt, Entry

BLOB = "0bd69098bd9b9cc5934a610ab65da429b525361147faa7b5b922919e9a23143d"
EMPTY = "bccaa8985496fdc553fa99487f038d3c1c5cb5aebbe47d7d9f12bc758820106a"
MIXED = "79dc49597b4cc697ddad8ca36f36561ae631fa8f4fa20a391ad505022ad83420"
ENTRIES = [Entry("\ufffd", 1, False, BLOB), Entry("\U00010000", 1, False, BLOB), Entry("Z-dir", 2, False, EMPTY), Entry("a.txt", 1, True, BLOB), Entry("link", 3, False, BLOB)]


def test_golden_ids():
    assert codecs.object_id("blob", b"hello world\n") == BLOB
    assert codecs.object_id("tree", codecs.encode_tree([])) == EMPTY
    assert codecs.object_id("tree", codecs.encode_tree(ENTRIES)) == MIXED
    root = Commit(MIXED, (), 1700000000, 123456789, "First\n\nBody line")
    child = Commit(EMPTY, ("15c97e30bf810809623268ebca57ca27a396d89e5f01c39d32b2c3f9486c90f3",), 1700000001, 0, "Second")
    assert codecs.object_id("commit", codecs.encode_commit(root)) == child.parents[0]
    assert codecs.object_id("commit", codecs.encode_commit(child)) == "7ae68059450175b7677905b62b94f348baf4c72431891e3974e33a8af32da201"
    assert codecs.decode_commit(codecs.encode_commit(root)) == root


def test_tree_order_and_strictness():
    raw = codecs.encode_tree(ENTRIES)
    assert [e.name for e in codecs.decode_tree(raw, strict=True)] == ["Z-dir", "a.txt", "link", "\U00010000", "\ufffd"]
    entry = lambda name, kind=1, flag=0: struct.pack(">i", len(name)) + name + bytes([kind, flag]) + bytes(32)
    tree = lambda *es: b"SVT1" + struct.pack(">i", len(es)) + b"".join(es)
    swapped = tree(entry(b"b"), entry(b"a"))
    assert [e.name for e in codecs.decode_tree(swapped)] == ["a", "b"]
    assert codecs.decode_tree(tree(entry(b"a", 1, 2)))[0].executable
    for strict, bad in [(True, swapped), (True, tree(entry(b"a", 1, 2))), *((s, x) for s in (True, False) for x in (tree(entry(b"..")), tree(entry(b"a/b")), tree(entry(b"a\\b")), tree(entry(b"")), tree(entry(b"a\0")), tree(entry(b"\xff")), tree(entry(b"a", 4)), tree(entry(b"a", 2, 1)), tree(entry(b"a"), entry(b"a")), tree(entry(b"a")) + b"x", tree(entry(b"a"))[:-1], b"SVT2" + bytes(4), b"SVT1\xff\xff\xff\xff"))]:
        with pytest.raises(Corrupt):
            codecs.decode_tree(bad, strict)


def test_commit_limits():
    for bad in (Commit(EMPTY, (), 0, 10**9, "m"), Commit(EMPTY, (), 0, 0, " "), Commit(EMPTY, (), 0, 0, "a\0"), Commit(EMPTY, (EMPTY,) * 65, 0, 0, "m")):
        with pytest.raises(Corrupt):
            codecs.encode_commit(bad)
    raw = codecs.encode_commit(Commit(EMPTY, (), -5, 0, "m"))
    assert codecs.decode_commit(raw).epoch_sec == -5
    for bad in (raw + b"x", raw[:-1], b"SVC2" + raw[4:]):
        with pytest.raises(Corrupt):
            codecs.decode_commit(bad)


def test_cache_golden():
    entries = [codecs.CacheEntry("a.txt", 3, 1_699_000_000_000_000_000, 1, 2, "ab" * 32)]
    raw = codecs.encode_cache(1_700_000_000_000_000_000, entries)
    assert raw.hex() == "535644430000000117979cfe362a00000000000100000005612e747874000000000000000317940f7f9163800000000000000000010000000000000002" + "ab" * 32
    assert codecs.decode_cache(raw) == (1_700_000_000_000_000_000, entries)
    for bad in (b"", raw[:-1], raw + b"x", b"X" + raw[1:]):
        assert codecs.decode_cache(bad) == (0, [])


def test_index_round_trip():
    index = codecs.VectorIndex("m", 3, [codecs.VectorEntry("ab" * 32, 0, "snippet", (1.0, 0.5, -2.0)), codecs.VectorEntry("cd" * 32, 7, "caf\u00e9", (0.0, 0.0, 1.0))])
    raw = codecs.encode_index(index)
    assert codecs.decode_index(raw) == index
    for bad in (raw[:-1], b"SVX2" + raw[4:], raw[:9] + struct.pack(">i", 0) + raw[13:], raw[:9] + struct.pack(">i", 1 << 17) + raw[13:]):
        with pytest.raises(Corrupt):
            codecs.decode_index(bad)
    with pytest.raises(Corrupt):
        codecs.encode_index(codecs.VectorIndex("m", 2, index.entries))


def test_containers():
    data = codecs.canonical("blob", b"x" * 5000)
    for packed in (codecs.pack_legacy(data), codecs.pack_full(data), b"SVO2\x01\x01" + zlib.compress(data), codecs.pack_legacy(data) + b"after"):
        assert codecs.unpack(packed) == data
    assert codecs.base_of(codecs.pack_delta(BLOB, b"x")) == BLOB
    assert codecs.base_of(codecs.pack_full(data)) is None
    frame = zstandard.ZstdCompressor().compress(data)
    skippable = b"\x50\x2a\x4d\x18" + struct.pack("<I", 3) + b"abc"
    for bad in (b"", b"S", b"SVO2", b"SVO2\x03\x01x", b"SVO2\x01\x03x", b"XXXXXXXX", b"SVO2\x02\x02" + bytes(31), b"SVO2\x01\x02" + frame + b"x", b"SVO2\x01\x02" + frame + frame, b"SVO2\x01\x02" + skippable + frame, b"SVO2\x01\x02" + frame[:-1], codecs.pack_legacy(data)[:-3]):
        with pytest.raises(Corrupt):
            codecs.unpack(bad)
    for size in (None, 0, 5, 200_000):
        text = os.urandom(size or 100)
        c = zstandard.ZstdCompressor(write_checksum=bool(size), write_content_size=size is not None)
        assert codecs.unzstd(c.compress(text)) == text


def test_canonical_header():
    assert codecs.parse_canonical(b"blob 3\0abc") == ("blob", b"abc")
    assert codecs.parse_canonical(b"blob 003\0abc") == ("blob", b"abc")
    for bad in (b"blob 3\0ab", b"blob 3\0abcd", b"blob +3\0abc", b"blob -0\0", b"blub 3\0abc", b"blob3\0abc", b"blob 3", b"blob " + b"0" * 130 + b"\0", b"blob 99999999999\0"):
        with pytest.raises(Corrupt):
            codecs.parse_canonical(bad)


def test_delta_worked_example():
    base, target = b"blob 12\0hello world\n", b"blob 13\0hello worlds\n"
    assert delta.apply(base, bytes.fromhex("141508626c6f622031330091080b02730a")) == target
    assert delta.put_varint(20).hex() == "14" and delta.put_varint(300).hex() == "ac02"
    assert delta.apply(bytes(65536), delta.put_varint(65536) * 2 + b"\x80") == bytes(65536)


@pytest.mark.parametrize("base, bad", [(10, "0a0a91080a"), (5, "0505" + "0561"), (4, "04ff"), (3, "030300"), (10, "0b0a900a"), (5, "050691" + "0005"), (5, "050490" + "05"), (5, "0505b0ff"), (0, "00" + "ff" * 10)])
def test_delta_refusals(base, bad):
    with pytest.raises(delta.DeltaError):
        delta.apply(bytes(base), bytes.fromhex(bad))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=60), st.integers(0, 400), st.integers(0, 400))
def test_delta_round_trip(base, new, at, end):
    target = base[:at] + new + base[end:] + base[: at // 2]
    assert delta.apply(base, delta.encode(base, target)) == target


def test_delta_is_small_and_splits_long_runs():
    r = random.Random(1)
    base = r.randbytes(70_000)
    target = base[:30_000] + b"edit" + base[30_000:]
    packed = delta.encode(base, target)
    assert delta.apply(base, packed) == target and len(packed) < 60
    big = r.randbytes(1000) * 17_000
    assert delta.apply(big, delta.encode(big, big)) == big
    assert delta.apply(b"", delta.encode(b"", base[:1000])) == base[:1000]


def test_embedding_golden():
    v = lexical.embed("Payment systems process transactions between banks and merchants.")
    assert hashlib.sha256(v.astype(">f4").tobytes()).hexdigest() == "5279deff44d95d45d84cb5a8e906ae4d6ae4d693b74721385e8fefc60d95acdf"
    assert lexical.fnv1a(b"foobar") == 3214735720
    assert not lexical.embed("the of and").any()
    assert [t for t in lexical.tokens("\u0130x \u03a3\u03a3 A1_b\u0663") if t] == ["ix", "\u03c3\u03c3", "a1", "b\u0663"]


def make_pdf(content: bytes, flate: bool, raw: bool = False) -> bytes:
    body = zlib.compress(content) if flate else content
    if raw:
        body = body[2:-4]
    head = b"/Filter /FlateDecode " if flate else b""
    return b"%PDF-1.4\n\xff\xfe\n1 0 obj << " + head + b">>\nstream\n" + body + b"\nendstream\nendobj\n"


@pytest.mark.parametrize("flate, raw", [(False, False), (True, False), (True, True)])
def test_pdf(flate, raw):
    content = rb"BT (Hello \(nested (deep)\) \101\n) Tj << /A 1 >> <776f726c6> Tj ET (outside) BT (x\\y) ET"
    assert pdf.extract(make_pdf(content, flate, raw)) == "Hello (nested (deep)) A\n worl` x\\y"


def test_extract():
    assert pdf.extract(b"plain \xc3\xa9 text\n") == "plain \u00e9 text\n"
    assert pdf.extract(b"\x01" * 100) is None and pdf.extract(b"") is None and pdf.extract(None) is None
    assert pdf.extract(b"%PDF-1.4 but printable") == "%PDF-1.4 but printable"
    assert pdf.extract(b"\xff\xfe") is None and pdf.extract(make_pdf(b"no text", False)) is None
    long = "\u00e9".encode() * 600_000
    assert len(pdf.extract(long).encode()) == 1 << 20
    assert len(pdf.extract(b"x" + long).encode()) == (1 << 20) - 1
    assert np.isclose(pdf.printable_share("ab\x01\n"), 0.75)
