"""Byte streams made here and decoded again."""

import random

from factweave.sources import decoders


def signed(v):
    out = bytearray()
    while True:
        b, v = v & 0x7F, v >> 7
        if v == 0 and not b & 0x40 or v == -1 and b & 0x40:
            return bytes(out + bytes([b]))
        out.append(b | 0x80)


def unsigned(v):
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes(out + bytes([v]))


def field(number, value):
    return unsigned(number << 3) + unsigned(value) if isinstance(value, int) else unsigned(number << 3 | 2) + unsigned(len(value)) + value


def test_dispatch():
    assert decoders.decode_dispatch(iter([64 + 5, 3, 0, ~0, 64 + 9, ~1]), 8) == [5, 5, 5, 5, None, 5, 9, 9]
    assert decoders.decode_dispatch(iter([~0]), 1) is None  # nothing recent
    assert decoders.decode_dispatch(iter([64, 1, 1]), 2) is None  # rest behind the end
    assert decoders.decode_dispatch(iter([64]), 2) is None  # cut
    assert decoders.decode_dispatch(iter([64 + k for k in range(65)] + [~0]), 66)[-1] == 64  # the ring starts over


def test_source_map():
    words = [0 | 5 << 3, 1 | 4 << 3, 2 | 0 << 3, 0 | 9 << 3, 3, 1 | 2 << 3]
    got = decoders.source_map(b"".join(map(signed, words)))
    assert [(pc, depth, line) for pc, _, _, depth, line in got] == [(0, 0, 4), (4, 0, 4), (4, 1, None), (4, 1, 8), (4, 0, 4), (6, 0, 4)]
    assert decoders.source_map(b"\x80") == []


def test_descriptors(spark):
    data = b"".join(map(signed, [1 | (3 << 3) | (2 << 13), 8, 3, 4, 7 | (1 << 3), -2]))
    df = spark.createDataFrame([("k", bytearray(data)), ("none", bytearray())], "k string, b binary")
    got = [tuple(r) for r in decoders.descriptors(df, "k", "b").orderBy("place").collect()]
    assert got == [("k", 0, 8, "ic_call", 2, 1), ("k", 1, 12, "runtime_call", -1, -1), ("k", 2, 10, "unknown", 0, -1)]
    entries = df.select(decoders.source_map_entries("b").alias("e")).collect()
    assert entries[1].e == []


def test_proto_manifest(spark):
    def attribute(name, value=b"", number=None):
        item = field(6, field(7, field(6, number))) if number is not None else b""
        return field(4, field(2, name) + (field(3, value) if value else b"") + item)

    def element(name, attributes=b"", children=b""):
        return field(1, field(3, name) + attributes + children)

    permission = field(5, element(b"uses-permission", attribute(b"name", b"net")))
    sdk = field(5, element(b"uses-sdk", attribute(b"minSdkVersion", number=21)))
    root = element(b"manifest", attribute(b"package", b"org.x") + attribute(b"versionCode", number=7) + attribute(b"versionCodeMajor", b"1"), permission + permission + sdk)
    got = decoders.proto_manifest_facts(spark.createDataFrame([("p", bytearray(root))], "path string, content binary")).first()
    assert tuple(got) == ("p", "org.x", None, (1 << 32) | 7, 21, ["net"])


def test_signed_numbers_roundtrip():
    rng = random.Random(1)
    for _ in range(500):
        v = rng.randint(-(1 << 40), 1 << 40)
        assert decoders.read_signed_varint(signed(v)) == (v, len(signed(v)))
        assert decoders.read_varint(unsigned(abs(v))) == (abs(v), len(unsigned(abs(v))))


def unsigned_number(v):
    out = b""
    while v > 0x7F:
        out += bytes([v & 0x7F])
        v >>= 7
    return out + bytes([v + 128])


def tagged_number(v):
    out = b""
    while not -64 <= v < 64:
        out += bytes([v & 0x7F])
        v >>= 7
    return out + bytes([v + 192])


def test_tagged_numbers_come_back():
    from factweave.functions import kernels

    for v in (0, 1, -1, 63, 64, -64, -65, 1 << 40, -(1 << 40)):
        assert kernels.read_tagged64(tagged_number(v)) == (v, len(tagged_number(v)))
    for v in (0, 127, 128, 1 << 50):
        assert kernels.read_unsigned(unsigned_number(v)) == (v, len(unsigned_number(v)))


def test_dispatch_is_found_from_the_end():
    entries = b"".join(map(tagged_number, (70, 0, 3, -1, 80)))
    table = [6, None, None, None, None, 6, 16]
    data = b"\x81\x82\x83 noise" + unsigned_number(len(table)) + unsigned_number(9) + entries
    assert decoders.find_dispatch(data, 2, len(data), 9) == table
    assert decoders.find_dispatch(data + b"\xc1", 2, len(data) + 1, 9) == [] == decoders.find_dispatch(data, 2, len(data), 8)
    assert decoders.find_dispatch(data, 5, 5, 9) == [] == decoders.find_dispatch(data, 0, len(data), 0)


def test_snapshot_headers_and_images(spark):
    import struct

    import pytest

    good = bytes.fromhex("f5f5dcdc") + struct.pack("<Qq", 99, 3) + b"0123456789abcdef" * 2 + b"product arm64 \0rest"
    assert decoders.snapshot_header(good) == {"length": 99, "kind": "full_aot", "snapshot_hash": "0123456789abcdef" * 2, "features": ["product", "arm64"]}
    for bad in (good[:40], b"x" + good[1:], good.replace(b"abcdef", b"ABCDEF"), good[:0x34] + b"f" * 2000):
        with pytest.raises(ValueError):
            decoders.snapshot_header(bad)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"x")), (3, None)], "id long, b binary")
    rows = {r.id: r.h for r in df.select("id", decoders.snapshot_headers("b").alias("h")).collect()}
    assert rows[1].features == ["product", "arm64"] and rows[1].length == 99 and rows[2].error and rows[2].length is None and rows[3].error is None
    for width, form in ((8, "<Q"), (4, "<I")):
        word = lambda v: struct.pack(form, v)  # noqa: B023, E731
        head = word(0) + word(16) + bytes(16 - 2 * width) + word(0) + word(5) + bytes(3 * width) + b"code!after"
        data = word(len(head)) + head[width:]
        assert decoders.code_image(data, width) == (16 + 5 * width, b"code!")
        with pytest.raises(ValueError):
            decoders.code_image(word(len(head) + 1) + head[width:], width)
    with pytest.raises(ValueError):
        decoders.code_image(b"", 8)
    with pytest.raises(ValueError):
        decoders.code_image(data, 2)
