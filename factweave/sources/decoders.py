"""Sequential byte streams as rows. Each stream is decoded on its own, in Arrow batches; what orders follow is plain SQL.

Values of a stream depend on all values before them, so built-in functions cannot decode them; a stream that is cut or
malformed gives null and never a part.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.kernels import read_signed_varint, read_tagged64, read_unsigned, read_varint

#: Fixed values of the dispatch stream: slots of the recent values, longest repeat, and what a fresh index is shifted by.
RECENT, LONGEST_REPEAT, FRESH = 64, 63, 64
#: Kinds of descriptors by their low three bits.
DESCRIPTOR_KINDS = ["deopt", "ic_call", "unoptimized_static_call", "runtime_call", "osr_entry", "rewind", "other", "unknown"]
NODE_LIMIT, MOST_ENTRIES = 1_000_000, 20_000_000


def decode_dispatch(values: Iterator[int], length: int) -> list[int | None] | None:
    """A run-length stream: 0 is an empty slot, a negative number recalls a recent value, a small one repeats, others are new."""
    table: list[int | None] = []
    recent: list[int | None] = [None] * RECENT
    current: int | None = None
    fresh = 0
    for v in values:
        times = 1
        if v == 0:
            current = None
        elif v < 0:
            if ~v >= RECENT or recent[~v] is None:
                return None
            current = recent[~v]
        elif v <= LONGEST_REPEAT:
            times = v
        else:
            current = v - FRESH
            recent[fresh % RECENT] = current
            fresh += 1
        table += [current] * times
        if len(table) >= length:
            break
    return table if len(table) == length and next(values, None) is None else None


def find_dispatch(data: bytes, begin: int, end: int, first_reference: int) -> list[int | None]:
    """The table at the end of a stream: the last place from which a length, the first reference and exactly so many entries reach the end.

    Empty if there is no such place. A length that the bytes left could not fill is passed over without being decoded.
    """
    if not 0 <= begin < end <= len(data) or first_reference <= 0:
        return []
    data = data[:end]
    for start in range(end - 1, begin - 1, -1):
        try:
            length, at = read_unsigned(data, start)
            reference, at = read_unsigned(data, at)
        except (IndexError, ValueError):
            continue
        if reference != first_reference or not 0 < length <= min(MOST_ENTRIES, (end - at) * LONGEST_REPEAT + 1):
            continue
        table = decode_dispatch(_tagged(data, at), length)
        if table is not None:
            return table
    return []


def _tagged(data: bytes, at: int) -> Iterator[int]:
    """Tagged numbers to the end; a cut one is a value that no table holds."""
    while at < len(data):
        try:
            value, at = read_tagged64(data, at)
        except (IndexError, ValueError):
            value, at = -1 << 40, len(data)
        yield value


#: The first bytes of a snapshot, places of its hash and features, kinds by number.
SNAPSHOT_MAGIC, HASH_AT, FEATURES_AT, MOST_FEATURES = bytes.fromhex("f5f5dcdc"), 0x14, 0x34, 1024
SNAPSHOT_KINDS = ["full", "full_core", "full_jit", "full_aot"]


def snapshot_header(data: bytes) -> dict:
    """length, kind, snapshot_hash and features of a snapshot; anything malformed is an error."""
    if len(data) <= FEATURES_AT or data[:4] != SNAPSHOT_MAGIC:
        raise ValueError("no snapshot header")
    length, kind = struct.unpack_from("<Qq", data, 4)
    digest = data[HASH_AT : HASH_AT + 32]
    if any(c not in b"0123456789abcdef" for c in digest):
        raise ValueError("malformed snapshot hash")
    features, mark, _ = data[FEATURES_AT : FEATURES_AT + MOST_FEATURES].partition(b"\0")
    if not mark:
        raise ValueError("snapshot features do not end")
    name = SNAPSHOT_KINDS[kind] if 0 <= kind < len(SNAPSHOT_KINDS) else f"unknown({kind})"
    return {"length": length, "kind": name, "snapshot_hash": digest.decode(), "features": features.decode(errors="replace").split()}


def code_image(data: bytes, width: int) -> tuple[int, bytes]:
    """Offset and bytes of the code in an image of instructions with words of 4 or 8 bytes."""
    if width not in (4, 8):
        raise ValueError(f"no machine has words of {width} bytes")
    word = lambda at: int.from_bytes(data[at : at + width], "little") if at + width <= len(data) else _cut(at)
    size, section = word(0), word(width)
    if size > len(data):
        raise ValueError(f"image declares {size} bytes but has {len(data)}")
    begin = section + 5 * width
    end = min(begin + word(section + width), size)
    if begin > end:
        raise ValueError("code lies outside the image")
    return begin, data[begin:end]


def _cut(at: int):
    raise ValueError(f"image word at {at} is cut")


@pandas_udf(T.StructType([T.StructField("length", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("snapshot_hash", T.StringType()), T.StructField("features", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))
def snapshot_headers(x: pd.Series) -> pd.DataFrame:
    """Headers of binaries; malformed ones have what is wrong in `error` and nothing else."""

    def one(raw):
        try:
            return {**snapshot_header(bytes(raw)), "error": None}
        except ValueError as e:
            return {"error": str(e)}

    fields = ["length", "kind", "snapshot_hash", "features", "error"]
    rows = [{} if v is None else one(v) for v in x]
    return pd.DataFrame({f: pd.Series([r.get(f) for r in rows], dtype="Int64" if f == "length" else object) for f in fields})


def source_map(data: bytes) -> list[tuple[int, str, int, int, int | None]]:
    """(pc, operation, argument, depth, line): a stack of lines, one for each function that is inlined, with running pc."""
    names = ["change_position", "advance_pc", "push_function", "pop_function", "null_check"]
    at, pc, lines, out = 0, 0, [-1], []
    try:
        while at < len(data):
            word, at = read_signed_varint(data, at)
            code, argument = word & 7, word >> 3
            if code == 0:
                lines[-1] += argument
            elif code == 1:
                pc += max(argument, 0)
            elif code == 2:
                lines.append(-1)
            elif code == 3 and len(lines) > 1:
                lines.pop()
            out.append((pc, names[code] if code < len(names) else "unknown", argument, len(lines) - 1, lines[-1] if lines[-1] > 0 else None))
            if code >= len(names):
                break
    except IndexError:
        pass  # a cut last entry is left out
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("pc", T.LongType()), T.StructField("operation", T.StringType()), T.StructField("argument", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("line", T.LongType())])))
def source_map_entries(x: pd.Series) -> pd.Series:
    names = ("pc", "operation", "argument", "depth", "line")
    return x.map(lambda v: None if v is None else [dict(zip(names, e, strict=True)) for e in source_map(bytes(v))])


@pandas_udf(T.ArrayType(T.LongType()))
def signed_varints(x: pd.Series) -> pd.Series:
    """All signed LEB128 numbers of the bytes; a cut last one is left out."""

    def decode(data):
        if data is None:
            return None
        data, at, out = bytes(data), 0, []
        try:
            while at < len(data):
                value, at = read_signed_varint(data, at)
                out.append(value)
        except IndexError:
            pass
        return out

    return x.map(decode)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("pc", T.LongType())])))
def descriptor_words(x: pd.Series) -> pd.Series:
    """Pairs of a word and a distance, the distances summed up; bytes behind the last whole pair are left."""

    def decode(data):
        out, at, pc, data = [], 0, 0, bytes(data)
        try:
            while at < len(data):
                word, at = read_signed_varint(data, at)
                delta, at = read_signed_varint(data, at)
                pc += delta
                out.append({"word": word, "pc": pc})
        except IndexError:
            pass
        return out

    return x.map(lambda v: None if v is None else decode(v))


def descriptors(streams: DataFrame, key: str, content: str) -> DataFrame:
    """key, place, pc, kind, try_index, yield_index: numbers and their running sum are decoded in Python, bits are SQL."""
    pairs = streams.select(key, F.posexplode(descriptor_words(content)).alias("place", "d")).select(key, "place", "d.pc", F.col("d.word").bitwiseAND(F.lit(0xFFFFFFFF)).alias("word"))
    kinds, word = F.array(*map(F.lit, DESCRIPTOR_KINDS)), F.col("word")
    return pairs.select(key, "place", "pc", F.get(kinds, word.bitwiseAND(7).cast("int")).alias("kind"), (F.shiftright(word, 3).bitwiseAND(1023) - 1).alias("try_index"), (F.shiftright(word, 13) - 1).alias("yield_index"))


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of one protobuf message: whole numbers, or bytes of nested ones."""
    at = 0
    while at < len(data):
        tag, at = read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind == 2:
            size, at = read_varint(data, at)
            if at + size > len(data):
                raise ValueError("cut message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = struct.unpack_from("<Q" if kind == 1 else "<I", data, at)[0], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield number, value


def proto_xml(data: bytes) -> list[tuple[str, dict[str, str | int]]]:
    """(element, attributes) of a manifest that is stored as protobuf XML."""
    out: list[tuple[str, dict[str, str | int]]] = []
    waiting = [data]
    while waiting:
        element = next((v for n, v in proto_fields(waiting.pop()) if n == 1), None)
        if element is None:
            continue
        if len(out) >= NODE_LIMIT:
            raise ValueError(f"more than {NODE_LIMIT} nodes")
        name, attributes = "", {}
        for n, v in proto_fields(element):
            if n == 3:
                name = v.decode()
            elif n == 4:
                own = dict(proto_fields(v))
                value: str | int = own.get(3, b"").decode()
                if 6 in own:
                    primitive = dict(proto_fields(dict(proto_fields(own[6])).get(7, b"")))
                    value = next((x for k, x in primitive.items() if k in (6, 7, 8)), value)
                attributes[own.get(2, b"").decode()] = value
            elif n == 5:
                waiting.append(v)
        out.append((name, attributes))
    return out


def proto_manifest_facts(listed: DataFrame) -> DataFrame:
    """path, package, version_name, version_code, min_sdk and permissions of protobuf manifests."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                found = proto_xml(bytes(raw))
                root = next((a for e, a in found if e == "manifest"), {})
                sdk = next((a.get("minSdkVersion") for e, a in found if e == "uses-sdk"), None)
                code = (int(root.get("versionCodeMajor") or 0) << 32) | int(root.get("versionCode") or 0)
                rows.append((path, root.get("package"), root.get("versionName"), code, None if sdk in (None, "") else int(sdk), sorted({str(a["name"]) for e, a in found if e == "uses-permission" and a.get("name")})))
            yield pd.DataFrame(rows, columns=["path", "package", "version_name", "version_code", "min_sdk", "permissions"])

    return listed.select("path", "content").mapInPandas(scan, "path string, package string, version_name string, version_code long, min_sdk long, permissions array<string>")
