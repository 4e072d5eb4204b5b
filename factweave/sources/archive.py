"""Archives as tables. Files are listed without their content first, so that limits and names prune before bytes are read."""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBER_LIMIT, MANIFEST_LIMIT = 1 << 30, 32 << 20
#: Order in which a payload is chosen.
ABIS = ["arm64-v8a", "armeabi-v7a", "x86_64"]


def safe_path(path: str) -> bool:
    """Relative, without parent segments, drives or roots."""
    parts = path.replace("\\", "/").split("/")
    return bool(path) and not path.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0]


def is_safe_path(path: Column) -> Column:
    return (path != "") & ~path.rlike(r"^[/\\]|(^|[/\\])\.\.([/\\]|$)|^[A-Za-z]:")


def is_deferred_payload(name: Column) -> Column:
    return name.rlike(r"(^|/)lib[^/]+-[0-9]+\.part\.so$")


def archives(spark: SparkSession, path: str, limit: int = MEMBER_LIMIT) -> DataFrame:
    """path, length and content of archive files up to a size; the size filter reaches the scan."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= limit).select("path", "length", "content")


def members(files: DataFrame, prefix: str = "", limit: int = MEMBER_LIMIT, content: bool = False) -> DataFrame:
    """path, member, size, sha256 (and content) of every archive member under a prefix. Unsafe names fail the scan; wrapped archives are opened once."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                rows = []
                archive = zipfile.ZipFile(io.BytesIO(raw))
                names = archive.namelist()
                if not any(n.endswith(("AndroidManifest.xml", "manifest/AndroidManifest.xml")) for n in names) and (inner := sorted(n for n in names if n.endswith(".apk"))):
                    archive = zipfile.ZipFile(io.BytesIO(archive.read(inner[0])))
                for info in archive.infolist():
                    if info.is_dir() or not info.filename.startswith(prefix):
                        continue
                    if not safe_path(info.filename):
                        raise ValueError(f"unsafe member name {info.filename!r} in {path}")
                    if info.file_size > limit:
                        raise ValueError(f"member {info.filename!r} is larger than {limit} bytes")
                    data = archive.read(info)
                    rows.append((path, info.filename, len(data), hashlib.sha256(data).hexdigest(), data if content else None))
                yield pd.DataFrame(rows, columns=["path", "member", "size", "sha256", "content"])

    return files.select("path", "content").mapInPandas(scan, "path string, member string, size long, sha256 string, content binary")


def payloads(listed: DataFrame, library: str = "libapp.so") -> DataFrame:
    """Members that are native payloads, with their module and machine."""
    found = listed.withColumn("abi", F.regexp_extract("member", rf"lib/([^/]+)/{library}$", 1)).where("abi <> ''")
    return found.withColumn("module", F.coalesce(F.nullif(F.regexp_extract("member", "^([^/]+)/lib/", 1), F.lit("")), F.lit("base")))


def required_payloads(found: DataFrame, files: DataFrame) -> DataFrame:
    """The payloads, failing at run time where an archive has none. files: path of all archives."""
    counts = files.select("path").distinct().join(found.groupBy("path").agg(F.count("*").alias("_n")), "path", "left")
    missing = F.when(F.col("_n").isNull(), F.raise_error(F.concat(F.lit("archive without a payload: "), "path")).cast("boolean")).otherwise(F.lit(True))
    return found.join(counts.where(missing).select("path"), "path")


def select_payload(found: DataFrame, module: str = "base", abi: str | None = None) -> DataFrame:
    """The asked payload of each archive, else the first machine by preference."""
    own = found.where(F.col("module") == module)
    if abi is not None:
        return own.where(F.col("abi") == abi)
    rank = F.array_position(F.array(*map(F.lit, ABIS)), F.col("abi"))
    first = Window.partitionBy("path").orderBy(F.when(rank > 0, rank).otherwise(len(ABIS) + 1), "abi")
    return own.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def elf_sections(data: bytes) -> list[tuple[str, int, int, int]]:
    """(name, address, offset, size) of the sections of an ELF image, 32 or 64 bits, either byte order."""
    if data[:4] != b"\x7fELF":
        raise ValueError("no ELF image")
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    if wide:
        table, (entry, count, names) = struct.unpack_from(order + "Q", data, 0x28)[0], struct.unpack_from(order + "HHH", data, 0x3A)
    else:
        table, (entry, count, names) = struct.unpack_from(order + "I", data, 0x20)[0], struct.unpack_from(order + "HHH", data, 0x2E)
    rows = []
    for k in range(count):
        at = table + k * entry
        if wide:
            name, _, _, address, offset, size = struct.unpack_from(order + "IIQQQQ", data, at)
        else:
            name, _, _, address, offset, size = struct.unpack_from(order + "IIIIII", data, at)
        rows.append((name, address, offset, size))
    strings = rows[names][2] if rows else 0
    return [(data[strings + n : data.index(b"\0", strings + n)].decode("latin-1"), a, o, s) for n, a, o, s in rows]


def elf_symbols_detailed(data: bytes) -> list[tuple[str, int, int, int, bool]]:
    """(name, address, size, kind, defined) of the named static and dynamic symbols of a 64- or 32-bit image."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    sections = {n: (o, s) for n, _, o, s in elf_sections(data)}
    out = []
    for table, strings in ((".symtab", ".strtab"), (".dynsym", ".dynstr")):
        if table in sections and strings in sections:
            (at, size), (names, _) = sections[table], sections[strings]
            step = 24 if wide else 16
            for k in range(at, at + size, step):
                if wide:
                    name, info, _, section, value, length = struct.unpack_from(order + "IBBHQQ", data, k)
                else:
                    name, value, length, info, _, section = struct.unpack_from(order + "IIIBBH", data, k)
                if name:
                    out.append((data[names + name : data.index(b"\0", names + name)].decode("latin-1"), value, length, info & 15, section != 0))
    return out


def elf_symbols(data: bytes) -> list[tuple[str, int, int]]:
    """(name, address, size) of the static and dynamic symbols of a 64- or 32-bit image."""
    return [x[:3] for x in elf_symbols_detailed(data)]


#: Machine numbers of the images that payloads are made for.
MACHINES = {40: "armeabi-v7a", 183: "arm64-v8a", 62: "x86_64"}


def elf_identity(data: bytes) -> tuple[str | None, str | None]:
    """Machine and build id of an image; null where it has none."""
    order = "<" if data[5] == 1 else ">"
    note = next((data[o : o + s] for n, _, o, s in elf_sections(data) if n == ".note.gnu.build-id"), b"")
    return MACHINES.get(struct.unpack_from(order + "H", data, 0x12)[0]), note[16:].hex() or None


def named_regions(listed: DataFrame, names: list[str]) -> DataFrame:
    """path, member, region, address, size, sha256 of the symbols asked for, as far as their bytes lie in one section. listed: path, member, content."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, member, raw in zip(frame["path"], frame["member"], frame["content"], strict=True):
                data = bytes(raw)
                sections = elf_sections(data)
                for name, address, size in sorted(set(elf_symbols(data))):
                    home = next(((a, o) for _, a, o, s in sections if name in names and a and a <= address and address + size <= a + s), None)
                    if home:
                        begin = home[1] + address - home[0]
                        rows.append((path, member, name, address, size, hashlib.sha256(data[begin : begin + size]).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "member", "region", "address", "size", "sha256"])

    return listed.select("path", "member", "content").mapInPandas(scan, "path string, member string, region string, address long, size long, sha256 string")


def symbol_file(files: DataFrame, abi: str, build_id: str) -> str:
    """The first path, by name, of an image of the machine with the build id; files that are no image are passed over. files: path, content."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((path, *elf_identity(bytes(raw))))
                except (ValueError, IndexError, struct.error):
                    continue
            yield pd.DataFrame(rows, columns=["path", "abi", "build_id"])

    found = files.select("path", "content").mapInPandas(scan, "path string, abi string, build_id string")
    best = found.where((F.col("abi") == abi) & (F.col("build_id") == build_id)).agg(F.min("path")).first()[0]
    if best is None:
        raise ValueError(f"no {abi} image has the build id {build_id}")
    return best


def elf_regions(listed: DataFrame) -> DataFrame:
    """path, member, region, address, size, sha256 of the sections of each payload's content."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, member, raw in zip(frame["path"], frame["member"], frame["content"], strict=True):
                data = bytes(raw)
                rows += [(path, member, n, a, s, hashlib.sha256(data[o : o + s]).hexdigest()) for n, a, o, s in elf_sections(data)]
            yield pd.DataFrame(rows, columns=["path", "member", "region", "address", "size", "sha256"])

    return listed.select("path", "member", "content").mapInPandas(scan, "path string, member string, region string, address long, size long, sha256 string")


def printable_runs(data: bytes, least: int = 4, most: int = 16384) -> list[tuple[int, str]]:
    """(offset, text) of runs of tab and printable ASCII."""
    import re

    return [(m.start(), m[0].decode()) for m in re.finditer(rb"[\t\x20-\x7e]{%d,%d}" % (least, most), data)]


def string_scan(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, file_offset, value of the printable runs of binary contents."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, o, v) for k, raw in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True) if raw is not None for o, v in printable_runs(bytes(raw))]
            yield pd.DataFrame(rows, columns=["key", "file_offset", "value"])

    kind = dict(files.dtypes)[key]
    return files.select(key, content).mapInPandas(scan, f"key {kind}, file_offset long, value string")


def binary_xml(data: bytes) -> list[tuple[int, str, dict[str, str]]]:
    """(depth, element, attributes) of a compiled manifest."""
    kind, _, _ = struct.unpack_from("<HHI", data, 0)
    if kind != 0x0003:
        raise ValueError("no compiled XML")
    at, strings, depth, out = 8, [], 0, []
    while at + 8 <= len(data):
        kind, head, size = struct.unpack_from("<HHI", data, at)
        if kind == 0x0001:
            count, _, flags, start, _ = struct.unpack_from("<IIIII", data, at + 8)
            offsets = struct.unpack_from(f"<{count}I", data, at + head)
            for o in offsets:
                p = at + start + o
                if flags & 0x100:
                    p += 2 if data[p] & 0x80 else 1
                    n = data[p]
                    p += 1
                    if n & 0x80:
                        n, p = (n & 0x7F) << 8 | data[p], p + 1
                    strings.append(data[p : p + n].decode("utf-8", "replace"))
                else:
                    n = struct.unpack_from("<H", data, p)[0]
                    p += 2
                    if n & 0x8000:
                        n, p = (n & 0x7FFF) << 16 | struct.unpack_from("<H", data, p)[0], p + 2
                    strings.append(data[p : p + 2 * n].decode("utf-16-le", "replace"))
        elif kind == 0x0102:
            _, name, first, step, count = struct.unpack_from("<IIHHH", data, at + head)
            attributes = {}
            for k in range(count):
                _, key, raw, _, _, value_kind, value = struct.unpack_from("<IIIHBBI", data, at + head + first + k * step)
                attributes[strings[key]] = strings[raw] if raw != 0xFFFFFFFF else strings[value] if value_kind == 3 else str(value)
            out.append((depth, strings[name], attributes))
            depth += 1
        elif kind == 0x0103:
            depth -= 1
        at += max(size, 8)
    return out


def manifest_facts(listed: DataFrame) -> DataFrame:
    """path, package, version_name, min_sdk and permissions of compiled manifests."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                found = binary_xml(bytes(raw))
                root = next((a for _, e, a in found if e == "manifest"), {})
                sdk = next((a.get("minSdkVersion") for _, e, a in found if e == "uses-sdk"), None)
                rows.append((path, root.get("package"), root.get("versionName"), sdk, sorted(a["name"] for _, e, a in found if e == "uses-permission" and "name" in a)))
            yield pd.DataFrame(rows, columns=["path", "package", "version_name", "min_sdk", "permissions"])

    return listed.where(F.col("size") <= MANIFEST_LIMIT).select("path", "content").mapInPandas(scan, "path string, package string, version_name string, min_sdk string, permissions array<string>")
