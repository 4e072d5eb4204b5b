"""Small documents that are published whole or not at all, listings, copies of assets, and summaries for people."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hex_parse, last_segment
from .archive import safe_path


def _path(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_whole(spark: SparkSession, target: str, text: str, replace: bool = False) -> None:
    """Writes a text beside the target and renames it; an existing target is refused unless `replace`."""
    path, fs = _path(spark, target)
    if fs.exists(path):
        if not replace:
            raise FileExistsError(target)
    own, _ = _path(spark, f"{target}.{hashlib.sha256(text.encode()).hexdigest()[:16]}.tmp")
    stream = fs.create(own, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(path):
        fs.delete(path, False)
    if not fs.rename(own, path):
        raise OSError(f"cannot write {target}")


def pretty(value: object) -> str:
    """JSON for people: two spaces, control and direction marks escaped."""
    text = json.dumps(value, indent=2, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if ord(c) == 0x7F or 0x80 <= ord(c) < 0xA0 or 0x202A <= ord(c) <= 0x202E or 0x2066 <= ord(c) <= 0x2069 else c for c in text) + "\n"


def manifest(spark: SparkSession, target: str, schema: str, facts: dict, coverage: DataFrame, warnings: DataFrame | None = None) -> dict:
    """The manifest of a publication: its facts, the one row of coverage counts, and the warnings in order."""
    rows = coverage.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("coverage is one row")
    document = {"schema": schema, **facts, "coverage": rows[0].asDict(), "warnings": [r.asDict() for r in warnings.collect()] if warnings is not None else []}
    write_whole(spark, target, pretty(document))
    return document


def assembly(functions: DataFrame) -> DataFrame:
    """place and text of the listing of each distinct (address, size), the first by `place`.

    functions: place, name, owner, address, size, instructions (address, bytes, mnemonic, operands, object_pool_index,
    object_pool_value), control_flow (from, to, kind).
    """
    first = functions.groupBy("address", "size").agg(F.min_by(F.struct("place", "name", "owner", "instructions", "control_flow"), "place").alias("f")).select("address", "size", "f.*")
    head = F.concat(F.lit("\n# "), F.coalesce("owner", F.lit("top_level")), F.lit("."), "name", F.lit(" at "), "address", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)"))

    def line(i):
        pool = F.when(i["object_pool_index"].isNotNull() & i["object_pool_value"].isNotNull(), F.concat(F.lit("  # pool["), i["object_pool_index"].cast("string"), F.lit("] = "), i["object_pool_value"])).otherwise("")
        wide = lambda c, n: F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c)
        return F.concat(i["address"], F.lit("  "), wide(i["bytes"], 18), F.lit(" "), wide(i["mnemonic"], 8), F.lit(" "), i["operands"], pool)

    edges = F.array_join(F.transform("control_flow", lambda e: F.concat(F.lit(" "), e["from"], F.lit("->"), e["to"], F.lit("/"), e["kind"])), "")
    flow = F.when(F.size("control_flow") > 0, F.array(F.concat(F.lit("# CFG:"), edges))).otherwise(F.array().cast("array<string>"))
    return first.select("place", F.array_join(F.concat(F.array(head), F.transform("instructions", line), flow), "\n").alias("text"))


def write_assembly(functions: DataFrame, target: str) -> None:
    """The listings as text files, in order of their place: by ranges, so no task holds them all."""
    listed = assembly(functions)
    listed.repartitionByRange("place").sortWithinPartitions("place").select("text").write.mode("errorifexists").text(target)


def copy_assets(members: DataFrame, target: str) -> DataFrame:
    """Writes each member below the target folder, which all executors see; path, size, sha256 of what was written.

    members: path, declared_size, content. Unsafe names, sizes other than declared and two members of one name fail the copy.
    """
    from pyarrow import fs as arrow_fs

    local = ":" not in target.split("/", 1)[0] or target.startswith("file:")
    root = "/" + target.removeprefix("file:").lstrip("/") if local else target

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = (arrow_fs.LocalFileSystem(), root) if local else arrow_fs.FileSystem.from_uri(root)
        for frame in frames:
            rows = []
            for path, declared, content in zip(frame["path"], frame["declared_size"], frame["content"], strict=True):
                data = bytes(content)
                if not safe_path(path):
                    raise ValueError(f"unsafe asset name {path!r}")
                if len(data) != declared:
                    raise ValueError(f"asset {path!r} declared {declared} bytes but has {len(data)}")
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as sink:
                    sink.write(data)
                rows.append((path, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256"])

    once = members.groupBy("path").agg(F.count("*").alias("_n")).where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("asset given twice: "), "path")).cast("boolean")).otherwise(F.lit(True)))
    return members.select("path", "declared_size", "content").join(once.select("path"), "path").mapInPandas(write, "path string, size long, sha256 string")


def binding(spark: SparkSession, document: bytes, analyser: bytes, subject: dict, metadata: dict, target: str, replace: bool = False) -> dict:
    """Binds a document to the program that made it and to its subject: sizes and digests of both, version and word layout."""
    identity = lambda data: {"size": len(data), "sha256": hashlib.sha256(data).hexdigest()}
    for field in ("dart_commit", "target_arch"):
        if not metadata.get(field):
            raise ValueError(f"the document does not say its {field}")
    if not all(0 < metadata[w] < 256 for w in ("word_size", "compressed_word_size")):
        raise ValueError("word sizes are one byte")
    layout = {"word_size": metadata["word_size"], "compressed_word_size": metadata["compressed_word_size"]}
    out = {
        "schema": "oracle-binding/v1", "subject": subject, "document": identity(document),
        "analyzer": {"executable": identity(analyser), "analyzer_schema": metadata.get("analyzer_version"), "dart_version": metadata.get("dart_version"), "dart_commit": metadata["dart_commit"], "target_arch": metadata["target_arch"], "pointer_layout": layout},
    }
    write_whole(spark, target, pretty(out), replace)
    return out


def verify_binding(bound: dict, document: bytes, subject: dict) -> None:
    """Fails unless the document and subject are the ones that were bound."""
    if bound["document"] != {"size": len(document), "sha256": hashlib.sha256(document).hexdigest()}:
        raise ValueError("the document is not the bound one")
    if bound["subject"] != subject:
        raise ValueError("the subject is not the bound one")


def readme(title: str, counts: dict[str, int], notes: list[str]) -> str:
    """A short text about a publication: its counts and what to know about it."""
    lines = [f"# {title}", "", *[f"- {name}: {n:,}" for name, n in counts.items()], "", *notes]
    return "\n".join(lines) + "\n"


def summary(df: DataFrame, limit: int = 50, as_json: bool = False) -> str:
    """The first rows of a report for a console: aligned columns, or one JSON object a line."""
    rows = df.limit(limit).collect()
    if as_json:
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in rows)
    table = [df.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(len(line[k]) for line in table) for k in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(line, widths, strict=True)).rstrip() for line in table)


def function_index(functions: DataFrame) -> DataFrame:
    """The index rows of functions: identity, place, kind, and the number of bodies inlined into each."""
    kept = ["name", "owner", "library_uri", "address", "size", "code_reference", "code_alias_references", "name_source", "source_location", "kind", "signature", "signature_source", "async_modifier"]
    inlined = F.size("inlined_functions") if "inlined_functions" in functions.columns else F.lit(0)
    own = [F.col(c) if c in functions.columns else F.lit(None).cast("string").alias(c) for c in kept]
    return functions.select(*own, F.greatest(inlined, F.lit(0)).cast("long").alias("inlined_function_count"), hex_parse("address").alias("offset"), last_segment("name").alias("member"))


def deferred_units(files: DataFrame) -> DataFrame:
    """path, size, sha256, build_id, text_symbols, snapshot_symbols, instruction_section_bytes of each image. files: path, content."""
    from .archive import elf_sections, elf_symbols_detailed

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                data = bytes(raw)
                sections, symbols = elf_sections(data), elf_symbols_detailed(data)
                names = sorted({n for n, *_ in symbols if "Snapshot" in n or "LoadingUnit" in n})
                code = sum(size for n, _, _, size in sections if "text" in n or "SnapshotInstructions" in n)
                note = next((data[o : o + s] for n, _, o, s in sections if n == ".note.gnu.build-id"), b"")
                build = note[16:].hex() if len(note) > 16 else None
                texts = sum(address != 0 and defined and kind == 2 for _, address, _, kind, defined in symbols)
                rows.append((path, len(data), hashlib.sha256(data).hexdigest(), build, texts, names, code))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "build_id", "text_symbols", "snapshot_symbols", "instruction_section_bytes"])

    return files.select("path", "content").mapInPandas(scan, "path string, size long, sha256 string, build_id string, text_symbols long, snapshot_symbols array<string>, instruction_section_bytes long")
