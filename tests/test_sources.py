"""Archives, images, manifests, documents and sinks on small files made here."""

import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from factweave.sources import archive, documents
from factweave.streaming import trace_stream


def elf64(sections):
    """A 64-bit little-endian image with the given (name, address, bytes)."""
    names = b"\0" + b"".join(n.encode() + b"\0" for n, _, _ in sections) + b".shstrtab\0"
    body, offsets = b"", []
    for _, _, data in [*sections, ("", 0, names)]:
        offsets.append(64 + len(body))
        body += data
    table = 64 + len(body)
    head = b"\x7fELF" + bytes([2, 1, 1]) + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 183, 1, 0, 0, table, 0, 64, 0, 0, 64, len(sections) + 1, len(sections))
    rows, at = b"", 1
    for k, (name, address, data) in enumerate([*sections, (".shstrtab", 0, names)]):
        rows += struct.pack("<IIQQQQIIQQ", at, 1, 0, address, offsets[k], len(data), 0, 0, 1, 0)
        at += len(name) + 1
    return head + body + rows


def compiled_xml(package):
    strings = ["manifest", "package", package, "uses-permission", "name", "net"]
    data, offsets = b"", []
    for s in strings:
        offsets.append(len(data))
        data += struct.pack("<H", len(s)) + s.encode("utf-16-le") + b"\0\0"
    start = 28 + 4 * len(strings)
    data += bytes(-len(data) % 4)
    pool = struct.pack("<HHIIIIII", 1, 28, start + len(data), len(strings), 0, 0, start, 0) + struct.pack(f"<{len(strings)}I", *offsets) + data

    def element(name, key, value):
        body = struct.pack("<IIHHHHHH", 0xFFFFFFFF, name, 20, 20, 1, 0, 0, 0) + struct.pack("<IIIHBBI", 0xFFFFFFFF, key, value, 8, 0, 3, value)
        return struct.pack("<HHIII", 0x102, 16, 16 + len(body), 0, 0) + body

    def end(name):
        return struct.pack("<HHIII", 0x103, 16, 24, 0, 0) + struct.pack("<II", 0xFFFFFFFF, name)

    body = pool + element(0, 1, 2) + element(3, 4, 5) + end(3) + end(0)
    return struct.pack("<HHI", 3, 8, 8 + len(body)) + body


@pytest.fixture
def apk(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("AndroidManifest.xml", compiled_xml("org.example.app"))
        z.writestr("lib/arm64-v8a/libapp.so", elf64([(".text", 4096, b"\0\1hello world\0ab"), (".rodata", 8192, b"x" * 10)]))
        z.writestr("lib/x86_64/libapp.so", elf64([(".text", 0, b"z")]))
        z.writestr("assets/a.txt", "text")
    return str(tmp_path / "a.apk")


def test_archive(spark, apk):
    listed = archive.members(archive.archives(spark, apk), content=True)
    assert {r.member for r in listed.collect()} >= {"AndroidManifest.xml", "assets/a.txt"}
    found = archive.payloads(listed)
    assert {(r.module, r.abi) for r in found.collect()} == {("base", "arm64-v8a"), ("base", "x86_64")}
    chosen = archive.select_payload(found)
    assert [r.abi for r in chosen.collect()] == ["arm64-v8a"] and [r.abi for r in archive.select_payload(found, abi="x86_64").collect()] == ["x86_64"]
    regions = {r.region: (r.address, r.size) for r in archive.elf_regions(chosen).collect()}
    assert regions[".text"] == (4096, 16) and regions[".rodata"] == (8192, 10)
    facts = archive.manifest_facts(listed.where("member = 'AndroidManifest.xml'")).first()
    assert facts.package == "org.example.app" and facts.permissions == ["net"]
    assert (66, "hello world") in {(r.file_offset, r.value) for r in archive.string_scan(chosen).collect()}


def test_wrapped_archive(spark, apk, tmp_path):
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.write(apk, "inner.apk")
    assert "assets/a.txt" in {r.member for r in archive.members(archive.archives(spark, str(tmp_path / "w.zip")), prefix="assets/").collect()}


def test_unsafe_names(spark, tmp_path):
    for bad in ("/x", "a/../b", "..", "C:/x", ""):
        assert not archive.safe_path(bad)
    df = spark.createDataFrame([("a/b",), ("/x",), ("a/../b",), ("C:x",), ("a..b",)], "p string")
    assert [r.ok for r in df.select(archive.is_safe_path(F.col("p")).alias("ok")).collect()] == [True, False, False, False, True]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("AndroidManifest.xml", "x")
        z.writestr("a/../../evil", "x")
    with pytest.raises(Exception, match="unsafe"):
        archive.members(archive.archives(spark, str(tmp_path / "bad.zip"))).collect()


def test_name_map(spark):
    df = spark.createDataFrame([(json.dumps(["Foo", "a", "Bar", "b", "Foo", "c"]),)], "value string")
    assert sorted(map(tuple, documents.name_map(df).collect())) == [("Bar", "b"), ("Foo", "a")]
    with pytest.raises(Exception, match="odd"):
        documents.name_map(spark.createDataFrame([('["a"]',)], "value string")).collect()


def test_publish(spark, tmp_path):
    target, df = str(tmp_path / "out"), spark.range(3)
    assert documents.publish(df, target) is None and spark.read.parquet(target).count() == 3
    with pytest.raises(FileExistsError):
        documents.publish(df, target)
    backup = documents.publish(spark.range(5), target, replace=True)
    assert spark.read.parquet(target).count() == 5 and spark.read.parquet(backup).count() == 3
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    with pytest.raises(FileExistsError):
        documents.publish(df, str(foreign), replace=True)


def test_jsonl_and_unique_documents(spark, tmp_path):
    documents.write_jsonl([spark.createDataFrame([("w", "a")], "kind string, text string"), spark.createDataFrame([("u", 4)], "kind string, at long")], str(tmp_path / "j"))
    assert {(r.kind, r.text, r.at) for r in spark.read.json(str(tmp_path / "j")).collect()} == {("w", "a", None), ("u", None, 4)}
    with pytest.raises(Exception, match="twice"):
        documents.unique_documents(spark.createDataFrame([("p", 1), ("p", 2)], "path string, v long"), "path").collect()


def test_read_ir(spark, tmp_path):
    (tmp_path / "ir.json").write_text(json.dumps({"functions": [{"name": "f", "address": "0x1", "size": 4, "instructions": [{"mnemonic": "ret"}], "control_flow": [{"from": "0x1", "to": "0x2", "kind": "j"}]}]}))
    row = documents.read_ir(spark, str(tmp_path / "ir.json")).first()
    assert (row.name, row.size, row.instructions[0].mnemonic, row.control_flow[0]["to"]) == ("f", 4, "ret", "0x2")


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "click", '{"k": 2}'), (2, "2024-01-01 00:20:00", 1, "click", '{"k": 3}'), (2, "2024-01-01 00:20:00", 1, "click", '{"k": 3}')], "event_id long, ts string, user_id long, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, props string").parquet(str(tmp_path / "in"))
    stream = trace_stream.windowed_hits(source)
    query = stream.writeStream.outputMode("complete").format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[1:] for r in spark.table("hits").collect()] == [(1, "click", 8, 3)]
    query = trace_stream.deduplicated(source).writeStream.outputMode("append").format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.event_id for r in spark.table("once").collect()) == [1, 2]


def test_oracle_documents(spark, tmp_path):
    from factweave.sources import oracle

    metadata = {"dart_version": '3.4 on "linux_arm64"', "dart_commit": "abcdef0123", "snapshot_hash": "h", "root_library": 1, "word_size": 8, "compressed_word_size": 8, "analyzer_version": 5}
    objects = [
        {"id": 1, "type": "Library", "url": "package:app/main.dart", "imports": [2, 2, 99]}, {"id": 2, "type": "Library", "url": "dart:core"}, {"id": 3, "type": "Class", "name": "A", "user_visible_name": "Aa", "library": 1}, {"id": 4, "type": "Class", "name": "::", "library": 1},
        {"id": 10, "type": "Function", "name": "m", "raw_name": "m@1", "owner_class": 3, "code": 20, "kind": "getter", "parent_function": 11, "result_type": 30, "parameters": [{"name": "this", "type": 30, "is_implicit": True}, {"name": "x", "type": 31}, {"name": "y", "type": 98}]},
        {"id": 11, "type": "Function", "name": "main", "owner_class": 4, "code": 21}, {"id": 12, "type": "Function", "name": "lost", "code": 23},
        {"id": 20, "type": "Code", "offset": 64, "size": 16, "section": oracle.ISOLATE}, {"id": 21, "type": "Code", "offset": 8, "size": 4, "section": "_kDartVmSnapshotInstructions"}, {"id": 22, "type": "Code", "offset": 96, "size": 4, "section": oracle.ISOLATE, "owner": 11},
        {"id": 23, "type": "Code", "offset": -1, "size": 4, "section": oracle.ISOLATE, "is_stub": True, "name": "no place"}, {"id": 24, "type": "Code", "offset": 128, "size": 4, "section": oracle.ISOLATE, "is_stub": True, "name": "AllocateStub"},
        {"id": 30, "type": "Type", "name": "int ?"}, {"id": 31, "type": "Type", "user_visible_name": "List < int >"}, {"type": "Odd"}, {"id": 40},
    ]
    calls = {"targets": [{"pool_index": 1, "owner_name": "new"}, {"pool_index": 2, "owner_name": "kept?"}, {"pool_index": 3, "owner_name": ""}]}
    (tmp_path / "o.json").write_text(json.dumps({"metadata": metadata, "objects": objects, "static_calls": calls}))
    document = oracle.read_document(spark, str(tmp_path / "o.json"), "h", "arm64-v8a")
    found = oracle.objects(document)
    assert {r.uri: (r.package, r.output_path, r.imports) for r in oracle.libraries(found).collect()} == {"package:app/main.dart": ("app", "packages/app/main.dart", ["dart:core"]), "dart:core": (None, "dart/core.dart", [])}
    got = {r.name: r for r in oracle.functions(found).collect()}
    assert (got["m"].owner, got["m"].library_uri, got["m"].parent_name, got["m"].code_offset, got["m"].code_link, got["m"].parameter_types, got["m"].return_type) == ("Aa", "package:app/main.dart", "main", 64, "function.code", ["List<int>", None], "int")
    assert (got["main"].owner, got["main"].code_offset, got["main"].code_link, got["main"].parameter_types) == (None, 96, "code.owner", [])
    assert (got["lost"].code_offset, got["lost"].code_size, got["lost"].library_uri) == (None, 4, None)
    assert [tuple(r) for r in oracle.stubs(found).collect()] == [(128, "AllocateStub")]
    labels = spark.createDataFrame([(2, "old")], "pool_index long, label string")
    assert sorted(map(tuple, oracle.pool_labels(document, labels).collect())) == [(1, "new"), (2, "old")]
    assert {r.type: r.n for r in oracle.kinds(found).collect()} == {"Library": 2, "Class": 2, "Function": 3, "Code": 5, "Type": 2, "Odd": 1, "Unknown": 1}
    for change, abi, compressed in (({"analyzer_version": 1}, "arm64-v8a", False), ({"snapshot_hash": "x"}, "arm64-v8a", False), ({"dart_commit": "zz"}, "arm64-v8a", False), ({}, "armeabi-v7a", False), ({}, "x86_64", False), ({}, "arm64-v8a", True)):
        (tmp_path / "o.json").write_text(json.dumps({"metadata": metadata | change, "objects": []}))
        with pytest.raises(Exception, match="differs|older|revision"):
            oracle.read_document(spark, str(tmp_path / "o.json"), "h", abi, compressed).collect()


def test_listings(spark, tmp_path):
    from factweave.sources import sinks

    schema = "place long, name string, owner string, address string, size long, instructions array<struct<address:string,bytes:string,mnemonic:string,operands:string,object_pool_index:long,object_pool_value:string>>, control_flow array<struct<`from`:string,`to`:string,kind:string>>"
    one = [("0x1", "aabb", "mov", "x0, x1", None, None), ("0x5", "cc", "ldr", "x2", 7, "str")]
    rows = [(2, "b", "O", "0x9", 4, [], []), (1, "a", None, "0x1", 8, one, [("0x1", "0x5", "Jump")]), (3, "alias", "O", "0x1", 8, one, [])]
    df = spark.createDataFrame(rows, schema)
    want = ["\n# top_level.a at 0x1 (8 bytes)\n0x1  " + "aabb".ljust(18) + " " + "mov".ljust(8) + " x0, x1\n0x5  " + "cc".ljust(18) + " " + "ldr".ljust(8) + " x2  # pool[7] = str\n# CFG: 0x1->0x5/Jump", "\n# O.b at 0x9 (4 bytes)"]
    assert [r.text for r in sinks.assembly(df).orderBy("place").collect()] == want
    sinks.write_assembly(df, str(tmp_path / "asm"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "asm").glob("part-*")))
    assert text == "\n".join(want) + "\n"
    index = sinks.function_index(df).where("name = 'a'").first()
    assert (index.offset, index.inlined_function_count, index.owner, index.kind) == (1, 0, None, None)


def test_assets(spark, tmp_path):
    import hashlib

    from factweave.sources import sinks

    schema = "path string, declared_size long, content binary"
    good = spark.createDataFrame([("a/b.txt", 3, bytearray(b"abc")), ("c.bin", 0, bytearray(b""))], schema)
    assert sorted(map(tuple, sinks.copy_assets(good, str(tmp_path / "out")).collect())) == [("a/b.txt", 3, hashlib.sha256(b"abc").hexdigest()), ("c.bin", 0, hashlib.sha256(b"").hexdigest())]
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"abc"
    for rows in ([("x", 4, bytearray(b"abc"))], [("../x", 3, bytearray(b"abc"))], [("x", 1, bytearray(b"a")), ("x", 1, bytearray(b"b"))]):
        with pytest.raises(Exception, match="declared|unsafe|twice"):
            sinks.copy_assets(spark.createDataFrame(rows, schema), str(tmp_path / "bad")).collect()


def test_manifest_binding_and_summaries(spark, tmp_path):
    from factweave.sources import sinks

    target = str(tmp_path / "m.json")
    coverage = spark.createDataFrame([(3, 2)], "functions long, ranges long")
    warnings = spark.createDataFrame([("W", "x\u202ey")], "code string, message string")
    sinks.manifest(spark, target, "m/v1", {"abi": "arm64"}, coverage, warnings)
    text = (tmp_path / "m.json").read_text()
    assert json.loads(text) == {"schema": "m/v1", "abi": "arm64", "coverage": {"functions": 3, "ranges": 2}, "warnings": [{"code": "W", "message": "x\u202ey"}]} and "\\u202e" in text
    with pytest.raises(FileExistsError):
        sinks.manifest(spark, target, "m/v1", {}, coverage)
    with pytest.raises(ValueError):
        sinks.manifest(spark, str(tmp_path / "n.json"), "m/v1", {}, coverage.union(coverage))
    facts = {"dart_commit": "abc", "target_arch": "arm64", "word_size": 8, "compressed_word_size": 4, "analyzer_version": 5}
    bound = sinks.binding(spark, b"doc", b"exe", {"sha256": "s"}, facts, str(tmp_path / "b.json"))
    assert json.loads((tmp_path / "b.json").read_text()) == bound and bound["document"]["size"] == 3
    sinks.verify_binding(bound, b"doc", {"sha256": "s"})
    for document, subject in ((b"dok", {"sha256": "s"}), (b"doc", {"sha256": "t"})):
        with pytest.raises(ValueError):
            sinks.verify_binding(bound, document, subject)
    with pytest.raises(FileExistsError):
        sinks.binding(spark, b"doc", b"exe", {}, facts, str(tmp_path / "b.json"))
    sinks.binding(spark, b"new", b"exe", {}, facts, str(tmp_path / "b.json"), replace=True)
    with pytest.raises(ValueError):
        sinks.binding(spark, b"doc", b"exe", {}, facts | {"dart_commit": None}, str(tmp_path / "c.json"))
    assert sinks.summary(coverage) == "functions  ranges\n3          2" and json.loads(sinks.summary(coverage, as_json=True)) == {"functions": 3, "ranges": 2}
    assert sinks.readme("T", {"functions": 1200}, ["Note."]) == "# T\n\n- functions: 1,200\n\nNote.\n"


def test_deferred_units(spark):
    from factweave.sources import sinks

    symbol = lambda name, info, section, value: struct.pack("<IBBHQQ", name, info, 0, section, value, 8)
    strings = b"\0_kDartSnapshotData\0main\0"
    symbols = symbol(0, 0, 0, 0) + symbol(1, 1, 1, 64) + symbol(20, 2, 1, 128) + symbol(20, 2, 0, 128)
    data = elf64([(".text", 4096, b"x" * 12), (".symtab", 0, symbols), (".strtab", 0, strings), (".note.gnu.build-id", 0, b"\0" * 16 + b"\xab\xcd")])
    row = sinks.deferred_units(spark.createDataFrame([("u", bytearray(data))], "path string, content binary")).first()
    assert (row.size, row.build_id, row.text_symbols, row.snapshot_symbols, row.instruction_section_bytes) == (len(data), "abcd", 1, ["_kDartSnapshotData"], 12)


def test_payloads_regions_and_symbol_files(spark, tmp_path):
    import hashlib

    found = spark.createDataFrame([("a.apk", "base")], "path string, module string")
    files = spark.createDataFrame([("a.apk",), ("b.apk",)], "path string")
    assert archive.required_payloads(found, files.limit(1)).count() == 1
    with pytest.raises(Exception, match="without a payload"):
        archive.required_payloads(found, files).collect()
    symbol = struct.pack("<IBBHQQ", 1, 1, 0, 1, 4100, 6) + struct.pack("<IBBHQQ", 1, 1, 0, 1, 9000, 6)
    data = elf64([(".rodata", 4096, b"0123456789abcdef"), (".symtab", 0, symbol), (".strtab", 0, b"\0_kData\0"), (".note.gnu.build-id", 0, b"\0" * 16 + b"\xab\xcd")])
    listed = spark.createDataFrame([("p", "m", bytearray(data))], "path string, member string, content binary")
    assert [tuple(r) for r in archive.named_regions(listed, ["_kData"]).collect()] == [("p", "m", "_kData", 4100, 6, hashlib.sha256(b"456789").hexdigest())]
    assert archive.named_regions(listed, ["other"]).count() == 0
    images = spark.createDataFrame([("z.so", bytearray(data)), ("b.so", bytearray(data)), ("a.txt", bytearray(b"text")), ("c.so", bytearray(data[:70]))], "path string, content binary")
    assert archive.symbol_file(images, "arm64-v8a", "abcd") == "b.so"
    for abi, build in (("x86_64", "abcd"), ("arm64-v8a", "ffff")):
        with pytest.raises(ValueError):
            archive.symbol_file(images, abi, build)


def test_name_maps_from_files(spark, tmp_path, monkeypatch):
    (tmp_path / "m.json").write_text('["a", "x", "b", "y", "a", "z"]')
    assert sorted(map(tuple, documents.read_name_map(spark, str(tmp_path / "m.json")).collect())) == [("a", "x"), ("b", "y")]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError, match="no pair"):
        documents.read_name_map(spark, str(tmp_path / "e.json"))
    monkeypatch.setattr(documents, "MOST_MAP_BYTES", 5)
    with pytest.raises(ValueError, match="more than"):
        documents.read_name_map(spark, str(tmp_path / "m.json"))
