"""Object documents of a snapshot analyser: one id space, joined with itself by reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.joins import overlay_missing

MOST_BYTES = 2 << 30
#: The region whose code counts, word sizes and architectures by machine.
ISOLATE = "_kDartIsolateSnapshotInstructions"
WORDS = {"armeabi-v7a": (4, "arm"), "arm64-v8a": (8, "arm64"), "x86_64": (8, "x64")}
_PARAMETER = "array<struct<name:string,type:bigint,is_implicit:boolean>>"
OBJECT = (
    "id bigint, type string, url string, name string, raw_name string, user_visible_name string, scrubbed_name string, kind string, library bigint, imports array<bigint>, owner_class bigint, type_class bigint, "
    f"result_type bigint, parameters {_PARAMETER}, code bigint, current_code bigint, code_link_source string, parent_function bigint, owner bigint, offset bigint, size bigint, section string, is_stub boolean"
)
METADATA = "dart_version string, dart_commit string, snapshot_hash string, root_library bigint, word_size bigint, compressed_word_size bigint, analyzer_version bigint"
DOCUMENT = (
    f"metadata struct<{METADATA.replace(' bigint', ':bigint').replace(' string', ':string').replace(', ', ',')}>, objects array<struct<{', '.join(x.replace(' ', ':', 1) for x in OBJECT.split(', '))}>>, "
    "static_calls struct<targets:array<struct<pool_index:bigint,owner_name:string>>>, dispatch_metadata struct<targets:array<struct<selector_index:bigint,owner_name:string>>>"
)


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("boolean")


def checked(documents: DataFrame, snapshot_hash: str, abi: str, compressed: bool) -> DataFrame:
    """Documents of the snapshot and machine asked for; any other fails the read with what is wrong about it."""
    m, (word, arch) = F.col("metadata"), WORDS[abi]
    version = F.coalesce(m["analyzer_version"], F.lit(0))
    named = F.regexp_extract(F.coalesce(m["dart_version"], F.lit("")), r'_(arm64|arm|x64|ia32|riscv64)"', 1)
    rules = [
        (version < 2, "analyser schema is older than 2"),
        (~m["snapshot_hash"].eqNullSafe(F.lit(snapshot_hash)), "snapshot hash differs"),
        ((version >= 4) & ~F.coalesce(m["dart_commit"].rlike("^[0-9a-fA-F]{10,}$"), F.lit(False)), "commit is no revision"),
        (~m["word_size"].eqNullSafe(F.lit(word).cast("long")), "word size differs"),
        ((named != "") & (named != arch), "architecture differs"),
        (~m["compressed_word_size"].eqNullSafe(F.lit(4 if compressed else word).cast("long")), "compressed word size differs"),
    ]
    verdict = F.lit(True)
    for broken, message in reversed(rules):
        verdict = F.when(broken, _fail(message)).otherwise(verdict)
    return documents.where(verdict)


def read_document(spark: SparkSession, path: str, snapshot_hash: str, abi: str, compressed: bool = False) -> DataFrame:
    """A document up to MOST_BYTES as one row, checked."""
    sizes = spark.read.format("binaryFile").load(path).select("length").agg(F.max("length")).first()[0] or 0
    if sizes > MOST_BYTES:
        raise ValueError(f"document has {sizes} bytes, more than {MOST_BYTES}")
    return checked(spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path), snapshot_hash, abi, compressed)


def objects(document: DataFrame) -> DataFrame:
    return document.select(F.explode("objects").alias("o")).select("o.*")


def _of(found: DataFrame, kind: str) -> DataFrame:
    return found.where((F.col("type") == kind) & F.col("id").isNotNull())


def libraries(found: DataFrame) -> DataFrame:
    """id, uri, package, output_path, imports (addresses in order) of libraries with an address."""
    own = _of(found, "Library").where("url IS NOT NULL").select("id", F.col("url").alias("uri"), "imports")
    known = own.select(F.col("id").alias("import"), F.col("uri").alias("import_uri"))
    met = own.select("id", F.explode("imports").alias("import")).join(known, "import").groupBy("id").agg(F.array_sort(F.collect_set("import_uri")).alias("imports"))
    joined = own.drop("imports").join(met, "id", "left")
    return joined.select("id", "uri", X.package_of("uri").alias("package"), X.output_path("uri").alias("output_path"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def classes(found: DataFrame) -> DataFrame:
    """id, name (null for top-level ones) and library_uri of classes."""
    name = F.coalesce("user_visible_name", "scrubbed_name", "name")
    own = _of(found, "Class").select("id", F.when(~name.isin("::", "top_level"), name).alias("name"), "library")
    homes = libraries(found).select(F.col("id").alias("library"), F.col("uri").alias("library_uri"))
    return own.join(homes, "library", "left").select("id", "name", "library_uri")


def functions(found: DataFrame) -> DataFrame:
    """Functions with owner, library, parent, types, and the isolate code that they name or, else, the first that names them as its owner."""
    code = _of(found, "Code").where(F.col("section") == ISOLATE).select("id", F.when(F.col("offset") >= 0, F.col("offset")).alias("code_offset"), F.col("size").alias("code_size"), "owner")
    owning = code.where("owner IS NOT NULL").groupBy(F.col("owner").alias("object_id")).agg(F.min("id").alias("owner_code"))
    direct = code.select(F.col("id").alias("code"), F.col("id").alias("direct_code"))
    homes = classes(found).select(F.col("id").alias("owner_class"), F.col("name").alias("owner"), "library_uri")
    own = _of(found, "Function").select(F.col("id").alias("object_id"), F.coalesce("name", F.lit("")).alias("name"), "raw_name", "user_visible_name", "kind", "owner_class", "code", "code_link_source", "parent_function", "result_type", "parameters")
    joined = own.join(homes, "owner_class", "left").join(direct, "code", "left").join(owning, "object_id", "left")
    joined = joined.withColumn("code_object_id", F.coalesce("direct_code", "owner_code"))
    places = code.select(F.col("id").alias("code_object_id"), "code_offset", "code_size")
    parents = own.select(F.col("object_id").alias("parent_function"), F.coalesce("user_visible_name", F.nullif("name", F.lit("")), "raw_name").alias("parent_name"))
    joined = joined.join(places, "code_object_id", "left").join(parents, "parent_function", "left")
    link = F.when((F.col("code_link_source") == "code_owner") | (F.col("direct_code").isNull() & F.col("owner_code").isNotNull()), "code.owner").when(F.col("direct_code").isNotNull(), "function.code")
    typed = _with_types(joined.withColumn("code_link", link), found)
    return typed.select("object_id", "name", "raw_name", "user_visible_name", "kind", "owner", "library_uri", "parent_name", "code_object_id", "code_offset", "code_size", "code_link", "parameter_types", "return_type")


def _with_types(functions_: DataFrame, found: DataFrame) -> DataFrame:
    """parameter_types of explicit parameters in order, null where a type is unknown, and return_type; without spaces and trailing question marks."""
    names = _of(found, "Type").select(F.col("id").alias("type"), X.canonical_type(F.coalesce("user_visible_name", "scrubbed_name", "name")).alias("type_name"))
    placed = functions_.select("object_id", F.posexplode(F.filter("parameters", lambda p: ~F.coalesce(p["is_implicit"], F.lit(False)))).alias("place", "p")).select("object_id", "place", F.col("p.type").alias("type"))
    lists = placed.join(names, "type", "left").groupBy("object_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type_name"))), lambda x: x["type_name"]).alias("parameter_types"))
    results = names.select(F.col("type").alias("result_type"), F.col("type_name").alias("return_type"))
    empty = F.array().cast("array<string>")
    return functions_.join(lists, "object_id", "left").withColumn("parameter_types", F.coalesce("parameter_types", empty)).join(results, "result_type", "left")


def stubs(found: DataFrame) -> DataFrame:
    """offset, name of isolate code that is a stub, by the analyser's own flag; the least name of an offset."""
    own = _of(found, "Code").where(F.coalesce("is_stub", F.lit(False)) & (F.col("section") == ISOLATE) & (F.col("offset") >= 0))
    return own.groupBy("offset").agg(F.min(F.coalesce("user_visible_name", "name")).alias("name"))


def pool_labels(document: DataFrame, labels: DataFrame) -> DataFrame:
    """pool_index, label: what is known already, and the owners that static calls add."""
    calls = document.select(F.explode("static_calls.targets").alias("t")).select(F.col("t.pool_index").alias("pool_index"), F.col("t.owner_name").alias("label"))
    return overlay_missing(labels, calls, "pool_index", "label")


def kinds(found: DataFrame) -> DataFrame:
    """type, n: how many objects of each type there are."""
    return found.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))
