"""JSON documents with declared schemas, and sinks that publish whole results or none."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import first_rows
from ..schema import IR_DOCUMENT, TRACE


def read_ir(spark: SparkSession, path: str) -> DataFrame:
    """Functions of an intermediate document, one row each; anything that is not of the schema fails the read."""
    return spark.read.schema(IR_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("functions").alias("f")).select("f.*")


def read_trace(spark: SparkSession, path: str, accepted: str, snapshot: str | None = None) -> DataFrame:
    from ..plans.trace import gate

    return gate(spark.read.schema(TRACE).option("multiLine", True).option("mode", "FAILFAST").json(path), accepted, snapshot)


#: Bytes of a name map that is read.
MOST_MAP_BYTES = 256 << 20


def read_name_map(spark: SparkSession, path: str) -> DataFrame:
    """raw -> restored of a file up to MOST_MAP_BYTES; a larger one, and one without a pair, fails."""
    size = spark.read.format("binaryFile").load(path).select("length").agg(F.max("length")).first()[0] or 0
    if size > MOST_MAP_BYTES:
        raise ValueError(f"name map has {size} bytes, more than {MOST_MAP_BYTES}")
    found = name_map(spark.read.option("wholetext", True).text(path))
    if found.isEmpty():
        raise ValueError("name map holds no pair")
    return found


def name_map(lines: DataFrame, column: str = "value") -> DataFrame:
    """raw -> restored from a flat JSON array of alternating names; the first mapping of a name wins, an odd length fails."""
    flat = lines.select(F.monotonically_increasing_id().alias("doc"), F.from_json(column, "array<string>").alias("a"))
    even = flat.withColumn("a", F.when(F.size("a") % 2 == 0, F.col("a")).otherwise(F.raise_error(F.lit("a name map has an odd length")).cast("array<string>")))
    chunks = even.where(F.size("a") > 0).select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("CAST(size(a) div 2 AS INT) - 1")), lambda i: F.struct(F.get("a", 2 * i).alias("raw"), F.get("a", 2 * i + 1).alias("restored")))).alias("place", "p"))
    return first_rows(chunks.select("doc", "place", "p.*"), ["raw"], ["doc", "place"]).select("raw", "restored")


def publish(df: DataFrame, target: str, replace: bool = False, marker: str = "_manifest") -> str | None:
    """Writes beside the target and renames, so readers see all or nothing. An existing target is refused unless `replace`
    and it holds the marker of an earlier publication; the old one is kept under a time-stamped name, which is returned."""
    spark = df.sparkSession
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path) and not (replace and fs.exists(jvm.org.apache.hadoop.fs.Path(target, marker))):
        raise FileExistsError(target)
    staging = jvm.org.apache.hadoop.fs.Path(f"{target}.staging-{time.time_ns()}")
    df.write.mode("errorifexists").parquet(staging.toString())
    fs.create(jvm.org.apache.hadoop.fs.Path(staging, marker)).close()
    backup = None
    if fs.exists(path):
        backup = f"{target}.backup-{int(time.time())}"
        fs.rename(path, jvm.org.apache.hadoop.fs.Path(backup))
    if not fs.rename(staging, path):
        raise OSError(f"cannot publish {target}")
    return backup


def write_jsonl(records: list[DataFrame], target: str) -> None:
    """Records of several kinds, missing columns null, one JSON object a line."""
    out = records[0]
    for more in records[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    out.write.mode("errorifexists").json(target)


def document_set(relations: dict[str, DataFrame], target: str) -> None:
    """One Parquet table for each relation under the target."""
    for name, df in relations.items():
        df.write.mode("errorifexists").parquet(f"{target}/{name}")


def unique_documents(df: DataFrame, path: str) -> DataFrame:
    """df, failing at run time if two rows have one path."""
    counts = df.groupBy(path).agg(F.count("*").alias("_n"))
    checked = counts.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("path given twice: "), F.col(path))).cast("boolean")).otherwise(F.lit(True)))
    return df.join(checked.drop("_n"), path)
