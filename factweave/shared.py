"""Tables written to the folder that the driver and all executors share.

What must survive lost executors is written as Parquet and read again: the plan behind it is cut, and what is read back has
a known size, so Spark's own threshold decides whether a join may broadcast it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, one beside the warehouse if all executors see that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        own_disk = ":" not in warehouse.split("/", 1)[0] or warehouse.startswith("file:")
        if own_disk and not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = warehouse.rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factweave-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a written table, once nothing reads it any more."""
    spark = table.sparkSession
    for path in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
