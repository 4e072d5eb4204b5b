"""Tables written to the folder that the driver and all executors share.

Stages that must survive lost executors are written as Parquet and read again: the plan behind them is cut, and
what is read back has a known size, so Spark's own threshold decides whether a join may broadcast it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import drop, shared_dir

__all__ = ["clear", "drop", "free_name", "fresh_path", "shared_dir", "small_batches", "stage"]

#: Bytes of the Arrow batches that small_batches() asks for.
BATCH_BYTES = 4 << 20


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/factweave/{label}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_BYTES, or less if it is set so. Every row comes, in order.

    A batch is held several times: as Arrow on both sides, in the buffer between them, and once more for what comes back. Spark's
    64 MB for it, in each task at once, are more than all tables of a worker. The limit is read when a table runs, so it is not put back.
    """
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def clear(spark: SparkSession) -> None:
    """Delete everything that this subpackage has written to the shared folder. For the end of a job: results that still read it are lost."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factweave")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
