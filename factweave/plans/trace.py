"""Runtime traces: a gate on the schema, then grouped roll-ups. All facts are inferred and carry their observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import first_rows


def gate(trace: DataFrame, accepted: str, snapshot: str | None = None) -> DataFrame:
    """The trace as it is, unless it names another schema or another snapshot: then reading it fails."""
    wrong = F.concat(F.lit("unsupported trace schema "), F.coalesce("schema", F.lit("none")))
    out = trace.where(F.when(F.col("schema").eqNullSafe(F.lit(accepted)), True).otherwise(F.raise_error(wrong).cast("boolean")))  # a filter is never pruned
    if snapshot is not None:
        out = out.where(F.when(F.col("snapshot_hash").eqNullSafe(F.lit(snapshot)), True).otherwise(F.raise_error(F.lit("trace of another snapshot")).cast("boolean")))
    return out


def _events(trace: DataFrame, column: str) -> DataFrame:
    return trace.select(F.explode(column).alias("e")).select("e.*")


def hot_bodies(trace: DataFrame) -> DataFrame:
    return _events(trace, "executed_pcs").groupBy("body_entry_offset").agg(F.sum("hit_count").alias("hits"))


def arity(trace: DataFrame) -> DataFrame:
    return _events(trace, "argument_descriptors").groupBy("callee_offset").agg(F.max("positional_count").alias("positional"), F.sum("hit_count").alias("observations"), F.lit("inferred").alias("tier"))


def shapes(trace: DataFrame) -> DataFrame:
    e = _events(trace, "argument_descriptors").withColumn("named", F.coalesce("named_names", F.array().cast("array<string>")))
    return e.groupBy("callee_offset", "positional_count", "named").agg(F.sum("hit_count").alias("observations"))


def receivers(trace: DataFrame) -> DataFrame:
    return _events(trace, "receiver_cids").groupBy("call_site_pc_offset", "class_id").agg(F.sum("hit_count").alias("observations"))


def dominant_targets(trace: DataFrame) -> DataFrame:
    """The target with most hits of each selector, ties to the smaller one, beside all of its targets in order."""
    totals = _events(trace, "dispatch_targets").groupBy("selector_index", "target_offset").agg(F.sum("hit_count").alias("hits"))
    best = first_rows(totals, ["selector_index"], [F.desc("hits"), "target_offset"])
    every = totals.groupBy("selector_index").agg(F.array_sort(F.collect_set("target_offset")).alias("targets"))
    return best.join(every, "selector_index")
