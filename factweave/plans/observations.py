"""Consensus of observations from several partitions, by key alignment and order-insensitive fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_opaque_identity
from ..operators.aggregates import consensus
from ..operators.ordered import consecutive_dedup


def multiset(values: Column) -> Column:
    """A digest in which order does not count and multiplicity does; null for no values."""
    text = F.array_join(F.array_sort(F.transform(values, lambda v: v.cast("string"))), "\x1f")
    return F.when(F.size(values) > 0, F.sha2(text.cast("binary"), 256))


def with_lexical_index(functions: DataFrame, order: list[str]) -> DataFrame:
    """Occurrence numbers within (library, owner, member); names that repeat carry their partition and never align."""
    keys = ["abi", "library_uri", "owner", "member"]
    w = Window.partitionBy(*keys)
    n = F.row_number().over(w.orderBy(*order)) - 1
    return functions.withColumn("lexical_index", n.cast("long")).withColumn("ambiguous_abi", F.when(F.count("*").over(w) > 1, F.col("abi")))


def reach_consensus(observations: DataFrame, partitions: int) -> DataFrame:
    """One row for each aligned identity with its state and tier; empty evidence corroborates nothing."""
    keys = ["library_uri", "owner", "member", "lexical_index", "parent_lexical", "ambiguous_abi"]
    parts = observations.select(*keys, "abi", *[multiset(F.col(c)).alias(c) for c in ("constants", "callees", "pool_identities")])
    has = F.col("constants").isNotNull() | F.col("callees").isNotNull() | F.col("pool_identities").isNotNull()
    filled = parts.select(*keys, "abi", *[F.coalesce(c, F.lit("")).alias(c) for c in ("constants", "callees", "pool_identities")], has.alias("evidence"))
    state = consensus(filled, keys, "abi", ["constants", "callees", "pool_identities"], partitions)
    backed = filled.groupBy(*keys).agg(F.bool_and("evidence").alias("backed"))
    on = F.lit(True)
    for k in keys:
        on = on & state[k].eqNullSafe(backed[k])
    joined = state.join(backed, on).select(*[state[k] for k in keys], "present", "state", "tier", "backed")
    return joined.withColumn("tier", F.when(F.col("backed"), F.col("tier")).otherwise("inferred")).withColumn("state", F.when(~F.col("backed") & (F.col("state") == "corroborated"), "unsupported").otherwise(F.col("state")))


def named_identities(values: Column) -> Column:
    """Identities that another build can share: those that are more than an address or a reference."""
    return F.filter(values, lambda v: v.isNotNull() & ~is_opaque_identity(v))


def call_sequence(calls: DataFrame, keys: list[str], order: list[str], callee: str) -> DataFrame:
    """Callees of each key in order, repeats in a row dropped."""
    return consecutive_dedup(calls, keys, order, callee).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(callee).alias("c")))), lambda x: x["c"]).alias("callees"))
