"""Fingerprint matching of two function tables, as one plan without driver steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hex_parse, prefix_any
from ..operators.joins import unique_rows

#: Libraries of the framework, names that say nothing, constants that no build changes.
FRAMEWORK = ["dart:", "package:flutter/", "package:flutter_test/"]
SYNTHETIC, CLOSURE = "sub_", "<anonymous closure>"
STABLE = r"(?s)^(\".*|true|false|null|Type\(.*|Class\(.*)\z"


def body_fingerprint() -> Column:
    """Size, kind, mnemonics, statements, rank-normalised flow and stable constants; null below four instructions or without a size."""
    mnemonics = F.transform(F.filter("instructions", lambda i: i["mnemonic"].isNotNull()), lambda i: F.regexp_replace(i["mnemonic"], "(eq|ne)$", ""))
    statements = F.filter(F.transform("semantic_statements", lambda s: s["kind"]), lambda k: k.isNotNull())
    named = F.array_distinct(F.filter(F.flatten(F.transform("control_flow", lambda e: F.array(e["from"], e["to"]))), lambda a: a.isNotNull()))
    ranked = F.transform(F.array_sort(F.transform(named, lambda a: F.struct(F.coalesce(hex_parse(a), F.lit("18446744073709551615").cast("decimal(20,0)")).alias("at"), a.alias("name")))), lambda x: x["name"])
    whole = F.filter("control_flow", lambda e: e["from"].isNotNull() & e["to"].isNotNull() & e["kind"].isNotNull())
    flow = F.array_sort(F.transform(whole, lambda e: F.concat((F.array_position(ranked, e["from"]) - 1).cast("string"), F.lit(">"), (F.array_position(ranked, e["to"]) - 1).cast("string"), F.lit(":"), e["kind"])))
    constants = F.array_sort(F.array_distinct(F.filter(F.transform("instructions", lambda i: i["object_pool_value"]), lambda v: v.isNotNull() & v.rlike(STABLE))))
    empty = F.array().cast("array<string>")
    parts = [F.col("size").cast("string"), F.coalesce("kind", F.lit("?")), *(F.array_join(F.coalesce(a, empty), ",") for a in (mnemonics, statements, flow)), F.array_join(F.coalesce(constants, empty), "|")]
    return F.when((F.size("instructions") >= 4) & F.col("size").isNotNull(), F.sha2(F.concat_ws(";", *parts).cast("binary"), 256))


def match(target: DataFrame, reference: DataFrame) -> DataFrame:
    """target_address, target_name and the reference identity of bodies that are unique on both sides.

    A name that survives in the target and differs rejects the match. Where proposals for one address disagree, all go.
    """
    columns = ["address", "name", "owner", "library_uri"]
    t = target.select(*columns, body_fingerprint().alias("fp")).where("fp IS NOT NULL")
    r = reference.where(prefix_any("library_uri", FRAMEWORK)).select(*columns, body_fingerprint().alias("fp")).where("fp IS NOT NULL")
    left = unique_rows(t, ["fp"], ["address", "name"]).select("fp", F.col("address").alias("target_address"), F.coalesce("name", F.lit("<unnamed>")).alias("target_name"))
    right = unique_rows(r, ["fp"], columns[1:]).select("fp", F.coalesce("name", F.lit("<unnamed>")).alias("reference_name"), F.col("owner").alias("reference_owner"), F.coalesce("library_uri", F.lit("")).alias("reference_library"))
    met = left.join(right, "fp").where((F.col("reference_name") != "") & ~F.col("reference_name").startswith(SYNTHETIC) & (F.col("reference_name") != CLOSURE))
    met = met.where(F.col("target_name").startswith(SYNTHETIC) | (F.col("target_name") == F.col("reference_name")))
    identity = F.struct(F.coalesce("reference_owner", F.lit("\0")), "reference_name", "reference_library")
    agreed = met.groupBy("target_address").agg(F.min("target_name").alias("target_name"), F.min("reference_name").alias("reference_name"), F.min("reference_owner").alias("reference_owner"), F.min("reference_library").alias("reference_library"), F.count_distinct(identity).alias("identities"))
    return agreed.where("identities = 1").drop("identities").withColumn("tier", F.lit("corroborated"))


def match_report(target: DataFrame, reference: DataFrame) -> DataFrame:
    """One row of counts: functions, framework functions, unique and ambiguous fingerprints, rejected names."""
    t, r = (df.select("name", "library_uri", body_fingerprint().alias("fp")) for df in (target, reference))
    framework = r.where(prefix_any("library_uri", FRAMEWORK))
    by = t.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("nt"), F.min("name").alias("t_name"))
    other = framework.where("fp IS NOT NULL").groupBy("fp").agg(F.count("*").alias("nr"), F.min("name").alias("r_name"))
    both = by.join(other, "fp", "full")
    usable = (F.col("nt") == 1) & (F.col("nr") == 1) & ~F.col("r_name").startswith(SYNTHETIC)
    return both.agg(
        F.coalesce(F.sum("nt"), F.lit(0)).alias("target_bodies"),
        F.coalesce(F.sum("nr"), F.lit(0)).alias("framework_bodies"),
        F.count_if(F.col("nt") == 1).alias("unique_target"),
        F.count_if(F.col("nr") == 1).alias("unique_reference"),
        F.count_if(F.col("nr").isNotNull() & ((F.col("nr") != 1) | (F.col("nt") > 1))).alias("ambiguous"),
        F.count_if(usable & ~F.col("t_name").startswith(SYNTHETIC) & (F.col("t_name") != F.col("r_name"))).alias("contradictory_names"),
    )


def toolchain_conflicts(target: DataFrame, reference: DataFrame, fields: tuple[str, ...] = ("snapshot_hash", "dart_commit", "target_arch")) -> DataFrame:
    """Fields of two one-row documents that are present in both and differ."""
    facts = [df.agg(*[F.when(F.count("*") == 1, F.min(f)).otherwise(F.raise_error(F.lit("one document is one row"))).alias(f"{side}_{f}") for f in fields]) for side, df in (("t", target), ("r", reference))]
    pair = facts[0].join(F.broadcast(facts[1]))  # an aggregate is one row
    return pair.select(F.array_compact(F.array(*[F.when(F.col(f"t_{f}") != F.col(f"r_{f}"), F.lit(f)) for f in fields])).alias("conflicts"))
