"""Bodies, the occurrences bound to them, and what is said about both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..shared import written
from .joins import range_relation


def body_bindings(static: DataFrame, oracle: DataFrame) -> DataFrame:
    """body, source, object, relation, static_size, oracle_size, conflict of every binding.

    static: body (offset), object, size; oracle: object, offset, size (null if unknown). Static occurrences are exact. An oracle
    occurrence binds where a body starts at its offset; sizes that differ are kept beside the relation. Bodies of one offset
    keep their first size by object.
    """
    own = static.select(F.col("body"), F.lit("static").alias("source"), "object", F.lit("exact").alias("relation"), F.col("size").alias("static_size"), F.lit(None).cast("long").alias("oracle_size"))
    bodies = static.groupBy("body").agg(F.min_by("size", "object").alias("static_size"))
    met = oracle.where(F.col("offset").isNotNull()).join(bodies, F.col("offset") == F.col("body"))
    start, end = F.col("body"), F.col("body") + F.col("static_size")
    relation = range_relation(start, end, start, F.col("body") + F.col("size"))
    bound = met.select("body", F.lit("oracle").alias("source"), "object", relation.alias("relation"), "static_size", F.col("size").alias("oracle_size"))
    conflict = F.coalesce(F.col("static_size") != F.col("oracle_size"), F.lit(False))
    return own.unionByName(bound).dropDuplicates(["body", "source", "object"]).withColumn("conflict", conflict)


def binding_report(bindings: DataFrame, oracle: DataFrame) -> DataFrame:
    """One row: bodies, occurrences, bindings, oracle occurrences with code that nothing binds exactly, shared bodies, conflicts, disjoint bindings."""
    placed = oracle.where(F.col("offset").isNotNull()).select("object").distinct()
    exact = bindings.where("source = 'oracle' AND relation = 'exact'").select("object").distinct()
    unbound = placed.join(exact, "object", "left_anti").agg(F.count("*").alias("unbound_oracle"))
    occurrences = bindings.where("source = 'static'").select("object").distinct().agg(F.count("*").alias("s")).join(F.broadcast(placed.agg(F.count("*").alias("o"))))  # one row each
    by_body = bindings.groupBy("body").agg(F.count("*").alias("n"), F.count_if("conflict").alias("c"), F.count_if(F.col("relation") == "disjoint").alias("d"))
    counts = by_body.agg(F.count("*").alias("bodies"), F.coalesce(F.sum("n"), F.lit(0)).alias("bindings"), F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.sum("c"), F.lit(0)).alias("conflicts"), F.coalesce(F.sum("d"), F.lit(0)).alias("disjoint"))
    joined = counts.join(F.broadcast(occurrences)).join(F.broadcast(unbound))  # one row each
    return joined.select("bodies", (F.col("s") + F.col("o")).alias("occurrences"), "bindings", "unbound_oracle", "shared", "conflicts", "disjoint")


def alias_labels(df: DataFrame, key: str, label: str, library: str, priority: Column) -> DataFrame:
    """key, label, library of keys whose rows name one label only; its library is the one of highest priority that is known, the least at a tie."""
    known = F.when(F.col(library).isNotNull(), F.struct(priority.alias("p"), F.col(library).alias("l")))
    best = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.max(known["p"]).alias("_p"), F.collect_set(known).alias("_all"))
    libraries = F.array_min(F.transform(F.filter("_all", lambda x: x["p"] == F.col("_p")), lambda x: x["l"]))
    return best.select(key, label, libraries.alias(library)).groupBy(key).agg(F.count("*").alias("_n"), F.min(label).alias(label), F.min(library).alias(library)).where("_n = 1").drop("_n")


def proven_selectors(df: DataFrame, key: str, target: str) -> DataFrame:
    """key and the member name that all its distinct targets share, if there are two targets or more and the name says something."""
    distinct = df.select(key, target).distinct()
    members = distinct.groupBy(key).agg(F.count("*").alias("n"), F.min(X.last_segment(target)).alias("low"), F.max(X.last_segment(target)).alias("high"))
    named = (F.col("n") > 1) & (F.col("low") == F.col("high")) & (F.col("low") != "") & ~F.col("low").rlike("^(sub_|_iso_stub_)")
    return members.where(named).select(key, F.col("low").alias("selector"))


def control_flow_fingerprint(branches: Column, returns: Column, direct: Column, indirect: Column, targets: Column) -> Column:
    """Four counts and the distinct names of resolved targets in order."""
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(targets, lambda t: t.isNotNull()))), ",")
    return F.concat_ws(";", *[F.coalesce(c, F.lit(0)).cast("string") for c in (branches, returns, direct, indirect)], names)


#: Kinds whose references are values and not metadata.
CONTAINERS = ["instance", "array", "weak_array", "record", "context"]


def nested_strings(roots: DataFrame, nodes: DataFrame, depth: int = 4, most_nodes: int = 96, most_strings: int = 16) -> DataFrame:
    """root and the distinct texts within `depth` container references, at most most_strings of the first most_nodes nodes of each root.

    roots: root; nodes: node, kind, text, refs. Nodes count in the order of depth, then of the references that lead to them; only
    containers lead on. All roots go on together, a level at a time. Texts with control characters are none.
    """
    known = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.array(F.lit(0)).alias("way")).distinct(), "nested")
    edges = written(nodes.where(F.col("kind").isin(CONTAINERS) & F.col("text").isNull()).select(F.col("node").alias("src"), F.posexplode("refs").alias("place", "dst")).where("dst >= 0"), "references")
    fresh = known
    for level in range(1, depth + 1):
        reached = fresh.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), F.concat("way", F.array("place")).alias("way"))
        first = reached.groupBy("root", "node").agg(F.min("way").alias("way"))
        fresh = first.join(known.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("depth"), "way")
        ranked = known.select("root", "node", "depth", "way").union(fresh).groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct("depth", "way", "node"))), 1, most_nodes).alias("all"))
        merged = written(ranked.select("root", F.explode("all").alias("x")).select("root", "x.node", "x.depth", "x.way"), "nested")
        known, fresh = merged, merged.where(F.col("depth") == level)
        if fresh.isEmpty():
            break
    texts = nodes.where(F.col("text").isNotNull() & (F.col("text") != "") & ~F.col("text").rlike(r"\p{Cc}")).select("node", X.abbreviate("text").alias("text"))
    found = known.join(texts, "node").groupBy("root", "text").agg(F.min(F.struct("depth", "way")).alias("at"))
    lists = found.groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "text"))), 1, most_strings).alias("all"))
    return lists.select("root", F.array_sort(F.transform("all", lambda x: x["text"])).alias("texts"))
