"""Overlays, promotions, layouts, solved signatures and histograms over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates, joins, ordered, resolve
from .registry import Tables, query


@query("""SELECT 'flag' AS histogram, l_returnflag AS value, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2
 UNION ALL SELECT 'returned_line', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2""")
def coverage_histograms(t: Tables) -> DataFrame:
    """Several histograms in one pass; what a condition leaves out is null."""
    line = F.col("l_linenumber")
    return aggregates.histograms(t.lineitem, {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus"), "line": line, "returned_line": F.when(F.col("l_returnflag") == "R", line)})


@query("""SELECT c_nationkey AS nationkey, min(c_name) AS name FROM customer WHERE c_nationkey < 20 GROUP BY 1 UNION ALL SELECT s_nationkey, min(s_name) FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey < 20) GROUP BY 1""")
def overlay_missing(t: Tables) -> DataFrame:
    """Suppliers name the nations that customers do not name: what is known already stays."""
    known = t.customer.where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.min("c_name").alias("name"))
    return joins.overlay_missing(known, t.supplier.select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name")), "nationkey", "name")


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'sub_' || format('{:x}', o_custkey + 4096) END AS target FROM orders),
 s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'NullErrorStub' ELSE 'Allocate' || c_custkey END AS name FROM customer WHERE c_custkey % 2 = 0)
 SELECT c.id, CASE WHEN c.id % 3 <> 0 AND s.name IS NOT NULL THEN s.name ELSE c.target END AS target FROM c LEFT JOIN s ON c.k = s.k WHERE NOT (c.id % 3 <> 0 AND coalesce(s.name = 'NullErrorStub', false))""")
def relabel_stubs(t: Tables) -> DataFrame:
    """Calls of unnamed code take the stub's name at their offset; those that only throw for null go."""
    unnamed = F.concat(F.lit("sub_"), F.lower(F.hex(F.col("o_custkey") + 4096)))
    calls = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(unnamed).alias("target"))
    names = F.when(F.col("c_custkey") % 10 == 0, "NullErrorStub").otherwise(F.concat(F.lit("Allocate"), F.col("c_custkey").cast("string")))
    return joins.relabel_stubs(calls, t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("offset"), names.alias("name")), 4096)


@query("""WITH r AS (SELECT l_orderkey AS caller, l_linenumber AS address, arg_max('P' || l_partkey, l_extendedprice * 1000000 + l_partkey) AS target FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
 h AS (SELECT 'P' || p_partkey AS target, CASE WHEN p_partkey % 3 = 0 THEN 'package:app/' || p_size WHEN p_partkey % 3 = 1 THEN 'dart:core' END AS library_uri FROM part)
 SELECT c.caller, c.address, r.target, h.library_uri, CASE WHEN r.target IS NULL THEN NULL WHEN starts_with(h.library_uri, 'package:app/') THEN 'application' WHEN h.library_uri = 'dart:core' THEN 'dart_sdk' ELSE 'unknown' END AS scope
 FROM (SELECT DISTINCT l_orderkey AS caller, l_linenumber AS address FROM lineitem) c LEFT JOIN r ON c.caller = r.caller AND c.address = r.address LEFT JOIN h ON r.target = h.target""")
def promote_indirect(t: Tables) -> DataFrame:
    """Call sites with the target that was recovered last for their address, its library and scope."""
    li = t.lineitem.select(F.col("l_orderkey").alias("caller"), F.col("l_linenumber").alias("address"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target"), (F.col("l_extendedprice") * 1000000 + F.col("l_partkey")).alias("place"), "l_returnflag")
    dispatch = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("dispatch "), "target")).otherwise(F.col("target"))
    key = F.col("p_partkey")
    uri = F.when(key % 3 == 0, F.concat(F.lit("package:app/"), F.col("p_size").cast("string"))).when(key % 3 == 1, "dart:core")
    homes = t.part.select(F.concat(F.lit("P"), key.cast("string")).alias("target"), uri.alias("library_uri"))
    return joins.promote_indirect(li.select("caller", "address").distinct(), li.withColumn("target", dispatch), homes, lambda u, x: X.target_scope(u, "app", x))


@query("""WITH f AS (SELECT p_brand AS b, p_type AS y, p_size AS o, CASE WHEN count(*) = 1 THEN min(p_name) END AS name, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2, 3)
 SELECT p_partkey, name AS field FROM part LEFT JOIN f ON p_brand = b AND p_type = y AND p_size = o AND n = 1""")
def field_layout(t: Tables) -> DataFrame:
    """Slots with the one field that lies at their class, library and offset."""
    place = [F.col("p_brand").alias("class_name"), F.col("p_type").alias("library_uri"), F.col("p_size").alias("offset")]
    fields = t.part.where("p_partkey % 2 = 0").select(*place, F.col("p_name").alias("field"), F.lit(None).cast("string").alias("field_type"))
    return joins.field_layout(t.part.select("p_partkey", *place), fields).select("p_partkey", "field")


@query("""WITH c AS (SELECT l_partkey AS k, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS n, CASE WHEN l_returnflag <> 'N' THEN least(l_linenumber, 2) END AS p FROM lineitem),
 s AS (SELECT k, array_to_string(list_sort(list_distinct(list(n) FILTER (WHERE n IS NOT NULL))), '|') AS counts, min(p) AS positional_at_most, max(n) AS capacity_at_least, CASE WHEN bool_and(n IS NOT NULL) THEN true WHEN bool_and(n IS NULL) THEN false END AS needs, count(*) AS calls FROM c GROUP BY 1),
 a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN 'vm_oracle' ELSE 'retained_runtime_signature' END AS authority, CAST(CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS BIGINT) AS fixed FROM part WHERE p_partkey % 3 = 0)
 SELECT coalesce(s.k, a.k) AS part, authority, fixed, coalesce(counts, '') AS counts, CAST(positional_at_most AS BIGINT) AS positional_at_most, CAST(capacity_at_least AS BIGINT) AS capacity_at_least, needs, CAST(calls AS BIGINT) AS calls, CASE WHEN authority IS NOT NULL THEN 'proven' ELSE 'inferred' END AS tier FROM s FULL JOIN a ON s.k = a.k""")
def solve_signatures(t: Tables) -> DataFrame:
    """Signatures settled by the stronger authority, else bounded by calls."""
    line, seen = F.col("l_linenumber").cast("long"), F.col("l_returnflag") != "N"
    calls = t.lineitem.select(F.col("l_partkey").alias("part"), F.when(seen, line).alias("count"), F.when(seen, F.least(line, F.lit(2).cast("long"))).alias("positional"), F.lit(None).cast("long").alias("type_args"), F.lit(None).cast("array<string>").alias("named"))
    p = t.part.select(F.col("p_partkey").alias("part"), F.col("p_size").cast("long").alias("size"))
    known = p.where("part % 3 = 0").select("part", F.lit("retained_runtime_signature").alias("authority"), F.col("size").alias("fixed")).union(p.where("part % 6 = 0").select("part", F.lit("vm_oracle"), F.col("size") + 1))
    solved = aggregates.solve_signatures(calls, known, "part")
    return solved.select("part", "authority", "fixed", F.coalesce(F.array_join("counts", "|"), F.lit("")).alias("counts"), "positional_at_most", "capacity_at_least", "needs", "calls", "tier")


@query("""SELECT l_partkey, l_suppkey, array_to_string(list_sort(list_distinct(list(l_orderkey))), '|') AS members, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) > 1""")
def peer_classes(t: Tables) -> DataFrame:
    return aggregates.peer_classes(t.lineitem, ["l_partkey", "l_suppkey"], "l_orderkey").select("l_partkey", "l_suppkey", F.array_join("members", "|").alias("members"), "n")


@query()
def consuming_pair(t: Tables) -> DataFrame:
    """Orders that consume others of their customer, by status where they can; the taking is sequential, so tests hold it and not SQL."""
    o = t.orders.select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("kind"))
    return resolve.consuming_pair(o.where("orderkey % 2 = 0"), o.where("orderkey % 2 = 1"), "custkey", "orderkey", "kind")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS BIGINT) AS place FROM lineitem""")
def place_in_group(t: Tables) -> DataFrame:
    """Places within three hot keys, each of which may take many ranges."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return ordered.place_in_group(t.lineitem.select("l_returnflag", *order), ["l_returnflag"], order, "place").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))
