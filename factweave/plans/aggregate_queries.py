"""Roll-ups, elections, ordered analytics and graphs over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates, graph, ordered
from .registry import Tables, query


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_returnflag DESC, l_linestatus, l_shipdate, l_discount, l_tax) = 1 AS f FROM lineitem)
 SELECT CAST(count(*) AS BIGINT) AS logical_rows, CAST(count_if(f) AS BIGINT) AS physical_rows, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS returned, CAST(count_if(l_returnflag = 'R' AND f) AS BIGINT) AS returned_physical,
 CAST(count_if(l_quantity > 40) AS BIGINT) AS large, CAST(count_if(l_quantity > 40 AND f) AS BIGINT) AS large_physical FROM m""")
def coverage_rollup(t: Tables) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", -F.ascii("l_returnflag"), "l_linestatus", "l_shipdate", "l_discount", "l_tax"]
    return aggregates.coverage(t.lineitem, ["l_partkey", "l_suppkey"], order, {"returned": F.col("l_returnflag") == "R", "large": F.col("l_quantity") > 40})


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY lang) AS best FROM c)
 SELECT lang, CAST(n AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(source) END AS source FROM m WHERE n = best GROUP BY 1, 2""")
def elect_or_null(t: Tables) -> DataFrame:
    return aggregates.elect_or_null(t.documents, ["lang"], "source")


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS fingerprint FROM lineitem GROUP BY 1""")
def multiset_fingerprint(t: Tables) -> DataFrame:
    return aggregates.multiset_fingerprint(t.lineitem, ["l_orderkey"], "l_partkey")


@query("""SELECT l_partkey, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), '|' ORDER BY CAST(l_linenumber AS VARCHAR)) AS supplied, CAST(min(l_linenumber) AS BIGINT) AS least, CAST(max(l_linenumber) AS BIGINT) AS most,
 CASE WHEN bool_and(l_returnflag = 'R') THEN true WHEN NOT bool_or(l_returnflag = 'R') THEN false END AS needs, CAST(count(*) AS BIGINT) AS calls FROM lineitem GROUP BY 1""")
def constraint_solve(t: Tables) -> DataFrame:
    return aggregates.constraint_solve(t.lineitem, ["l_partkey"], "l_linenumber", F.col("l_returnflag") == "R")


@query("SELECT o_custkey, min(o_orderkey) AS primary_key, CASE WHEN count(*) > 1 THEN substr(string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey), length(CAST(min(o_orderkey) AS VARCHAR)) + 2) ELSE '' END AS alternatives FROM orders GROUP BY 1")
def primary_alternatives(t: Tables) -> DataFrame:
    keys = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderkey")).alias("k"))
    return keys.select("o_custkey", F.get("k", F.lit(0)).alias("primary_key"), F.array_join(F.slice("k", 2, F.greatest(F.size("k") - 1, F.lit(0))), "|").alias("alternatives"))


@query("""WITH d AS (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem) SELECT a.l_partkey, a.l_suppkey, a.l_orderkey, string_agg(CAST(b.l_orderkey AS VARCHAR), '|' ORDER BY b.l_orderkey) AS peers
 FROM d a JOIN d b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey GROUP BY 1, 2, 3""")
def group_peers(t: Tables) -> DataFrame:
    return aggregates.group_peers(t.lineitem, ["l_partkey", "l_suppkey"], "l_orderkey")


@query("""SELECT DISTINCT c_nationkey AS source_nation, s_nationkey AS target_nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def edge_rollup(t: Tables) -> DataFrame:
    """Orders carry their nation to the lines; lines are reduced to pairs of nation and supplier before anything else is joined."""
    orders = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("c_nationkey", "l_suppkey").distinct()
    edges = pairs.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return edges.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("source_nation"), F.col("s_nationkey").alias("target_nation")).distinct()


@query("""SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || CAST(n AS VARCHAR) END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def collision_suffix(t: Tables) -> DataFrame:
    return ordered.collision_suffix(t.part.select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("""SELECT conv_id, CASE WHEN count(*) >= 4 THEN sha256(string_agg(role || ':' || CAST(r AS VARCHAR), ',' ORDER BY turn, r, role)) END AS fingerprint FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) GROUP BY 1""")
def body_fingerprint(t: Tables) -> DataFrame:
    """Ordered roles with rank-normalised turns; null below four turns. The ranks come from the sorted set of turns, without a window."""
    c = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("body"), F.array_sort(F.collect_set("turn")).alias("turns"))
    parts = F.transform("body", lambda x: F.concat(x["role"], F.lit(":"), F.array_position("turns", x["turn"]).cast("string")))
    return c.select("conv_id", F.when(F.size("body") >= 4, F.sha2(F.array_join(parts, ",").cast("binary"), 256)).alias("fingerprint"))


_TIER = "CASE l_returnflag WHEN 'R' THEN 'inferred' WHEN 'A' THEN 'cross_abi_corroborated' ELSE 'proven' END"


def _tiers(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(flag == "R", "inferred").when(flag == "A", "cross_abi_corroborated").otherwise("proven").alias("tier"))


@query(f"SELECT l_orderkey, CASE min(CASE {_TIER} WHEN 'inferred' THEN 1 WHEN 'cross_abi_corroborated' THEN 2 ELSE 3 END) WHEN 1 THEN 'inferred' WHEN 2 THEN 'cross_abi_corroborated' ELSE 'proven' END AS tier FROM lineitem GROUP BY 1")
def tier_merge(t: Tables) -> DataFrame:
    return aggregates.tier_merge(_tiers(t), ["l_orderkey"], "tier")


@query(f"SELECT {_TIER} AS tier, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE {_TIER} IN ('cross_abi_corroborated', 'proven') GROUP BY 1")
def tier_floor(t: Tables) -> DataFrame:
    return _tiers(t).where(aggregates.at_least("tier", "cross_abi_corroborated")).groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT b, bool_and(((p_partkey >> b) & 1) = p_partkey % 2) AS fits FROM part, (SELECT unnest(range(0, 13)) AS b) GROUP BY 1) SELECT CAST(CASE WHEN count_if(fits) = 1 THEN min(CASE WHEN fits THEN b END) END AS BIGINT) AS bit, CAST(count_if(fits) AS BIGINT) AS candidates FROM b""")
def calibrate_bit(t: Tables) -> DataFrame:
    return aggregates.calibrate_bit(t.part, "p_partkey", F.col("p_partkey") % 2, 0, 13)


@query("SELECT o_orderkey, CAST(o_orderkey & 31 AS BIGINT) AS kind, CAST((o_orderkey >> 5) & 1 AS BIGINT) AS flag, CAST(o_orderkey >> 6 AS BIGINT) AS rest FROM orders")
def bitfield_decode(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", k.bitwiseAND(31).cast("long").alias("kind"), F.getbit(k, F.lit(5)).cast("long").alias("flag"), F.shiftright(k, 6).alias("rest"))


@query("""WITH l AS (SELECT o_orderkey, o_orderstatus, CASE WHEN lag(o_orderkey) OVER w IS NULL OR lag(o_orderstatus) OVER w IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END AS new FROM orders WINDOW w AS (ORDER BY o_orderkey)), r AS (SELECT *, sum(new) OVER (ORDER BY o_orderkey) AS run FROM l)
 SELECT min(o_orderkey) AS start, CAST(count(*) AS BIGINT) AS length, min(o_orderstatus) AS o_orderstatus FROM r GROUP BY run""")
def rle_runs(t: Tables) -> DataFrame:
    return ordered.rle_runs(t.orders, ["o_orderkey"], "o_orderstatus")


@query("SELECT l_orderkey, CAST(coalesce(lead(l_orderkey) OVER (ORDER BY l_orderkey) - l_orderkey, 1) AS BIGINT) AS size FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def size_from_lead(t: Tables) -> DataFrame:
    return ordered.size_from_next(t.lineitem, "l_orderkey")


@query("""WITH h AS (SELECT page_id, regexp_extract(lower(url), '^https?://([^/]+)', 1) AS path, starts_with(url, 'https') AS own FROM pages) SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY own DESC, page_id) = 1 THEN path ELSE path || '.' || substr(sha256(CAST(page_id AS VARCHAR)), 1, 10) END AS unique_path FROM h""")
def unique_paths(t: Tables) -> DataFrame:
    h = t.pages.select("page_id", F.regexp_extract(F.lower("url"), "^https?://([^/]+)", 1).alias("path"), F.col("url").startswith("https").alias("own"))
    return ordered.unique_paths(h, "path", "page_id", F.col("own")).select("page_id", "unique_path")


@query("SELECT doc_id, digest FROM (SELECT min(doc_id) AS doc_id, sha256(text) AS digest, text FROM documents GROUP BY text ORDER BY text LIMIT 100)")
def dedup_limit(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id")).orderBy("text").limit(100).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 20")
def distinct_topn(t: Tables) -> DataFrame:
    return t.part.select("p_name").distinct().orderBy("p_name").limit(20)


@query("SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem")
def dedup_key(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").dropDuplicates()


@query("""SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_discount, l_tax) AS n FROM lineitem) WHERE n = 1""")
def dedup_first(t: Tables) -> DataFrame:
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    first = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.min(order).alias("f"))
    return first.select("l_partkey", "l_suppkey", "f.l_orderkey", "f.l_linenumber", "f.l_extendedprice")


@query("SELECT n_name, s_name, CAST(row_number() OVER (ORDER BY n_name NULLS FIRST, s_acctbal NULLS FIRST, s_suppkey) AS BIGINT) AS place FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def total_sort(t: Tables) -> DataFrame:
    """A place in the total order, by ranges of the order itself."""
    rows = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", "s_name", "s_acctbal", "s_suppkey")
    return ordered.global_place(rows, [F.asc_nulls_first("n_name"), F.asc_nulls_first("s_acctbal"), F.asc_nulls_first("s_suppkey")], "place").select("n_name", "s_name", "place")


@query("SELECT lang, doc_id, CAST(place AS BIGINT) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 3")
def sample_per_group(t: Tables) -> DataFrame:
    return ordered.sample_per_group(t.documents.select("lang", "doc_id"), ["lang"], ["doc_id"], 3).select("lang", "doc_id", F.col("place").cast("long").alias("place"))


@query("""WITH r AS (SELECT l_suppkey, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag = 'R')) AS r, list_distinct(list(l_partkey) FILTER (WHERE l_returnflag = 'A')) AS a FROM lineitem GROUP BY 1)
 SELECT l_suppkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(r, []), coalesce(a, [])))), '|') AS parts FROM r""")
def array_union_sorted(t: Tables) -> DataFrame:
    pairs = t.lineitem.where(F.col("l_returnflag").isin("R", "A")).select("l_suppkey", "l_partkey").distinct()  # equal pairs go before the lists are made
    lists = pairs.groupBy("l_suppkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("all"))
    return t.lineitem.select("l_suppkey").distinct().join(lists, "l_suppkey", "left").select("l_suppkey", F.coalesce(F.array_join("all", "|"), F.lit("")).alias("parts"))


@query("""SELECT l_linestatus, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, max(l_extendedprice) AS most FROM lineitem GROUP BY 1""")
def per_partition_scan(t: Tables) -> DataFrame:
    """One scan with the partition as a column instead of one scan for each."""
    return t.lineitem.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"), F.max("l_extendedprice").alias("most"))


@query("""WITH s AS (SELECT min(l_partkey) AS p FROM lineitem), d1 AS (SELECT DISTINCT l_suppkey FROM lineitem, s WHERE l_partkey = s.p), d2 AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM d1) AND l_partkey <> (SELECT p FROM s))
 SELECT p AS node, 0 AS depth FROM s UNION ALL SELECT -1 - l_suppkey, 1 FROM d1 UNION ALL SELECT l_partkey, 2 FROM d2""")
def bounded_bfs(t: Tables) -> DataFrame:
    pairs = t.lineitem.select(F.col("l_partkey").alias("p"), (-1 - F.col("l_suppkey")).alias("s")).distinct()
    edges = pairs.select(F.col("p").alias("src"), F.col("s").alias("dst")).union(pairs.select("s", "p"))
    return graph.bounded_bfs(edges, t.lineitem.agg(F.min("l_partkey").alias("node")), 2)


@query("""SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS doc FROM conversations GROUP BY 1""")
def doc_per_group(t: Tables) -> DataFrame:
    c = t.conversations.select("conv_id", "turn", "role", "text", F.concat("role", F.lit(": "), "text").alias("line"))
    return ordered.ordered_list(c, ["conv_id"], ["turn", "role", "text"], "line", "\n", "doc")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS a, n_nationkey // 2 AS b FROM nation WHERE n_nationkey <> n_nationkey // 2), n AS (SELECT a AS x FROM e UNION SELECT b FROM e),
 r AS (SELECT x AS src, x AS dst FROM n UNION SELECT r.src, e.b FROM r JOIN e ON r.dst = e.a) SELECT CAST(dst AS BIGINT) AS super, CAST(count(*) AS BIGINT) AS members FROM r GROUP BY 1""")
def transitive_closure(t: Tables) -> DataFrame:
    edges = t.nation.select(F.col("n_nationkey").cast("long").alias("src"), F.expr("n_nationkey div 2").alias("dst"))
    return graph.transitive_closure(edges).groupBy(F.col("dst").alias("super")).agg(F.count("*").alias("members"))


@query("""WITH RECURSIVE r AS (SELECT k, k % 3 AS label FROM (SELECT unnest(range(1, 8)) AS k) UNION ALL SELECT c.k, r.label FROM r JOIN (SELECT c_custkey AS k, c_custkey // 2 AS p FROM customer WHERE c_custkey >= 8) c ON c.p = r.k)
 SELECT CAST(k AS BIGINT) AS node, CAST(label AS BIGINT) AS label FROM r""")
def label_propagation(t: Tables) -> DataFrame:
    edges = t.customer.select(F.expr("c_custkey div 2").alias("caller"), F.col("c_custkey").alias("callee")).where("caller > 0")
    seeds = t.spark.range(1, 8).select(F.col("id").alias("node"), (F.col("id") % 3).alias("label"))
    return graph.label_propagation(edges, seeds)


@query("SELECT l_partkey, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS sources FROM lineitem GROUP BY 1")
def reverse_edges(t: Tables) -> DataFrame:
    return graph.reverse_edges(t.lineitem, "l_orderkey", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("sources"))


@query("""SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def relabel_candidates(t: Tables) -> DataFrame:
    """Distinct candidate targets of a selector."""
    c = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("p"))
    return c.select("l_orderkey", F.size("p").cast("long").alias("n"), F.array_join("p", "|").alias("parts"))


@query("""SELECT a.l_orderkey, a.l_suppkey, b.n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT l_orderkey, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1) b ON a.l_orderkey = b.l_orderkey""")
def shared_bodies(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_orderkey", "l_suppkey").distinct()
    return pairs.join(pairs.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1"), "l_orderkey")


