"""Roll-ups of event tables: gates, hot keys, dominant keys, shapes; and what orders events within a user."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import joins, ordered
from .registry import Tables, query

_H = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


def hits(events: DataFrame) -> DataFrame:
    """events with h, the whole number k of the properties, or null."""
    return events.withColumn("h", F.get_json_object("props", "$.k").try_cast("bigint"))


@query(f"SELECT CAST(count({_H}) AS BIGINT) AS valid, CAST(count(*) - count({_H}) AS BIGINT) AS invalid FROM events")
def trace_gate(t: Tables) -> DataFrame:
    return hits(t.events).agg(F.count("h").alias("valid"), F.count_if(F.col("h").isNull()).alias("invalid"))


@query(f"SELECT user_id, CAST(sum({_H}) AS BIGINT) AS hits FROM events GROUP BY user_id")
def trace_hot_keys(t: Tables) -> DataFrame:
    return hits(t.events).groupBy("user_id").agg(F.sum("h").alias("hits"))


@query(f"""SELECT event_type, user_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY hits DESC, user_id) AS n
 FROM (SELECT event_type, user_id, CAST(sum({_H}) AS BIGINT) AS hits FROM events GROUP BY 1, 2)) WHERE n = 1""")
def trace_dominant(t: Tables) -> DataFrame:
    totals = hits(t.events).groupBy("event_type", "user_id").agg(F.sum("h").alias("hits"))
    return ordered.first_rows(totals, ["event_type"], [F.desc("hits"), "user_id"])


@query(f"SELECT user_id, CAST(max({_H}) AS BIGINT) AS most, CAST(sum({_H}) AS BIGINT) AS hits FROM events GROUP BY user_id")
def trace_arity(t: Tables) -> DataFrame:
    return hits(t.events).groupBy("user_id").agg(F.max("h").alias("most"), F.sum("h").alias("hits"))


@query(f"SELECT user_id, event_type, CAST({_H} % 3 AS BIGINT) AS shape, CAST(sum({_H}) AS BIGINT) AS hits FROM events GROUP BY 1, 2, 3")
def trace_shapes(t: Tables) -> DataFrame:
    return hits(t.events).groupBy("user_id", "event_type", (F.col("h") % 3).alias("shape")).agg(F.sum("h").alias("hits"))


@query(f"SELECT event_type, user_id, CAST(sum({_H}) AS BIGINT) AS hits, CAST(count(*) AS BIGINT) AS events FROM events GROUP BY 1, 2")
def trace_receivers(t: Tables) -> DataFrame:
    return hits(t.events).groupBy("event_type", "user_id").agg(F.sum("h").alias("hits"), F.count("*").alias("events"))


@query("""WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'),
 e AS (SELECT event_id, user_id, ts, (SELECT max(struct_pack(ts := c.ts, id := c.event_id)) FROM c WHERE c.user_id = events.user_id AND (c.ts < events.ts OR (c.ts = events.ts AND c.event_id < events.event_id))) AS m FROM events WHERE event_type = 'error')
 SELECT event_id, user_id, m.id AS click_id FROM e WHERE m IS NOT NULL AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND (p.ts > m.ts OR (p.ts = m.ts AND p.event_id > m.id)) AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id)))""")
def asof_excluding(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct("ts", "event_id")
    e = t.events.select("event_id", "user_id", "ts", "event_type").where(F.col("event_type").isin("click", "purchase", "error"))
    e = e.withColumn("click", F.last(F.when(F.col("event_type") == "click", place), ignorenulls=True).over(w)).withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", place), ignorenulls=True).over(w))
    kept = (F.col("event_type") == "error") & F.col("click").isNotNull() & (F.col("purchase").isNull() | (F.col("purchase") < F.col("click")))
    return e.where(kept).select("event_id", "user_id", F.col("click.event_id").alias("click_id"))


@query("""SELECT e.user_id, min(e.ts) AS first_ts, max(e.ts) AS last_ts, CAST(count(*) AS BIGINT) AS n FROM events e
 JOIN (SELECT user_id, min(ts) AS s FROM events WHERE event_type = 'signup' GROUP BY 1) s ON e.user_id = s.user_id WHERE e.ts >= s.s AND e.ts < s.s + INTERVAL 1 DAY GROUP BY 1""")
def span_bounds(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts", "event_type")
    signup = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("s"))
    inside = e.join(signup, "user_id").where((F.col("ts") >= F.col("s")) & (F.col("ts") < F.col("s") + F.expr("INTERVAL 1 DAY")))
    return inside.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT event_id, user_id, ts, props FROM events WHERE event_type = 'signup')
 SELECT v.event_id, coalesce((SELECT min(s.event_id) FROM s WHERE s.user_id = v.user_id AND s.props = v.props),
  (SELECT max(struct_pack(ts := s.ts, id := s.event_id)).id FROM s WHERE s.user_id = v.user_id AND (s.ts < v.ts OR (s.ts = v.ts AND s.event_id < v.event_id)))) AS parent_id
 FROM events v WHERE v.event_type = 'view'""")
def name_then_span(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", "event_type", "props")
    named = e.where("event_type = 'signup'").groupBy("user_id", "props").agg(F.min("event_id").alias("by_name"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spanned = e.where(F.col("event_type").isin("signup", "view")).withColumn("by_span", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w)).where("event_type = 'view'")
    return spanned.join(named, ["user_id", "props"], "left").select("event_id", F.coalesce("by_name", "by_span").alias("parent_id"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM events GROUP BY 1""")
def kind_histogram(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""SELECT user_id, string_agg(event_type, '|' ORDER BY ts, event_id) AS types FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1 GROUP BY 1""")
def ordered_distinct_list(t: Tables) -> DataFrame:
    first = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("place"))
    return ordered.ordered_list(first, ["user_id"], ["place"], "event_type", "|", "types")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS occurrence FROM events")
def occurrence_index(t: Tables) -> DataFrame:
    return ordered.occurrence_index(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "occurrence")


@query(f"SELECT event_id, CAST(sum({_H}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS running FROM events")
def running_offset(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits(t.events).select("event_id", F.sum("h").over(w).alias("running"))


@query("""SELECT event_id, CASE WHEN lag(event_type, 1) OVER w = 'click' THEN lag(event_id, 1) OVER w WHEN lag(event_type, 2) OVER w = 'click' THEN lag(event_id, 2) OVER w END AS nearest
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lookback_two(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    return ordered.lookback(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", "event_id", 2).select("event_id", "nearest")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type""")
def consecutive_dedup(t: Tables) -> DataFrame:
    return ordered.consecutive_dedup(t.events.select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("""SELECT raw, restored FROM (SELECT event_type || i AS raw, CAST(user_id + i AS BIGINT) AS restored, row_number() OVER (PARTITION BY event_type || i ORDER BY ts, event_id) AS n FROM (SELECT *, unnest(range(0, event_id % 3 + 1)) AS i FROM events WHERE event_id % 7 <> 0)) WHERE n = 1""")
def pairs_from_array(t: Tables) -> DataFrame:
    """Flat arrays of alternating key and value are paired by place; arrays of odd length are none; the first pair of a key wins."""
    items = F.sequence(F.lit(0), (2 * (F.col("event_id") % 3) + 1).cast("int"))
    flat = F.transform(items, lambda i: F.when(i % 2 == 0, F.concat("event_type", F.floor(i / 2).cast("string"))).otherwise((F.col("user_id") + F.floor(i / 2)).cast("string")))
    odd = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("left over"))).otherwise(F.array().cast("array<string>"))
    e = t.events.select("ts", "event_id", F.concat(flat, odd).alias("flat")).where(F.size("flat") % 2 == 0)
    pairs = e.select("ts", "event_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("CAST(size(flat) div 2 AS INT) - 1")), lambda i: F.struct(F.get("flat", 2 * i).alias("raw"), F.get("flat", 2 * i + 1).alias("restored")))).alias("pair", "p"))
    first = pairs.groupBy(F.col("p.raw").alias("raw")).agg(F.min_by("p.restored", F.struct("ts", "event_id", "pair")).alias("restored"))
    return first.select("raw", F.col("restored").cast("long").alias("restored"))


@query(f"""SELECT event_id, 'warning' AS record, '{{"user":' || CAST(user_id AS VARCHAR) || ',"hits":' || CAST({_H} AS VARCHAR) || '}}' AS payload FROM events WHERE event_type = 'error'""")
def unresolved_jsonl(t: Tables) -> DataFrame:
    e = hits(t.events.where("event_type = 'error'"))
    return e.select("event_id", F.lit("warning").alias("record"), F.to_json(F.struct(F.col("user_id").alias("user"), F.col("h").alias("hits"))).alias("payload"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'direct' WHEN 'view' THEN 'direct' WHEN 'purchase' THEN 'virtual' WHEN 'error' THEN 'runtime' ELSE 'closure' END AS dispatch,
 CASE WHEN event_type IN ('click', 'view') THEN user_id END AS target, CASE WHEN event_type = 'error' THEN 'helper' END AS helper FROM events""")
def call_edges(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    dispatch = F.when(kind.isin("click", "view"), "direct").when(kind == "purchase", "virtual").when(kind == "error", "runtime").otherwise("closure")
    return t.events.select("event_id", dispatch.alias("dispatch"), F.when(dispatch == "direct", F.col("user_id")).alias("target"), F.when(kind == "error", "helper").alias("helper"))


@query("""WITH i AS (SELECT CAST(dayofyear(o_orderdate) AS BIGINT) AS s, count(*) AS n FROM orders GROUP BY 1)
 SELECT e.event_id, CAST(sum(i.n) AS BIGINT) AS open_orders FROM (SELECT event_id, CAST(dayofyear(ts) AS BIGINT) AS d FROM events) e JOIN i ON e.d >= i.s AND e.d < i.s + 7 GROUP BY 1""")
def range_join(t: Tables) -> DataFrame:
    """Events with the number of orders that are open on their day. Equal intervals are counted before the join, equal days join once."""
    intervals = t.orders.groupBy(F.dayofyear("o_orderdate").cast("long").alias("s")).agg(F.count("*").alias("n"))
    events = t.events.select("event_id", F.dayofyear("ts").cast("long").alias("d"))
    days = joins.range_join(events.select("d").distinct(), intervals.withColumn("e", F.col("s") + 7), "d", "s", "e", 7)
    return events.join(days.groupBy("d").agg(F.sum("n").alias("open_orders")), "d").select("event_id", "open_orders")
