"""Joins that refuse ambiguity, overlays, and joins on ranges.

Null keys are values where the operator says so (`<=>`); elsewhere they match nothing. No side is broadcast by hint: sizes
are Spark's to judge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranged

#: Rows on a side of a tile, and pairs of a task, about; most tasks of one join; rows of a block, and rows of one interval that meet it at once.
TILE_ROWS, TASK_PAIRS, MOST_TASKS, BLOCK_ROWS, ROWS_AT_ONCE = 4096, 1 << 22, 10_000, 256, 16


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def unique_rows(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows whose key no other row has. One aggregation, no window over the key's rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in columns]).where("_n = 1").drop("_n")


def unique_match(target: DataFrame, reference: DataFrame, on: list[str], t_columns: list[str], r_columns: list[str]) -> DataFrame:
    """Pairs whose key is unique on either side."""
    return unique_rows(target, on, t_columns).join(unique_rows(reference, on, r_columns), on)


def unambiguous_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value where a key has one distinct value."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_most")).where(F.col(value) == F.col("_most")).drop("_most")


def overlay_map(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """Both maps, the right one's values where it has the key."""
    b, o = base.select(key, F.col(value).alias("_base")), over.select(key, F.col(value).alias("_over"))
    return b.join(o, key, "full").select(key, F.coalesce("_over", "_base").alias(value))


def overlay_missing(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """base with the values of over for the keys that base lacks: what is known already stays. Null and empty values name nothing; of several the least stays."""
    named = over.where(F.col(key).isNotNull() & F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key).agg(F.min(value).alias(value))
    return base.select(key, value).unionByName(named.join(base.select(key), key, "left_anti"))


def promote_indirect(calls: DataFrame, recovered: DataFrame, libraries: DataFrame, scope) -> DataFrame:
    """Indirect calls whose address has a recovered target get target, library and scope; the others keep nulls.

    calls: caller, address, expression; recovered: caller, address, target, the last by `place` counts and dispatch labels do not;
    libraries: target, library_uri, null where targets of one name disagree; scope(library, target) names the scope.
    """
    known = recovered.where(~F.col("target").startswith("dispatch ")).groupBy("caller", "address").agg(F.max_by("target", "place").alias("target"))
    homes = libraries.groupBy("target").agg(F.when(F.count_distinct("library_uri") == 1, F.min("library_uri")).alias("library_uri"))
    joined = calls.join(known, ["caller", "address"], "left").join(homes, "target", "left")
    return joined.select(*calls.columns, "target", "library_uri", F.when(F.col("target").isNotNull(), scope(F.col("library_uri"), F.col("target"))).alias("scope"))


def relabel_stubs(calls: DataFrame, stubs: DataFrame, base: int) -> DataFrame:
    """Calls of unnamed code that is a stub take its name; those that only throw for null are left out.

    calls: target and others; unnamed code is sub_ and hexadecimal digits, `base` before its offset. stubs: offset, name.
    """
    digits = F.regexp_extract("target", "^sub_([0-9a-fA-F]{1,16})$", 1)
    offset = F.when(digits != "", F.conv(digits, 16, 10).cast("decimal(20,0)") - F.lit(base))
    known = stubs.select(F.col("offset").cast("decimal(20,0)").alias("_offset"), F.col("name").alias("_stub"))
    joined = calls.withColumn("_at", offset).join(known, F.col("_at") == F.col("_offset"), "left")
    throws = F.coalesce(F.col("_stub").rlike("NullError|NullCastError|NullArgError"), F.lit(False))
    return joined.where(~throws).withColumn("target", F.coalesce("_stub", "target")).select(*calls.columns)


def field_layout(slots: DataFrame, fields: DataFrame) -> DataFrame:
    """Slots with the field that lies exactly at their class, library and offset, if exactly one does. Null libraries are a value."""
    keys = ["class_name", "library_uri", "offset"]
    one = fields.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("field").alias("field"), F.min("field_type").alias("field_type")).where("_n = 1").drop("_n")
    on = reduce(Column.__and__, [slots[k].eqNullSafe(one[k]) for k in keys])
    return slots.join(one, on, "left").select(*[slots[c] for c in slots.columns], one["field"], one["field_type"])


def residual_match(left: DataFrame, right: DataFrame, group: str, value: str) -> DataFrame:
    """group, left, right: what remains when values of both sides are removed, where exactly one remains on each side."""
    both = left.select(group, value, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(group, value, F.lit(0), F.lit(1)))
    sides = both.groupBy(group, value).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l + r = 1")
    out = sides.groupBy(group).agg(F.sum("l").alias("nl"), F.sum("r").alias("nr"), F.min(F.when(F.col("l") == 1, F.col(value))).alias("left_value"), F.min(F.when(F.col("r") == 1, F.col(value))).alias("right_value"))
    return out.where("nl = 1 AND nr = 1").drop("nl", "nr")


def only_pair(left: DataFrame, right: DataFrame, group: str, value: str, kind: Column) -> DataFrame:
    """group, left_value, right_value where exactly one row of the kind stands on each side; names that both sides share pair by themselves and do not count."""
    return residual_match(left.where(kind), right.where(kind), group, value)


def exists_flag(df: DataFrame, other: DataFrame, keys: list[str], name: str = "found") -> DataFrame:
    """df with whether other has its key; null keys are values."""
    known = other.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct().withColumn("_found", F.lit(True))
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(known, on, "left").select(*df.columns, F.coalesce("_found", F.lit(False)).alias(name))


def fill_placeholder(df: DataFrame, lookup: DataFrame, on: str, column: str, value: str, placeholder: Column) -> DataFrame:
    """Replaces a column by a looked-up value only where it is null or a placeholder and a value is known."""
    joined = df.join(lookup.select(on, F.col(value).alias("_new")), on, "left")
    use = (F.col(column).isNull() | placeholder) & F.col("_new").isNotNull()
    return joined.withColumn(column, F.when(use, F.col("_new")).otherwise(F.col(column))).drop("_new")


def overlay_append(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """base with the non-null columns of over, then over's rows that base lacks."""
    renamed = over.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    kept = base.select(key, *columns).join(renamed, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])
    return kept.unionByName(over.select(key, *columns).join(base.select(key), key, "left_anti"))


def merge_patch(base: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """MERGE: patched columns replace base's (null patches do not), unknown keys are appended."""
    return overlay_append(base, patch, key, columns)


def alias_agreement(df: DataFrame, key: str, label: str) -> DataFrame:
    """key and its label if all rows agree on one, else null; the number of distinct labels beside it."""
    out = df.groupBy(key).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count_distinct(label).alias("labels"))
    return out.select(key, F.when(F.col("_low") == F.col("_high"), F.col("_low")).alias(label), "labels")


def range_relation(a0: Column, a1: Column, b0: Column, b1: Column, unknown: str = "unknown") -> Column:
    """How a static interval [a0, a1) lies to another [b0, b1)."""
    return (
        F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull(), unknown)
        .when((a0 == b0) & (a1 == b1), "exact")
        .when(a0 == b0, "same_start_different_end")
        .when((b0 >= a0) & (b1 <= a1), "oracle_contained")
        .when((a0 >= b0) & (a1 <= b1), "static_contained")
        .when((a0 < b1) & (b0 < a1), "overlap")
        .otherwise("disjoint")
    )


def range_relations(intervals: DataFrame, by: str, key: str, start: str, end: str, unknown: str = "unknown") -> DataFrame:
    """a, b, relation: every pair of keys a < b of one `by`, and how the interval of a lies to that of b; `unknown` where one has no start or end.

    Rows are cut into ranges of (by, key), and a range meets itself and the later ones of its `by` in tiles: a value of `by` that
    very many rows share takes many tasks, and only pairs within a range are made in both orders. The result is far larger than the
    table, so its order is made for a file's dictionaries and compression: the later range is cut into blocks of keys, and each block stands whole,
    in the order of its intervals, beside one row after the other, those of one interval together. So a is in runs, b repeats a short
    pattern, and so does the relation. No row makes more rows than a block and ROWS_AT_ONCE give, since Spark buffers what one row
    explodes into. Null keys and nulls in `by` meet nothing.
    """
    rows = intervals.select(by, F.col(key).alias("a"), F.col(start).alias("_s"), F.col(end).alias("_e")).where(F.col(by).isNotNull() & F.col("a").isNotNull())
    cut = ranged(rows, [by, "a"], TILE_ROWS)
    ranges = cut.groupBy(by, "_b").agg(F.count("*").alias("n"))
    totals = ranges.groupBy(by).agg(F.count("*").cast("double").alias("k"), F.sum("n").cast("double").alias("n"))
    tiles, pairs = totals.agg(F.sum(F.col("k") * (F.col("k") + 1) / 2), F.sum(F.col("n") * F.col("n") / 2)).first()
    tasks = int(min(tiles or 1, (pairs or 0) // TASK_PAIRS + 1, MOST_TASKS))

    peers = ranges.groupBy(by).agg(F.collect_list("_b").alias("_all"))
    placed = cut.withColumn("_k", F.floor((F.row_number().over(Window.partitionBy(by, "_b").orderBy("a")) - 1) / BLOCK_ROWS))
    blocks = placed.groupBy(by, "_b", "_k").agg(F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("a").alias("b")))).alias("_block"), F.max("a").alias("_last"))
    right = blocks.join(peers, by).select(by, F.explode(F.filter("_all", lambda x: x <= F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), "_block", "_last")
    alike = cut.groupBy(by, "_b", F.col("_s").alias("s"), F.col("_e").alias("e")).agg(F.array_sort(F.collect_list("a")).alias("_as"))
    starts = F.sequence(F.lit(1), F.size("_as"), F.lit(ROWS_AT_ONCE))
    alike = alike.select(by, "_b", "s", "e", F.explode(F.transform(starts, lambda k: F.slice("_as", k, ROWS_AT_ONCE))).alias("keys"))
    sides = alike.groupBy(by, "_b").agg(F.array_sort(F.collect_list(F.struct("s", "e", "keys"))).alias("_side"))
    left = sides.join(peers, by).select(by, F.col("_b").alias("_i"), F.explode(F.filter("_all", lambda x: x >= F.col("_b"))).alias("_j"), "_side")

    tile = [by, "_i", "_j"]
    met = right.repartition(tasks, *tile).join(left.repartition(tasks, *tile).hint("merge"), tile)  # sizes before the exchange say nothing of those after it
    below = F.filter("_side", lambda x: x["keys"][0] < F.col("_last"))
    met = met.select("_block", F.explode(below).alias("_x"))  # a lambda is not compiled: rows go on one by one, where compiled code would hold all that a block makes
    met = met.select("_block", F.col("_x.s").alias("_s"), F.col("_x.e").alias("_e"), F.explode("_x.keys").alias("a")).select("_s", "_e", "a", F.explode("_block").alias("_y")).where(F.col("a") < F.col("_y.b"))
    return met.select("a", F.col("_y.b").alias("b"), range_relation(F.col("_s"), F.col("_e"), F.col("_y.s"), F.col("_y.e"), unknown).alias("relation"))


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Points in [start, end). Intervals are filed under every bin of `width` that they touch, so the join is on equality; nothing is lost for intervals of any length."""
    filed = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    binned = points.withColumn("_bin", F.floor(F.col(point) / width))
    return binned.join(filed, "_bin").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def enclosing(intervals: DataFrame, key: str, start: str, end: str, width: int) -> DataFrame:
    """Intervals with `parent`, the key of the smallest strictly larger one that encloses them, ties to the least key; only those that have one.

    Equal intervals are one row before the join, so what meets is pairs of distinct intervals that share the bin of the inner start.
    """
    distinct = intervals.where(F.col(end) > F.col(start)).groupBy(start, end).agg(F.min(key).alias("_k"))
    touched = F.sequence(F.floor(F.col("_os") / width), F.floor((F.col("_oe") - 1) / width))
    outer = distinct.select(F.col(start).alias("_os"), F.col(end).alias("_oe"), "_k").withColumn("_bin", F.explode(touched))
    met = distinct.select(start, end, F.floor(F.col(start) / width).alias("_bin")).join(outer, "_bin")
    met = met.where((F.col("_os") <= F.col(start)) & (F.col("_oe") >= F.col(end)) & (F.col("_oe") - F.col("_os") > F.col(end) - F.col(start)))
    best = met.groupBy(start, end).agg(F.min(F.struct((F.col("_oe") - F.col("_os")).alias("w"), F.col("_k").alias("parent"))).alias("_best"))
    return intervals.join(best, [start, end]).withColumn("parent", F.col("_best.parent")).drop("_best")


def innermost(joined: DataFrame, point: list[str], order: list[Column]) -> DataFrame:
    """One row for each point, the first by order."""
    w = Window.partitionBy(*point).orderBy(*order)
    return joined.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def asof_join(points: DataFrame, marks: DataFrame, by: list[str], at: str, order: list[str], payload: str) -> DataFrame:
    """Points with the payload of the last mark of the same key at or before them; marks come before points of the same place."""
    rows = points.withColumn("_mark", F.lit(None).cast(marks.schema[payload].dataType)).withColumn("_kind", F.lit(1))
    fill = marks.select(*by, at, *[c for c in order if c != at], F.col(payload).alias("_mark")).withColumn("_kind", F.lit(0))
    w = Window.partitionBy(*by).orderBy(at, *[c for c in order if c != at], "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(fill, allowMissingColumns=True).withColumn(payload, F.last("_mark", ignorenulls=True).over(w))
    return both.where("_kind = 1").drop("_mark", "_kind")


def chain_left_join(df: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left joins in turn, each (dimension, key of df, key of dimension); a missing link leaves null in all that follow."""
    for dimension, left, right in steps:
        df = df.join(dimension, df[left] == dimension[right], "left").drop(dimension[right]) if left != right else df.join(dimension, left, "left")
    return df


def relabel_array(df: DataFrame, key: list[str], items: Column, lookup: DataFrame, token: str, label: str, by: str = " ") -> DataFrame:
    """Explodes items, relabels those that the lookup knows, and joins them in order again."""
    exploded = df.select(*key, F.posexplode(items).alias("_place", token))
    joined = exploded.join(lookup.select(token, F.col(label).alias("_label")), token, "left")
    lists = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_place", F.coalesce("_label", token).alias("v")))).alias("_all"))
    return lists.select(*key, F.array_join(F.transform("_all", lambda x: x["v"]), by).alias("relabelled"))


def field_mismatches(pairs: DataFrame, fields: list[tuple[str, str, str]]) -> Column:
    """Names of the fields (name, left, right) in which a pair differs; null equals null."""
    return F.array_compact(F.array(*[F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(n)) for n, a, b in fields]))


def both_present_mismatch(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of both sides whose values are both known and differ."""
    r = right.select(key, F.col(value).alias("_other"))
    return left.join(r, key).where(F.col(value).isNotNull() & F.col("_other").isNotNull() & (F.col(value) != F.col("_other"))).withColumnRenamed("_other", f"{value}_other")
