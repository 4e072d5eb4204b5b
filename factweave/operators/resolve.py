"""Entity merging, bindings between bodies and occurrences, and assignments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entity_merge(df: DataFrame, keys: list[str], order: list[str], first: list[str], either: dict[str, Column]) -> DataFrame:
    """One row for each key: the first non-null of each field by order, flags ORed, and how many rows it came from."""
    one = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in first]
    return df.groupBy(*keys).agg(*one, *[F.bool_or(f).alias(n) for n, f in either.items()], F.count("*").alias("merged"))


def reconcile_dim(dimension: DataFrame, facts: list[DataFrame], key: str, label: str, missing: str) -> DataFrame:
    """The dimension with a row for each key that only facts have, and one for facts without a key."""
    used = facts[0].select(key)
    for f in facts[1:]:
        used = used.union(f.select(key))
    used = used.distinct()
    absent = used.join(dimension.select(key), key, "left_anti").where(F.col(key).isNotNull()).select(key, F.lit(missing).alias(label))
    none = used.where(F.col(key).isNull()).select(key, F.lit("unattributed").alias(label))
    return dimension.select(key, label).unionByName(absent).unionByName(none)


def bindings(occurrences: DataFrame, bodies: DataFrame, body: str, occurrence: str) -> DataFrame:
    """Distinct body-occurrence pairs, whether the body is known, and whether other occurrences share it. Counts are combined before the shuffle and joined back."""
    pairs = occurrences.select(body, occurrence).distinct()
    known = bodies.select(body).distinct().withColumn("_known", F.lit(True))
    sharing = pairs.groupBy(body).agg(F.count("*").alias("sharing"))
    return pairs.join(sharing, body).join(known, body, "left").select(body, occurrence, F.coalesce("_known", F.lit(False)).alias("bound"), "sharing")


def match_score(f: dict[str, Column], c: dict[str, Column]) -> Column:
    """How well a recovered function f and a candidate c agree.

    f: names (array), library_uri, owner, kind, parameter_types (array), return_type; c: raw_name, name and the same. Unknown
    values agree with nothing; types count only where both sides have as many parameters, and at least one.
    """
    one = lambda flag, n: F.when(F.coalesce(flag, F.lit(False)), n).otherwise(0)
    raw = F.exists(f["names"], lambda n: n == c["raw_name"])
    named = F.exists(f["names"], lambda n: (c["name"] == n) | c["name"].endswith(F.concat(F.lit("."), n)))
    name = F.when(F.coalesce(raw, F.lit(False)), 8).when(F.coalesce(named, F.lit(False)), 7).otherwise(0)
    sized = (F.size(f["parameter_types"]) > 0) & (F.size(f["parameter_types"]) == F.size(c["parameter_types"]))
    same = F.forall(F.zip_with(f["parameter_types"], c["parameter_types"], lambda a, b: a.eqNullSafe(b)), lambda x: x)
    weights = [("library_uri", 2), ("owner", 1), ("kind", 1), ("return_type", 2)]
    return name + sum((one(f[k] == c[k], n) for k, n in weights), F.lit(0)) + one(sized, 1) + one(sized & same, 5)


def attach(assigned: DataFrame, candidates: DataFrame, group: str) -> DataFrame:
    """Assignments with `strong` (score 7 or more), whether the candidate's whole evidence applies (`full`: strong, or the only one of its
    group; else only that the code is the same), and the other parents of candidates that tie.

    assigned: group, row, candidate, score, tied (candidates of the best score); candidates: group, candidate, parent.
    """
    sizes = candidates.groupBy(group).agg(F.count("*").alias("_n"))
    tied = assigned.select(group, "row", "candidate", F.explode("tied").alias("_other"))
    parents = candidates.select(group, F.col("candidate").alias("_other"), F.col("parent").alias("_parent"))
    own = candidates.select(group, "candidate", F.col("parent").alias("_own"))
    others = tied.join(parents, [group, "_other"]).join(own, [group, "candidate"]).where(F.col("_parent").isNotNull() & ~F.col("_parent").eqNullSafe(F.col("_own")))
    others = others.groupBy(group, "row").agg(F.array_sort(F.collect_set("_parent")).alias("other_parents"))
    joined = assigned.join(sizes, group).join(others, [group, "row"], "left")
    strong = F.col("score") >= 7
    return joined.select(*assigned.columns, strong.alias("strong"), (strong | (F.col("_n") == 1)).alias("full"), F.coalesce("other_parents", F.array().cast("array<string>")).alias("other_parents"))


def check_attached(attached: DataFrame, functions: int, root_main: bool) -> dict[str, int]:
    """Counts of an attachment; fails if nothing matched, or the root's main has code that no function matched. attached: strong, group offset, is_root_main."""
    row = attached.agg(F.count("*").alias("matched"), F.count_if("strong").alias("strong"), F.count_distinct("offset").alias("offsets"), F.count_if("is_root_main").alias("main")).first()
    if root_main and not row["main"]:
        raise ValueError("the root's main has no matching code: the evidence is of another build")
    if functions and not row["matched"]:
        raise ValueError("no code offset of the evidence matches")
    return {"matched": row["matched"], "strong": row["strong"], "offsets": row["offsets"], "unmatched": functions - row["matched"]}


def consuming_pair(debug: DataFrame, snapshot: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Each debug row, in order, takes the first snapshot row of its key with its kind, else the first of all, and that one is gone for
    those behind it; null when none is left. debug: key, order, kind; snapshot: key, order, kind. The taking is sequential within a
    key, so a key is one task: keys are addresses and have few rows. Each row is looked at twice at most.
    """
    kinds = dict(debug.dtypes)

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = right.sort_values(order)
        free: dict = dict.fromkeys(rows.index)
        queues: dict = {k: iter(g.index) for k, g in rows.groupby(kind, dropna=False)}
        first = iter(rows.index)
        out = []
        for own_key, place, wanted in left.sort_values(order)[[key, order, kind]].itertuples(index=False):
            hit = next((i for i in queues.get(wanted, ()) if i in free), None)
            if hit is None:
                hit = next((i for i in first if i in free), None)
            if hit is not None:
                del free[hit]
            out.append((own_key, place, None if hit is None else rows.at[hit, order]))
        return pd.DataFrame(out, columns=[key, order, "taken"])

    return debug.groupBy(key).cogroup(snapshot.groupBy(key)).applyInPandas(pair, f"{key} {kinds[key]}, {order} {kinds[order]}, taken {dict(snapshot.dtypes)[order]}")


def same_declaration(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two declarations are one object: equal kind, library, owner and name, and for functions equal kinds and either one
    identity, or one from each source of evidence with compatible signatures and places.

    Each side: kind, library_uri, owner, name, function_kind, vm_object_id, snapshot_reference, fixed, optional, named (null without a
    signature), types (null if unresolved), place (null if unknown).
    """
    keys = a["kind"].eqNullSafe(b["kind"])
    for k in ("library_uri", "owner", "name"):
        keys = keys & a[k].eqNullSafe(b[k])
    closure = a["name"].isin("<anonymous closure>", "anonymous closure")
    unsigned = a["fixed"].isNull() | b["fixed"].isNull()
    shape = a["fixed"].eqNullSafe(b["fixed"]) & a["optional"].eqNullSafe(b["optional"]) & a["named"].eqNullSafe(b["named"])
    typed = F.when(a["types"].isNotNull() & b["types"].isNotNull(), a["types"].eqNullSafe(b["types"])).otherwise(~closure)
    compatible = F.when(unsigned, ~closure).otherwise(shape & typed)
    placed = a["place"].isNull() | b["place"].isNull() | (a["place"] == b["place"])
    vm_a, vm_b = a["vm_object_id"].isNotNull(), b["vm_object_id"].isNotNull()
    identity = (vm_a & a["vm_object_id"].eqNullSafe(b["vm_object_id"])) | (~vm_a & ~vm_b & a["snapshot_reference"].eqNullSafe(b["snapshot_reference"]))
    crossing = (vm_a != vm_b) & ~(vm_a & (F.coalesce(a["snapshot_reference"], F.lit(-1)) >= 0)) & compatible & placed
    return keys & F.when(a["kind"] != "function", True).otherwise(a["function_kind"].eqNullSafe(b["function_kind"]) & (identity | crossing))


def greedy_pair(left: DataFrame, right: DataFrame, key: str, l_order: list[str], r_order: list[str]) -> DataFrame:
    """The i-th left row of a key with its i-th right row; left rows beyond the right ones get null. An approximation of consuming_pair
    without kinds, which needs no Python and lets hot keys be ranked in place."""
    a = left.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*l_order)))
    b = right.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*r_order)))
    return a.join(b, [key, "place"], "left")


def scored_assign(rows: DataFrame, candidates: DataFrame, group: str, score) -> DataFrame:
    """Greedy assignment within a group: rows with the fewest ties first, then the best score, then the row id; each takes
    its best unused candidate, ties to the smaller id, and the best one again if all are used. `reused`, `ties` and `tied` say so.
    The order is sequential, so a group is one task: groups are the entries of one code offset and have few rows.

    rows: group, row; candidates: group, candidate; score(row, candidate, left, right) gets plain dicts of the two rows.
    """
    kind = dict(rows.dtypes)[group]

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ls, rs = left.to_dict("records"), right.to_dict("records")
        table = [[score(a, b) for b in rs] for a in ls]
        best = [max(t, default=None) for t in table]
        order = sorted((i for i in range(len(ls)) if best[i] is not None), key=lambda i: (table[i].count(best[i]), -best[i], ls[i]["row"]))
        used: set[int] = set()
        out = []
        for i in order:
            ranked = sorted(range(len(rs)), key=lambda j: (-table[i][j], rs[j]["candidate"]))
            free = [j for j in ranked if j not in used]
            j = (free or ranked)[0]
            tied = [rs[k]["candidate"] for k in ranked if table[i][k] == best[i]]
            out.append((ls[i][group], ls[i]["row"], rs[j]["candidate"], int(table[i][j]), not free, len(tied), tied))
            used.add(j)
        return pd.DataFrame(out, columns=[group, "row", "candidate", "score", "reused", "ties", "tied"])

    return rows.groupBy(group).cogroup(candidates.groupBy(group)).applyInPandas(assign, f"{group} {kind}, row long, candidate long, score long, reused boolean, ties long, tied array<long>")


def hypothesis_vote(df: DataFrame, group: str, hypothesis: str, contradictions: str, explained: str, value: str) -> DataFrame:
    """Keeps each group's hypotheses with the fewest contradictions, then the most explained; a value is proven if all kept ones agree."""
    totals = df.groupBy(group, hypothesis).agg(F.sum(contradictions).alias("c"), F.sum(explained).alias("e"), F.min(value).alias("v"))
    best = totals.groupBy(group).agg(F.min(F.struct("c", (-F.col("e")).alias("e"))).alias("best"))
    kept = totals.join(best, group).where((F.col("c") == F.col("best.c")) & (F.col("e") == -F.col("best.e")))
    return kept.groupBy(group).agg(F.count("*").alias("kept"), F.when((F.min("v") == F.max("v")) & (F.max("e") > 0), F.min("v")).alias("proven"))
