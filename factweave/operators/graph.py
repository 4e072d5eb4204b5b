"""Fixpoints over edge tables. Each round is written to the shared folder and the one before deleted; only counts reach the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written


def iterate_until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame], object], rounds: int = 100) -> DataFrame:
    """Applies step until measure, a small value, no longer changes."""
    state = written(state, "round")
    before = measure(state)
    for _ in range(rounds):
        last, state = state, written(step(state), "round")
        drop(last)
        now = measure(state)
        if now == before:
            return state
        before = now
    raise RuntimeError(f"not stable after {rounds} rounds")


def transitive_closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """src, dst of all reachable pairs, every node reaching itself. Paths double each round: known pairs join known pairs."""
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct()
    paths = edges.union(nodes.select(F.col("n").alias("src"), F.col("n").alias("dst")))

    def step(known: DataFrame) -> DataFrame:
        more = known.select("src", F.col("dst").alias("via")).join(known.select(F.col("src").alias("via"), "dst"), "via")
        return more.select("src", "dst").distinct()  # known pairs come back through themselves

    return iterate_until_stable(paths, step, lambda df: df.count(), rounds)


def label_propagation(edges: DataFrame, seeds: DataFrame, rounds: int = 1000) -> DataFrame:
    """node, label: an unlabelled node takes a label once all its callers have one and agree. edges: caller, callee; self-edges are ignored.

    A round reads the calls of the nodes labelled in the last one and no others. Each callee that is still open keeps how
    many callers have a label, and the least and the greatest of them; it is settled when that is all its callers.
    """
    calls = written(edges.where("caller <> callee").select("caller", "callee").distinct(), "calls")
    callers = written(calls.groupBy("callee").agg(F.count("*").alias("n")), "callers")
    fresh = written(seeds.select("node", "label").distinct(), "labels")
    known, open_ = [fresh], None
    seeded = fresh.select(F.col("node").alias("callee"))
    for _ in range(rounds):
        told = calls.join(fresh.select(F.col("node").alias("caller"), "label"), "caller").select("callee", F.lit(1).cast("long").alias("k"), F.col("label").alias("low"), F.col("label").alias("high"))
        every = told if open_ is None else told.union(open_)
        sums = every.groupBy("callee").agg(F.sum("k").alias("k"), F.min("low").alias("low"), F.max("high").alias("high"))
        last, open_ = open_, written(sums.join(callers, "callee").join(seeded, "callee", "left_anti"), "open")
        fresh = written(open_.where("k = n AND low = high").select(F.col("callee").alias("node"), F.col("low").alias("label")), "labels")
        if last is not None:
            drop(last)
        open_ = written(open_.where("k < n").select("callee", "k", "low", "high"), "open")
        if fresh.isEmpty():
            break
        known.append(fresh)
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    out = known[0]
    for table in known[1:]:
        out = out.union(table)
    return out


def bounded_bfs(edges: DataFrame, roots: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """node, depth of what is within `depth` steps; with `most`, no round starts once so many nodes are known, and the first by (depth, node) stay."""
    fresh = known = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    edges = written(edges.select("src", "dst").distinct(), "edges")
    for d in range(1, depth + 1):
        if most is not None and known.count() >= most:
            break
        reached = fresh.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        fresh = written(reached.join(known.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "reached")
        known = known.union(fresh)
    return known.orderBy("depth", "node").limit(most) if most is not None else known


def reverse_edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """dst with its distinct sources counted; negative targets are none."""
    return edges.where(F.col(dst) >= 0).select(dst, src).distinct()


def _dominator_sets(nodes: list, before: dict, entry) -> dict:
    """For each node the nodes on every way from the entry to it; nodes without a way keep all."""
    found = {n: set(nodes) for n in nodes}
    found[entry] = {entry}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            if n != entry:
                ways = [found[p] for p in before.get(n, ())]
                new = {n} | (set.intersection(*ways) if ways else set())
                if new != found[n]:
                    found[n], changed = new, True
    return found


def _per_graph(edges: DataFrame, graph: str, solve: Callable, column: str) -> DataFrame:
    """solve(nodes, edges) of each small graph, whose edges are one group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = [(int(s), int(d)) for s, d in zip(pdf["src"], pdf["dst"], strict=True) if not pd.isna(d)]
        found = solve(sorted({int(s) for s in pdf["src"]} | {d for _, d in pairs}), pairs)
        return pd.DataFrame({graph: pdf[graph].iloc[0], "node": list(found), column: list(found.values())})

    kind = dict(edges.dtypes)[graph]
    return edges.groupBy(graph).applyInPandas(run, f"{graph} {kind}, node long, {column} {'array<long>' if column.endswith('s') else 'long'}")


def dominators(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node, dominators; edges: graph, src, dst (null for none); the least node is the entry."""

    def solve(nodes: list, pairs: list) -> dict:
        before: dict = {}
        for s, d in pairs:
            before.setdefault(d, set()).add(s)
        return {n: sorted(x) for n, x in _dominator_sets(nodes, before, nodes[0]).items()}

    return _per_graph(edges, graph, solve, "dominators")


def branch_joins(edges: DataFrame, graph: str = "graph") -> DataFrame:
    """graph, node, joined of every node with two or more successors: its immediate post-dominator, by a virtual exit behind
    all nodes without successors; null if its ways only meet at the exit."""

    def solve(nodes: list, pairs: list) -> dict:
        end = None
        after: dict = {}
        for s, d in pairs:
            after.setdefault(s, set()).add(d)
        ways = {n: after.get(n) or {end} for n in nodes}
        found = _dominator_sets([end, *nodes], ways, end)
        out = {}
        for n in nodes:
            if len(after.get(n, ())) > 1:
                above = found[n] - {n}
                nearest = max(above, key=lambda x: len(found[x]), default=end)  # the closest one has the most of its own
                out[n] = nearest
        return out

    return _per_graph(edges, graph, solve, "joined")
