"""Operators on a few literal rows: nulls, ties, duplicates and empty inputs."""

import pytest
from pyspark.sql import functions as F

from factweave.functions import kernels
from factweave.functions import text as X
from factweave.operators import aggregates, graph, joins, ordered, resolve
from factweave.plans import match, observations, trace


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, expression, *values):
    kinds = ", ".join(f"c{k} string" for k in range(len(values)))
    return spark.createDataFrame([values], kinds).select(expression(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first().x


def test_unambiguous_map(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z"), ("c", None)], "k string, v string")
    assert rows(joins.unambiguous_map(df, "k", "v")) == [("a", "x"), (None, "z")]
    assert joins.unambiguous_map(df.limit(0), "k", "v").count() == 0


def test_unique_match_refuses_duplicates(spark):
    t = spark.createDataFrame([("p", 1), ("q", 2), ("q", 3), ("r", 4)], "k string, t long")
    r = spark.createDataFrame([("p", 10), ("q", 11), ("r", 12), ("r", 13)], "k string, r long")
    assert rows(joins.unique_match(t, r, ["k"], ["t"], ["r"])) == [("p", 1, 10)]


def test_residual_match(spark):
    left = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "b"), ("i", "a")], "g string, v string")
    right = spark.createDataFrame([("g", "a"), ("g", "c"), ("h", "c"), ("i", "a")], "g string, v string")
    assert rows(joins.residual_match(left, right, "g", "v")) == [("g", "b", "c")]


def test_overlay_and_append(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "B"), (3, "C"), (1, None)], "k int, v string")
    assert rows(joins.overlay_map(a, b, "k", "v")) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows(joins.overlay_append(a, b, "k", ["v"])) == [(1, "a"), (2, "B"), (3, "C")]


def test_exists_flag_takes_null_as_a_key(spark):
    a = spark.createDataFrame([("m", None), ("m", "l"), ("n", None)], "name string, library string")
    b = spark.createDataFrame([("m", None)], "name string, library string")
    assert rows(joins.exists_flag(a, b, ["name", "library"])) == sorted([("m", None, True), ("m", "l", False), ("n", None, False)], key=str)


@pytest.mark.parametrize("b, want", [((0, 9), "exact"), ((0, 5), "same_start_different_end"), ((2, 5), "oracle_contained"), ((-3, 12), "static_contained"), ((5, 12), "overlap"), ((9, 12), "disjoint"), ((None, 3), "unknown")])
def test_range_relation(spark, b, want):
    df = spark.createDataFrame([(0, 9, *b)], "a0 long, a1 long, b0 long, b1 long")
    assert df.select(joins.range_relation(*map(F.col, df.columns))).first()[0] == want


@pytest.mark.parametrize("size", [3, 40, 4096])
def test_range_relations_in_tiles(spark, tmp_path, monkeypatch, size):
    """A brand that nearly all parts share, a key that parts share, nulls: as the SQL has it, and in more than one task."""
    import __spark_entry__ as entry

    duckdb = pytest.importorskip("duckdb")
    data = [(k if k != 9 else 8, None if k == 40 else "small" if k % 30 == 7 else "large", None if k % 11 == 5 else k * 7 % 13) for k in range(200)] + [(None, "large", 3)]
    spark.createDataFrame(data, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(joins, "TILE_ROWS", size, raising=False)
    monkeypatch.setattr(joins, "TASK_PAIRS", 500, raising=False)
    got = entry.queries()["range_relation"](spark, str(tmp_path))
    want = duckdb.sql(entry.oracle_sql()["range_relation"].replace("FROM part", f"FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")).fetchall()
    assert rows(got) == sorted(want, key=str) and len(want) > 10_000
    assert size > len(data) or got.rdd.getNumPartitions() > 1


@pytest.mark.parametrize("block, once", [(1, 1), (7, 2), (64, 500)])
def test_range_relations_in_blocks(spark, monkeypatch, block, once):
    """Blocks and slices of any size give each pair once; all rows of one interval, repeated keys and no start among them."""
    data = [("g", k // 2 if k < 20 else k, None if k % 13 == 5 else 3 if k < 50 else k % 4, 8) for k in range(90)] + [("h", 1, 3, 8), ("h", 2, 3, 9)]
    for name, value in (("TILE_ROWS", 40), ("BLOCK_ROWS", block), ("ROWS_AT_ONCE", once)):
        monkeypatch.setattr(joins, name, value)
    df = spark.createDataFrame(data, "g string, k long, s long, e long")
    a, b = (df.select("g", *[F.col(c).alias(f"{c}{n}") for c in "kse"]) for n in "01")
    want = a.join(b, "g").where("k0 < k1").select("k0", "k1", joins.range_relation(F.col("s0"), F.col("e0"), F.col("s1"), F.col("e1")))
    assert rows(joins.range_relations(df, "g", "k", "s", "e")) == rows(want)


def test_range_relations_are_small_on_disk(spark, tmp_path):
    """The pairs of a brand outgrow any table, so files must hold them in a fraction of a byte each."""
    spark.range(3000).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(1 + hash(id) & 31 AS INT) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    import __spark_entry__ as entry

    entry.queries()["range_relation"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3000 * 2999 // 2
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < 0.5 * 3000 * 2999 / 2


def test_range_relations_of_nothing(spark):
    df = spark.createDataFrame([("g", None, 1, 2), (None, 1, 1, 2)], "g string, k long, s long, e long")
    assert joins.range_relations(df, "g", "k", "s", "e").count() == joins.range_relations(df.limit(0), "g", "k", "s", "e").count() == 0


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_range_join_matches_theta_join(spark, width):
    p = spark.createDataFrame([(k,) for k in range(-5, 40)], "p long")
    i = spark.createDataFrame([(0, 0, 10), (1, -3, 2), (2, 5, 5), (3, 9, 30)], "id long, s long, e long")
    assert rows(joins.range_join(p, i, "p", "s", "e", width).select("p", "id")) == rows(p.join(i, (F.col("p") >= F.col("s")) & (F.col("p") < F.col("e"))).select("p", "id"))


def test_asof(spark):
    p = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t long")
    m = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 9, "z")], "k string, t long, v string")
    assert rows(joins.asof_join(p, m, ["k"], "t", ["t"], "v").select("k", "t", "v")) == [("a", 1, None), ("a", 5, "y"), ("b", 5, None)]


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_runs_across_ranges(spark, size, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", size)
    values = [None, None, "a", "a", "b", None, "b", "b"]
    df = spark.createDataFrame(list(enumerate(values)), "k long, v string")
    assert rows(ordered.rle_runs(df, ["k"], "v")) == sorted([(0, 2, None), (2, 2, "a"), (4, 1, "b"), (5, 1, None), (6, 2, "b")], key=str)
    assert rows(ordered.size_from_next(df, "k")) == [(k, 1) for k in range(8)]
    total = ordered.global_running_sum(df, ["k"], F.col("k"), "s").select("k", "s")
    assert rows(total) == [(k, k * (k + 1) // 2) for k in range(8)]


def test_runs_of_nothing(spark):
    assert ordered.rle_runs(spark.createDataFrame([], "k long, v string"), ["k"], "v").count() == 0


def test_consecutive_dedup_and_lookback(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, None), ("u", 4, None), ("u", 5, "a")], "k string, t long, v string")
    assert [r.t for r in ordered.consecutive_dedup(df, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 3, 5]
    near = ordered.lookback(df, ["k"], ["t"], F.col("v") == "a", "t", 2).orderBy("t").collect()
    assert [r.nearest for r in near] == [None, 1, 2, 2, None]


def test_election_refuses_ties(spark):
    df = spark.createDataFrame([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), ("de", "b")], "l string, s string")
    assert rows(aggregates.elect_or_null(df, ["l"], "s")) == [("de", 1, None), ("en", 2, "a")]
    uris = lambda *u: spark.createDataFrame([(x,) for x in u], "uri string")
    assert aggregates.elect_package(uris("package:a/main.dart", "package:b/x.dart", "package:b/y.dart"), "uri").first().package == "a"
    assert aggregates.elect_package(uris("package:b/x.dart"), "uri").first().package is None
    assert aggregates.elect_package(uris("package:a/x.dart", "package:a/x.dart"), "uri").first().package is None  # one address, however often
    assert aggregates.elect_package(uris("package:a/src/main.dart", "package:b/x.dart", "package:b/y.dart"), "uri").first().package == "b"
    assert aggregates.elect_package(uris("package:flutter/main.dart", "package:flutter_test/a.dart", "package:flutter_test/b.dart"), "uri").first().package is None
    assert aggregates.elect_package(uris("package:a/x.dart", "package:a/y.dart", "package:b/x.dart", "package:b/y.dart"), "uri").first().package is None


def test_consensus(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "b", 1), ("k", "c", 1), ("d", "a", 1), ("d", "b", 2), ("s", "a", 1), ("p", "a", 3), ("p", "c", 3)], "k string, abi string, v long")
    got = {r.k: (r.state, r.tier) for r in aggregates.consensus(df, ["k"], "abi", ["v"], 3).collect()}
    assert got == {"k": ("corroborated", "cross_abi_corroborated"), "d": ("disputed", "inferred"), "s": ("unaligned", "inferred"), "p": ("partial", "cross_abi_corroborated")}


def test_merging_never_raises_a_tier(spark):
    df = spark.createDataFrame([(1, "proven"), (1, "inferred"), (2, "proven"), (3, "proven"), (3, "speculative")], "k int, tier string")
    assert rows(aggregates.tier_merge(df, ["k"], "tier")) == [(1, "inferred"), (2, "proven"), (3, "speculative")]
    assert df.where(aggregates.at_least("tier", "cross_abi_corroborated")).count() == 3


def test_tri_state_and_bits(spark):
    df = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, False), (3, 1, True), (3, 1, False)], "k long, v long, f boolean")
    got = {r.k: (r.supplied, r.needs) for r in aggregates.constraint_solve(df, ["k"], "v", F.col("f")).collect()}
    assert got == {1: ("1|2", True), 2: ("1", False), 3: ("1", None)}
    assert aggregates.calibrate_bit(df, "k", F.col("k") % 2, 0, 5).first().bit == 0


def test_propagation_needs_agreement(spark):
    df = spark.createDataFrame([(1, "g", "x", True), (2, "g", "x", True), (3, "g", None, False), (4, "h", "x", True), (5, "h", "y", True), (6, "h", None, False)], "id long, g string, v string, d boolean")
    got = {r.id: r.propagated for r in aggregates.propagate_agreeing(df, "g", "v", F.col("d")).collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: "x", 5: "y", 6: None}


def test_entity_merge_is_idempotent(spark):
    df = spark.createDataFrame([("k", 1, None, False), ("k", 2, "b", True), ("k", 3, "c", False), (None, 4, None, False), (None, 5, "n", False)], "k string, o long, v string, f boolean")
    once = resolve.entity_merge(df, ["k"], ["o"], ["v"], {"f": F.col("f")})
    assert rows(once.select("k", "v", "f", "merged")) == sorted([("k", "b", True, 3), (None, "n", False, 2)], key=str)
    again = resolve.entity_merge(once.withColumn("o", F.lit(1)), ["k"], ["o"], ["v"], {"f": F.col("f")})
    assert rows(again.select("k", "v", "f")) == rows(once.select("k", "v", "f"))


def test_reconcile_adds_missing_and_unattributed(spark):
    d = spark.createDataFrame([(1, "one")], "k int, n string")
    f = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert rows(resolve.reconcile_dim(d, [f], "k", "n", "missing")) == sorted([(1, "one"), (2, "missing"), (None, "unattributed")], key=str)


def test_scored_assignment_reuses_the_best(spark):
    left = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("g", 3, 9)], "g string, row long, v long")
    right = spark.createDataFrame([("g", 10, 5), ("g", 11, 9)], "g string, candidate long, v long")
    got = {r.row: (r.candidate, r.reused) for r in resolve.scored_assign(left, right, "g", lambda a, b: 10 - abs(a["v"] - b["v"])).collect()}
    assert got == {1: (10, False), 2: (10, True), 3: (11, False)} or got == {1: (10, False), 2: (11, False), 3: (11, True)}


def test_match_scores(spark):
    schema = "id long, names array<string>, library_uri string, owner string, kind string, parameter_types array<string>, return_type string, raw_name string, name string, c_library string, c_owner string, c_kind string, c_types array<string>, c_return string"
    cases = [
        (1, ["a", None], "l", "O", "getter", ["int"], "x", "a", "a", "l", "O", "getter", ["int"], "x"), (2, ["b", None], None, None, None, [], None, "zz", "T.b", None, None, None, [], None), (3, ["c", "d"], "l", "O", None, ["int", None], None, None, "e", "m", "P", None, ["int", None], None),
        (4, ["f", None], "l", None, "getter", ["int"], "x", None, "f", "l", None, "setter", ["num"], "y"), (5, ["g", None], None, None, None, ["a"], None, None, "xg", None, None, None, ["a", "b"], None),
    ]
    df = spark.createDataFrame(cases, schema)
    f = {k: F.col(k) for k in ("names", "library_uri", "owner", "kind", "parameter_types", "return_type")}
    c = {"raw_name": F.col("raw_name"), "name": F.col("name"), "library_uri": F.col("c_library"), "owner": F.col("c_owner"), "kind": F.col("c_kind"), "parameter_types": F.col("c_types"), "return_type": F.col("c_return")}
    assert {r.id: r.s for r in df.select("id", resolve.match_score(f, c).alias("s")).collect()} == {1: 8 + 2 + 1 + 1 + 6 + 2, 2: 7, 3: 6, 4: 7 + 2 + 1, 5: 0}


def test_attachment(spark):
    assigned = spark.createDataFrame([("o1", 1, 10, 9, [10, 11]), ("o1", 2, 11, 3, [10, 11]), ("o2", 3, 12, 1, [12])], "offset string, row long, candidate long, score long, tied array<long>")
    candidates = spark.createDataFrame([("o1", 10, "p"), ("o1", 11, "q"), ("o2", 12, None)], "offset string, candidate long, parent string")
    out = resolve.attach(assigned, candidates, "offset")
    assert {r.row: (r.strong, r.full, r.other_parents) for r in out.collect()} == {1: (True, True, ["q"]), 2: (False, False, ["p"]), 3: (False, True, [])}
    counted = out.withColumn("is_root_main", F.col("row") == 1)
    assert resolve.check_attached(counted, 5, True) == {"matched": 3, "strong": 1, "offsets": 2, "unmatched": 2}
    for rows_, root in ((counted.where(F.lit(False)), False), (counted.withColumn("is_root_main", F.lit(False)), True)):
        with pytest.raises(ValueError):
            resolve.check_attached(rows_, 5, root)


def test_consuming_pairs(spark):
    debug = spark.createDataFrame([("a", 1, "getter"), ("a", 2, "regular"), ("a", 3, "regular"), ("b", 1, "regular")], "k string, n long, kind string")
    snapshot = spark.createDataFrame([("a", 10, "regular"), ("a", 11, "getter"), ("c", 12, "regular")], "k string, n long, kind string")
    got = {(r.k, r.n): r.taken for r in resolve.consuming_pair(debug, snapshot, "k", "n", "kind").collect()}
    assert got == {("a", 1): 11, ("a", 2): 10, ("a", 3): None, ("b", 1): None}
    other = spark.createDataFrame([("a", 10, "setter"), ("a", 11, "regular")], "k string, n long, kind string")
    assert [r.taken for r in resolve.consuming_pair(debug, other, "k", "n", "kind").where("k = 'a'").orderBy("n").collect()] == [10, 11, None]


def test_same_declarations(spark):
    names = ["kind", "library_uri", "owner", "name", "function_kind", "vm_object_id", "snapshot_reference", "fixed", "optional", "named", "types", "place"]
    schema = ", ".join(f"{s}_{n} {t}" for s in "ab" for n, t in zip(names, ["string"] * 5 + ["long", "long", "long", "long", "boolean", "string", "string"], strict=True))
    base = ("function", "l", "O", "m", "regular", 7, -1, 1, 0, False, "int", "f:1")
    change = lambda row, **k: tuple(k.get(n, v) for n, v in zip(names, row, strict=True))
    snap = change(base, vm_object_id=None, snapshot_reference=5)
    cases = [
        (base, base, True), (base, change(base, vm_object_id=8), False), (base, snap, True), (base, change(snap, types="num"), False), (base, change(snap, place="f:2"), False), (base, change(snap, place=None, types=None), True),
        (change(base, snapshot_reference=3), snap, False), (change(base, name="anonymous closure"), change(snap, name="anonymous closure", types=None), False), (change(base, function_kind="getter"), snap, False), (change(base, fixed=None), snap, True), (snap, change(snap, snapshot_reference=6), False),
        (change(base, kind="class", function_kind=None), change(snap, kind="class"), True), (change(base, owner=None), change(snap, owner=None), True),
    ]
    df = spark.createDataFrame([(*a, *b) for a, b, _ in cases], schema)
    side = lambda s: {n: F.col(f"{s}_{n}") for n in names}
    assert [r.x for r in df.select(resolve.same_declaration(side("a"), side("b")).alias("x")).collect()] == [w for *_, w in cases]


def test_hypotheses(spark):
    df = spark.createDataFrame([("g", 1, 0, 3, "a"), ("g", 2, 0, 3, "b"), ("g", 3, 1, 9, "c"), ("h", 1, 0, 2, "a"), ("h", 2, 0, 1, "b")], "g string, h long, c long, e long, v string")
    assert rows(resolve.hypothesis_vote(df, "g", "h", "c", "e", "v")) == [("g", 2, None), ("h", 1, "a")]


def test_closure_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 1)], "src long, dst long")
    got = set(map(tuple, graph.transitive_closure(e).collect()))
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 1), (5, 2), (5, 3), (5, 5)}


def test_label_propagation_blocks_on_unknown_callers(spark):
    e = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d"), ("x", "d"), ("c", "e"), ("e", "e"), ("a", "f"), ("z", "f")], "caller string, callee string")
    s = spark.createDataFrame([("a", "L"), ("b", "L"), ("z", "M")], "node string, label string")
    assert {r.node: r.label for r in graph.label_propagation(e, s).collect()} == {"a": "L", "b": "L", "z": "M", "c": "L", "e": "L"}


def test_bounded_bfs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    root = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.bounded_bfs(e, root, 2)) == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.bounded_bfs(e, root, 9, 2)) == [(1, 0), (2, 1)]


def test_dominators(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 2, 4), ("g", 3, 4), ("g", 4, 5)], "graph string, src long, dst long")
    assert {r.node: r.dominators for r in graph.dominators(e).collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 4], 5: [1, 4, 5]}


def test_branch_joins(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 1, 3), ("g", 2, 4), ("g", 3, 4), ("g", 4, 5), ("g", 4, 6), ("g", 5, None), ("g", 6, None), ("h", 1, 2), ("h", 1, 3), ("h", 2, 3), ("h", 3, None)], "graph string, src long, dst long")
    assert {(r.graph, r.node): r.joined for r in graph.branch_joins(e).collect()} == {("g", 1): 4, ("g", 4): None, ("h", 1): 3}


def test_arity_and_arguments(spark):
    assert [one(spark, X.top_level_arity, v) for v in ("a", "a,b", "Map<a,b>,c", "a<b", "a>,<b")] == [1, 2, 2, None, None]
    df = spark.createDataFrame([(["null", "1", "null", "x", "null"], ["a", "b"]), (["null"], ["a"])], "v array<string>, n array<string>")
    assert [r.x for r in df.select(X.named_arguments(F.col("v"), F.col("n")).alias("x")).collect()] == [["a: 1", "b: null", "x"], []]


def test_double_bits(spark):
    df = spark.createDataFrame([(0x3FF8000000000000,), (None,), (-(1 << 63),)], "b long")
    assert [r.d for r in df.select(kernels.double_from_bits("b").alias("d")).collect()] == [1.5, None, -0.0]


@pytest.mark.parametrize("function, value, want", [
    (X.hex_parse, "0xff", 255), (X.hex_parse, "zz", None), (X.hex_parse, "ffffffffffffffff", (1 << 64) - 1), (X.strip_key, "_a@12.b", "_a.b"), (X.strip_key, "::", ""), (X.canonical_type, " List < int > ??", "List<int>"),
    (X.type_root, "Map<a>?", "Map"), (X.package_of, "package:x/y.dart", "x"), (X.package_of, "dart:core", None), (X.ident_clean, "", "_"), (X.ident_clean, "1a", "_1a"), (X.ident_clean, "if", "_if"), (X.ident_clean, "a-b$", "a_b$"),
    (X.last_segment, "a.b.c", "c"), (X.is_identifier, "_x@9", True), (X.is_identifier, "9x", False), (X.is_human_string, "https://x.y", True), (X.is_human_string, "dart:core x", False), (X.is_human_string, "file: a b", True), (X.escape_text, "a'\n$\\\x01", "a\\'\\n\\$\\\\?"),
    (X.extract_uri, "see package:a/b.dart!", "package:a/b.dart"), (X.output_path, "dart:core", "dart/core.dart"), (X.text_score, "aaaa", None), (X.abbreviate, "x" * 161, "x" * 160 + "…"),
])
def test_text(spark, function, value, want):
    assert one(spark, function, value) == want
    assert function not in (X.hex_parse, X.type_root, X.canonical_type) or one(spark, function, None) is None


def test_token_replace_keeps_longer_words(spark):
    assert one(spark, lambda c: X.token_replace(c, "ab", "Z"), "ab abc _ab ab.ab") == "Z abc _ab Z.Z"


def test_bytes(spark):
    assert one(spark, lambda c: X.hex_decode(c).cast("string"), "6161626263636464") == "aabbccdd" and one(spark, X.hex_decode, "6161") is None
    assert one(spark, lambda c: X.base64_decode(c).cast("string"), "aGVsbG8gMQ==") == "hello 1" and one(spark, X.base64_decode, "camelCase") is None and one(spark, X.base64_decode, "camelCaseWords") is None


def test_kernels(spark):
    assert kernels.fnv1a(b"") == 0xCBF29CE484222325 and kernels.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert kernels.fold_hashed([b"a", b"b"]) == kernels.fold_hashed([b"b", b"a"]) != kernels.fold_hashed([b"a", b"b", b"b"])
    assert kernels.scramble(0) == 0 and kernels.fold_hashed([]) == 0xCBF29CE484222325
    assert kernels.read_varint(b"\xe5\x8e\x26") == (624485, 3) and kernels.read_signed_varint(b"\x7f") == (-1, 1)
    secret = b"a secret message in plain words"
    assert kernels.best_xor(bytes(b ^ 90 for b in secret)) == (90, secret.decode())
    assert ("hello world text", "hex -> utf8", "high") in kernels.recover(b"hello world text".hex().encode())
    assert ("hello gzip text", "gzip -> utf8", "high") in kernels.recover(kernels.pack_gzip("hello gzip text"), typed=True)
    df = spark.createDataFrame([(bytearray(b"\xe5\x8e\x26\x01"),), (bytearray(b"\x80"),), (None,)], "b binary")
    assert [r.v for r in df.select(kernels.varints("b").alias("v")).collect()] == [[624485, 1], None, None]
    assert df.select(kernels.fnv1a_64("b").alias("h")).first().h == kernels.fnv1a(b"\xe5\x8e\x26\x01")


FUNCTION = "name string, owner string, library_uri string, address string, size long, kind string, instructions array<struct<mnemonic:string,object_pool_value:string>>, semantic_statements array<struct<kind:string>>, control_flow array<struct<`from`:string,`to`:string,kind:string>>"


def body(name, address, library="dart:core", mnemonics=("mov", "addeq", "ldr", "ret"), constants=(None, None, None, None), size=16, owner=None, base=0):
    flow = [(hex(base + 8), hex(base + 12), "jump"), (hex(base + 4), hex(base + 8), "fall")]
    return (name, owner, library, address, size, "f", list(zip(mnemonics, constants, strict=True)), [("call",)], flow)


def test_match(spark):
    target = spark.createDataFrame([body("sub_1", "0x10", base=16), body("kept", "0x20", size=20), body("other", "0x30", size=24), body("twice", "0x40", size=28), body("twice2", "0x44", size=28), body("short", "0x50", mnemonics=("a", "b", "c"), constants=(None,) * 3)], FUNCTION)
    reference = spark.createDataFrame([body("add", "0x1", mnemonics=("mov", "addne", "ldr", "ret"), base=64), body("kept", "0x2", size=20), body("name", "0x3", size=24), body("twice", "0x4", size=28), body("short", "0x5", mnemonics=("a", "b", "c"), constants=(None,) * 3), body("app", "0x6", library="package:app/x.dart", size=99)], FUNCTION)
    got = {r.target_address: r.reference_name for r in match.match(target, reference).collect()}
    assert got == {"0x10": "add", "0x20": "kept"}
    report = match.match_report(target, reference).first()
    assert (report.contradictory_names, report.ambiguous, report.unique_reference) == (1, 1, 4)


def test_match_drops_disagreeing_aliases(spark):
    target = spark.createDataFrame([body("sub_1", "0x10"), body("sub_2", "0x10", size=20)], FUNCTION)
    reference = spark.createDataFrame([body("a", "0x1"), body("b", "0x2", size=20)], FUNCTION)
    assert match.match(target, reference).count() == 0


def test_trace_gate_fails_closed(spark, tmp_path):
    from factweave.sources.documents import read_trace

    (tmp_path / "t.json").write_text('{"schema": "trace/v1", "snapshot_hash": "h", "dispatch_targets": [{"selector_index": 1, "target_offset": 9, "hit_count": 2}, {"selector_index": 1, "target_offset": 4, "hit_count": 2}], "argument_descriptors": [{"callee_offset": 3, "positional_count": 1, "named_names": ["a"], "hit_count": 2}, {"callee_offset": 3, "positional_count": 4, "hit_count": 1}]}')
    good = read_trace(spark, str(tmp_path), "trace/v1", "h")
    best = trace.dominant_targets(good).first()
    assert (best.target_offset, best.targets) == (4, [4, 9])
    assert tuple(trace.arity(good).first()) == (3, 4, 3, "inferred") and trace.shapes(good).count() == 2 and trace.hot_bodies(good).count() == 0
    for schema, snapshot in (("trace/v2", "h"), ("trace/v1", "other")):
        with pytest.raises(Exception, match="trace"):
            trace.dominant_targets(read_trace(spark, str(tmp_path), schema, snapshot)).collect()


def test_observations(spark):
    schema = "abi string, library_uri string, owner string, member string, lexical_index long, parent_lexical long, ambiguous_abi string, constants array<long>, callees array<string>, pool_identities array<string>"
    def row(abi, member, constants, callees=()):
        return (abi, None, None, member, 0, None, None, list(constants), list(callees), [])
    data = [row(a, "agree", c) for a, c in (("x", [1, 2]), ("y", [2, 1]), ("z", [1, 2]))] + [row(a, "more", c) for a, c in (("x", [1]), ("y", [1, 1]), ("z", [1]))] + [row("x", "alone", [1])] + [row(a, "empty", []) for a in "xyz"]
    got = {r.member: (r.state, r.tier) for r in observations.reach_consensus(spark.createDataFrame(data, schema), 3).collect()}
    assert got == {"agree": ("corroborated", "cross_abi_corroborated"), "more": ("disputed", "inferred"), "alone": ("unaligned", "inferred"), "empty": ("unsupported", "inferred")}


def test_hashes_bit_by_bit():
    import random

    rng = random.Random(1)
    values = [bytes(rng.randbytes(rng.randint(0, 30))) for _ in range(200)]
    assert kernels.fnv1a_many(values).tolist() == [kernels.fnv1a(v) for v in values]
    assert kernels.fnv1a_many([]).tolist() == []

    def plain_scramble(x):
        x = x * 0x9E3779B97F4A7C15 % 2**64
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64
        return x ^ x >> 32

    def plain_fold(items):
        state = 0xCBF29CE484222325
        for h in sorted(map(kernels.fnv1a, items)):
            for k in range(8):
                state = (state ^ (h >> 8 * k & 255)) * 0x100000001B3 % 2**64
        return state ^ plain_scramble(len(items))

    for n in (0, 1, 2, 7):
        assert kernels.fold_hashed(values[:n]) == plain_fold(values[:n])


def test_snapshot_numbers(spark):
    assert kernels.read_unsigned(b"\x80") == (0, 1) and kernels.read_unsigned(b"\x05\x81") == (133, 2)
    assert kernels.read_tagged32(b"\xc0") == (0, 1) and kernels.read_tagged32(b"\xbf") == ((1 << 32) - 1, 1) and kernels.read_tagged64(b"\xbf") == (-1, 1)
    assert kernels.read_tagged64(b"\x05\xc1") == (133, 2) and kernels.read_reference(b"\x81") == (1, 1) and kernels.read_reference(b"\x01\x81") == (129, 2)
    df = spark.createDataFrame([(bytearray(b"\x80\x05\x81"),), (bytearray(b"\x05"),), (bytearray(b"\x01" * 12),), (None,)], "b binary")
    assert [r.v for r in df.select(kernels.numbers_of(kernels.read_unsigned)("b").alias("v")).collect()] == [[0, 133], None, None, None]


@pytest.mark.parametrize("data, typed, want", [
    (b"aHR0cHM6Ly9leGFtcGxlLmludmFsaWQvYXBp", False, ("https://example.invalid/api", "base64 -> utf8", "high")),
    (bytes(b ^ 0x5A for b in b"service endpoint disabled"), True, ("service endpoint disabled", "xor(key=0x5a) -> utf8", "medium")),
    ("typed data recovery message".encode("utf-16-le"), True, ("typed data recovery message", "utf16le", "high")),
    (b"hex recovery message".hex().encode(), False, ("hex recovery message", "hex -> utf8", "high")),
    (__import__("zlib").compress(b"zlib recovery message"), True, ("zlib recovery message", "zlib -> utf8", "high")),
    (kernels.pack_gzip("compressed recovery message"), True, ("compressed recovery message", "gzip -> utf8", "high")),
])
def test_hidden_texts(data, typed, want):
    assert want in kernels.recover(data, typed)


def test_what_is_no_hidden_text():
    assert kernels.recover(bytes(range(256)), typed=True) == []
    assert kernels.recover(b"ordinary service error message") == []
    assert kernels.recover(b"ordinary typed data message", typed=True) == [("ordinary typed data message", "utf8", "high")]
    assert kernels.from_base64(b"YWJjZA==") == b"abcd"
    assert [kernels.from_base64(x) for x in (b"invalid=", b"didGainFocus", b"version_name", b"YWJjZB==")] == [None] * 4


def test_text_scores_agree(spark):
    texts = ["https://example.invalid/api", "ordinary text", "aaaa bbbb", "abcd", "abcde", "a b c d e f", "{json: 1}", "lib/src/a.dart", "user@host.org", "x\x01yzabc", "üben macht Spaß", "\ufffd text here", "word " * 40, "abc" * 30, "12345678", "tokens 12 34", "the ✓ sign is no text", "日本語の文字です", "a\tb\nc defg", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(X.text_score("t").alias("s")).collect()] == [kernels.score(t) for t in texts]
    assert kernels.score("https://example.invalid/api") == 20 + 2 + 5 + 18 + 10 and kernels.score("ordinary text") == 12 + 2 + 2 + 5 and kernels.score("abcd") is None


@pytest.mark.parametrize("path, package, root, want", [
    ("/home/me/app/lib/main.dart", "app", None, "package:app/main.dart"), ("C:\\src\\app\\lib\\a\\b.dart", "app", None, "package:app/a/b.dart"), ("/b/lib/x.dart", "app", "/b/lib", "package:app/x.dart"),
    ("/f/packages/flutter/lib/src/w.dart", "app", None, "package:flutter/src/w.dart"), ("/x/sdk/lib/core/list.dart", None, None, "dart:core"), ("/x/dart-sdk/lib/io/file.dart", None, None, "dart:io"),
    ("/c/hosted/pub.dev/my-pkg-1.2.3/lib/src/a.dart", None, None, "package:my-pkg/src/a.dart"), ("/c/pub.dev/pkg/lib/a.dart", None, None, "package:pkg/a.dart"), ("/c/pub.dev/pkg-1/bin/a.dart", None, None, None),
    ("/app/lib/app/lib/z.dart", "app", None, "package:app/z.dart"), ("/elsewhere/z.dart", "app", None, None), ("/a/sdk/lib/", None, None, None),
])
def test_library_address_of_a_path(spark, path, package, root, want):
    assert one(spark, lambda c: X.path_to_uri(c, package, root), path) == want


def test_roots_of_paths(spark):
    assert one(spark, X.lib_root, "/a/my_app/lib/src/lib/x.dart") == "/a/my_app/lib/src/lib" and one(spark, X.lib_root, "/a/x.dart") is None
    assert [one(spark, X.lib_root_package, v) for v in ("/a/my_app/lib", "/a/My/lib", "/a/9a/lib")] == ["my_app", None, None]


@pytest.mark.parametrize("uri, application, want", [
    ("package:app/src/a b.dart", "app", "src/a_b.dart"), ("package:other/x", "app", "packages/other/x.dart"), ("package:other/../x.y", None, "packages/other/x.y"), ("dart:core", "app", "dart/core.dart"), ("dart:_internal/list.dart", None, "dart/_internal/list.dart"),
])
def test_output_paths(spark, uri, application, want):
    assert one(spark, lambda c: X.output_path(c, application), uri) == want


def test_output_path_of_other_addresses(spark):
    import hashlib

    for uri in ("package:bare", "zQ", "file:///x.dart"):
        assert one(spark, X.output_path, uri) == f"recovered_{hashlib.sha256(uri.encode()).hexdigest()[:12]}.dart"


@pytest.mark.parametrize("function, value, want", [
    (X.extract_uri, "junk package:app/main.dartZ", "package:app/main.dart"), (X.extract_uri, "dart:core/duration.dart", "dart:core/duration.dart"), (X.extract_uri, "package:a b/x.dart", None), (X.extract_uri, "https://x/y.dart", None), (X.extract_uri, "package:app/main", None),
    (X.sanitize_path, "./a/../b c", "a/b_c.dart"), (X.sanitize_path, "a/.hidden", "a/.hidden.dart"), (X.sanitize_path, "a/x.y", "a/x.y"), (X.sanitize_path, "", ""),
    (X.clean_symbol, "<name>@12", "name"), (X.lower_camel, "__FooBar", "fooBar"), (X.lower_camel, "", "value"), (X.lower_camel, "_1", "_1"), (X.lower_camel, "Abc", "abc"),
    (X.looks_like_class, "__Foo", True), (X.looks_like_class, "foo", False), (X.is_enum_member, "a$1", True), (X.is_enum_member, "1a", False), (X.is_enum_member, "$a", False), (X.is_opaque_identity, "0x12", True), (X.is_opaque_identity, "Name", False),
    (X.is_meaningful_target, "AllocateObject", False), (X.is_meaningful_target, "foo", True), (X.is_runtime_helper, "stub call", True), (X.is_runtime_helper, "_vm_stub_x", True), (X.is_runtime_helper, "x stub", False), (X.is_internal_target, "dart:core", True),
    (X.negate_condition, "a == b", "a != b"), (X.negate_condition, "!(x)", "x"), (X.negate_condition, "!(a) && (b)", "!(!(a) && (b))"), (X.negate_condition, "a <= b", "a > b"), (X.negate_condition, "a < b == c", "a < b != c"), (X.negate_condition, "flag", "!(flag)"),
    (X.strip_parentheses, "(a + (b))", "a + (b)"), (X.strip_parentheses, "(a) + (b)", "(a) + (b)"), (X.strip_parentheses, "a", "a"),
    (X.is_identifier, "<a.b>@1", True), (X.name_kind, "x=", "setter"), (X.name_kind, "x==", "regular"), (X.name_kind, "a.<anonymous closure>", "closure"),
])
def test_text_rules(spark, function, value, want):
    assert one(spark, function, value) == want


def test_debug_names(spark):
    got = [tuple(one(spark, X.split_name, v)) for v in ("new Foo.named", "new Foo", "Foo.bar", "foo.bar", "_Foo.x.y", "Foo.v=")]
    assert got == [("Foo", "named", "constructor"), ("Foo", "constructor", "constructor"), ("Foo", "bar", "regular"), ("::", "foo.bar", "regular"), ("_Foo", "x.y", "regular"), ("Foo", "v=", "setter")]


def test_index_expressions(spark):
    df = spark.createDataFrame([(v,) for v in ("list[i + 1]", "a[b][c]", "a[(b[c])]", "List<[x]", "x", "a['k']", "[x]", None)], "v string")
    got = [r.x and tuple(r.x) for r in df.select(X.split_index("v").alias("x")).collect()]
    assert got == [("list", "i + 1"), ("a[b]", "c"), ("a", "(b[c])"), None, None, None, None, None]


def test_import_prefix_makes_room(spark):
    keep = "import 'x' as aot;\naot.call();"
    assert one(spark, X.rename_prefix, keep) == keep
    assert one(spark, X.rename_prefix, "import 'x' as aot;\naot.call(); int aot = 1;") == "import 'x' as aot_;\naot_.call(); int aot = 1;"
    assert one(spark, X.rename_prefix, "as aot; aot.f(aot_); aot(); $aot.x") == "as aot__; aot__.f(aot_); aot(); $aot.x"


def test_restored_names(spark):
    names = {"a": "Controller", "b": "build"}
    assert one(spark, lambda c: X.token_map(c, names), "a") == "Controller"
    assert one(spark, lambda c: X.token_map(c, names), "a.b.<anonymous closure>") == "Controller.build.<anonymous closure>"
    assert one(spark, lambda c: X.token_map(c, names), "ab a_ $a (b)") == "ab a_ $a (build)"


def elements(*values):
    return [("integer", v, None) if isinstance(v, int) else ("null", None, None) if v is None else ("string", None, v) for v in values]


@pytest.mark.parametrize("values, want", [
    ((1, 2, 2, 2, None), (1, 2, 2, 2, [])), ((0, 4, 4, 2, "a", 3, "z", 2, None), (0, 4, 4, 2, [("a", 3), ("z", 2)])), ((0, 2, 2, 2), None), ((0, 3, 3, 2, "a", 0, None), None), ((0, 3, 3, 2, "a", 3, None), None), ((0, 4, 4, 2, "a", 3, "b", 3, None), None),
    ((0, 3, 3, 2, "", 2, None), None), ((0, 2, 2, 2, 7), None), ((-1, 2, 2, 2, None), None), ((0, 1, 1, 2, None), None), ((), None), ((0, 0, 0, 0, None), (0, 0, 0, 0, [])),
])
def test_argument_descriptors(spark, values, want):
    df = spark.createDataFrame([(elements(*values),)], f"e array<struct<{X.ELEMENT.replace(' ', ':')}>>".replace(",:", ","))
    got = df.select(X.decode_arguments(F.col("e")).alias("x")).first().x
    assert (got and (*got[:4], [tuple(n) for n in got.named])) == want
    if want:
        back = df.select(X.parse_arguments_label(X.arguments_label(X.decode_arguments(F.col("e")))).alias("x")).first().x
        assert (back.type_args, back["count"], back.size, back.positional, [tuple(n) for n in back.named]) == (want[0], want[1], want[1], want[3], want[4])


def test_argument_labels(spark):
    parse = lambda v: one(spark, X.parse_arguments_label, v)
    got = parse('dynamicCall("a, b", typeArgs=0, count=2, positional=1, named=["x"@1])')
    assert (got.positional, [tuple(n) for n in got.named]) == (1, [("x", 1)])
    assert [parse(v) for v in ("other(typeArgs=0, count=1, positional=1)", "argsDescriptor(typeArgs=0, count=1)", 'argsDescriptor(typeArgs=0, count=2, positional=1, named=[x@1])')] == [None] * 3


def test_ownership(spark):
    short = [(f"x{k}",) for k in range(12)]
    flag = lambda rows, app=None: aggregates.ownership(spark.createDataFrame(rows, "uri string"), "uri", app).first()
    assert flag(short + short).obfuscated and flag(short).compact == 12
    assert not flag(short[:7]).obfuscated and not flag(short + [(f"dart:{k}",) for k in range(6)]).obfuscated
    long = [(f"a-long-name-{k}",) for k in range(12)]
    assert not flag(long).obfuscated and not flag(long + [("package:app/a.dart",)]).obfuscated and flag(long + [("package:app/a.dart",)], "app").obfuscated


def test_scopes(spark):
    df = spark.createDataFrame([("package:app/a",), ("package:flutter/a",), ("package:b/a",), ("package:app",), ("dart:core",), (None,)], "u string")
    strict = lambda scope, app=None: [r.x for r in df.select(X.in_scope("u", scope, app).alias("x")).collect()]
    library = lambda scope, app=None: [r.x for r in df.select(X.library_in_scope("u", scope, app).alias("x")).collect()]
    assert strict("all") == [True] * 6 and strict("packages") == [True, False, True, True, False, False] and strict("app", "app") == [True] + [False] * 5 and strict("app") == [False] * 6
    assert library("packages") == [True, False, True, True, False, False] and library("app", "app") == [True, False, False, True, False, False] and library("app") == [False] * 6
    scopes = [r.x for r in df.select(X.target_scope("u", "app", F.lit("stub x")).alias("x")).collect()]
    assert scopes == ["application", "flutter_sdk", "package", "package", "dart_sdk", "runtime"]


def test_kinds_and_static_bits(spark):
    df = spark.createDataFrame([(0, None), (5, None), (8, None), (32 + 3, None), (64 + 3, None), (17, None)], "tag long, x string").withColumn("kind", X.function_kind("tag"))
    assert [r.kind for r in df.collect()] == ["regular", "constructor", "implicit_static_getter", "getter", "getter", None]
    assert [r.s for r in df.select(X.is_static("tag", "kind", 6).alias("s")).collect()] == [False, False, True, False, True, False]
    assert [r.s for r in df.select(X.is_static("tag", "kind", None).alias("s")).collect()] == [None, False, True, None, None, None]


def test_paths_stay_unique(spark):
    rows_ = [("a/x", k, k == 3) for k in range(6)] + [("A/X", 9, False), ("b", 10, False)]
    df = spark.createDataFrame(rows_, "path string, id long, own boolean")
    got = {r.id: r.unique_path for r in ordered.unique_paths(df, "path", "id", F.col("own"), (0, 1, 2, 64)).collect()}
    assert got[3] == "a/x" and got[10] == "b" and len({v.lower() for v in got.values()}) == 8 and got[0] == "a/x."
    assert len(got[1]) in (5, 6)


def test_overlays_and_promotions(spark):
    base, over = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "z"), (2, "b"), (3, ""), (4, None)], "k long, v string")
    assert rows(joins.overlay_missing(base, over, "k", "v")) == [(1, "a"), (2, "b")]
    calls = spark.createDataFrame([("f", "0x1", "x()"), ("f", "0x2", "y()"), ("g", "0x1", "z()")], "caller string, address string, expression string")
    recovered = spark.createDataFrame([("f", "0x1", "A.m", 1), ("f", "0x1", "A.n", 2), ("f", "0x2", "dispatch 7", 1), ("g", "0x1", "B.m", 1)], "caller string, address string, target string, place long")
    homes = spark.createDataFrame([("A.n", "package:app/a.dart"), ("B.m", "dart:core"), ("B.m", "dart:io")], "target string, library_uri string")
    got = joins.promote_indirect(calls, recovered, homes, lambda u, t: X.target_scope(u, "app", t))
    assert rows(got.drop("expression")) == sorted([("f", "0x1", "A.n", "package:app/a.dart", "application"), ("f", "0x2", None, None, None), ("g", "0x1", "B.m", None, "unknown")], key=str)


def test_stub_targets(spark):
    calls = spark.createDataFrame([(1, "sub_110"), (2, "sub_120"), (3, "sub_130"), (4, "name"), (5, "sub_zz"), (6, None)], "id long, target string")
    stubs = spark.createDataFrame([(16, "NullErrorStub"), (32, "Allocate")], "offset long, name string")
    assert rows(joins.relabel_stubs(calls, stubs, 256)) == sorted([(2, "Allocate"), (3, "sub_130"), (4, "name"), (5, "sub_zz"), (6, None)], key=str)


def test_exact_fields(spark):
    slots = spark.createDataFrame([("A", None, 8), ("A", "l", 8), ("B", "l", 16)], "class_name string, library_uri string, offset long")
    fields = spark.createDataFrame([("A", None, 8, "x", "int"), ("B", "l", 16, "y", None), ("B", "l", 16, "z", None)], "class_name string, library_uri string, offset long, field string, field_type string")
    assert rows(joins.field_layout(slots, fields)) == sorted([("A", None, 8, "x", "int"), ("A", "l", 8, None, None), ("B", "l", 16, None, None)], key=str)


@pytest.mark.parametrize("value, step, want", [(0, 8, 0), (1, 8, 8), (8, 8, 8), (17, 16, 32)])
def test_alignment(spark, value, step, want):
    assert spark.range(1).select(X.round_up(F.lit(value).cast("long"), step).alias("x")).first().x == want


def test_latin1(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xe9"),), (None,)], "b binary")
    assert [r.x for r in df.select(X.latin1("b").alias("x")).collect()] == ["café", None]


def test_coverage_and_histograms(spark):
    df = spark.createDataFrame([("0x1", 4, 2, "a", True), ("0x1", 4, 1, "b", False), ("0x2", 4, 3, None, True)], "address string, size long, n long, kind string, ok boolean")
    row = aggregates.coverage(df, ["address", "size"], ["n"], {"ok": F.col("ok"), "named": F.col("kind").isNotNull()}).first().asDict()
    assert row == {"logical_rows": 3, "physical_rows": 2, "ok": 2, "ok_physical": 1, "named": 2, "named_physical": 1}
    assert rows(aggregates.histograms(df, {"kind": F.col("kind"), "size": F.col("size")})) == [("kind", "a", 1), ("kind", "b", 1), ("size", "4", 3)]


def test_solved_signatures(spark):
    calls = spark.createDataFrame([("k", 2, 1, 0, ["x"]), ("k", 3, 2, 1, ["y", "x"]), ("k", None, None, None, None), ("m", None, None, None, None), ("n", 1, 1, 0, [])], "k string, count long, positional long, type_args long, named array<string>")
    known = spark.createDataFrame([("m", "retained_runtime_signature", 2), ("n", "retained_runtime_signature", 1), ("n", "vm_oracle", 3), ("z", "vm_oracle", 0)], "k string, authority string, fixed long")
    got = {r.k: (r.authority, r.fixed, r.counts, r.positional_at_most, r.capacity_at_least, r.named, r.type_args, r.needs, r.calls, r.tier) for r in aggregates.solve_signatures(calls, known, "k").collect()}
    assert got["k"] == (None, None, [2, 3], 1, 3, ["x", "y"], [0, 1], None, 3, "inferred")
    assert got["m"][:2] == ("retained_runtime_signature", 2) and got["n"][:2] == ("vm_oracle", 3) and got["z"][:2] == ("vm_oracle", 0) and got["z"][-1] == "proven" and got["m"][-1] == "proven"


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_places_of_hot_keys_across_ranges(spark, size, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", size)
    df = spark.createDataFrame([("hot", k) for k in range(9)] + [(None, 3), (None, 1), ("a", 5)], "k string, n long")
    got = {(r.k, r.n): r.place for r in ordered.place_in_group(df, ["k"], ["n"], "place").collect()}
    assert got == {("hot", k): k + 1 for k in range(9)} | {(None, 1): 1, (None, 3): 2, ("a", 5): 1}
    names = {r.n: r.unique_name for r in ordered.collision_suffix(df.where("k = 'hot'"), "k", ["n"]).collect()}
    assert names == {0: "hot"} | {k: f"hot_{k + 1}" for k in range(1, 9)}


def test_body_bindings(spark):
    from factweave.operators import bodies

    static = spark.createDataFrame([(16, 0, 8), (16, 1, 8), (32, 2, 4)], "body long, object long, size long")
    oracle = spark.createDataFrame([(100, 16, 8), (101, 16, 12), (102, 32, None), (103, 99, 4), (104, None, 4)], "object long, offset long, size long")
    found = bodies.body_bindings(static, oracle)
    got = {(r.source, r.object): (r.body, r.relation, r.conflict) for r in found.collect()}
    assert got == {("static", 0): (16, "exact", False), ("static", 1): (16, "exact", False), ("static", 2): (32, "exact", False), ("oracle", 100): (16, "exact", False), ("oracle", 101): (16, "same_start_different_end", True), ("oracle", 102): (32, "unknown", False)}
    assert bodies.binding_report(found, oracle).first().asDict() == {"bodies": 2, "occurrences": 7, "bindings": 6, "unbound_oracle": 3, "shared": 2, "conflicts": 1, "disjoint": 0}


def test_labels_of_aliases_and_selectors(spark):
    from factweave.operators import bodies

    df = spark.createDataFrame([(1, "a", "l1", 2), (1, "a", "l2", 5), (1, "a", None, 9), (2, "a", "l", 1), (2, "b", "l", 1), (3, "c", None, 1), (4, "d", "y", 3), (4, "d", "x", 3)], "k long, label string, library string, p int")
    assert rows(bodies.alias_labels(df, "k", "label", "library", F.col("p"))) == sorted([(1, "a", "l2"), (3, "c", None), (4, "d", "x")], key=str)
    calls = spark.createDataFrame([(1, "A.m"), (1, "B.m"), (2, "A.m"), (2, "A.m"), (3, "A.m"), (3, "B.n"), (4, "sub_1"), (4, "sub_1"), (5, "x.sub_1"), (5, "y.sub_1")], "k long, t string")
    assert rows(bodies.proven_selectors(calls, "k", "t")) == [(1, "m")]
    one_row = spark.createDataFrame([(3, None, ["b", "a", None, "b"])], "n int, m int, t array<string>")
    assert one_row.select(bodies.control_flow_fingerprint(F.col("n"), F.col("m"), F.lit(1), F.lit(2), F.col("t")).alias("f")).first().f == "3;0;1;2;a,b"


def test_nested_strings(spark):
    from factweave.operators import bodies

    nodes = spark.createDataFrame([(1, "array", None, [2, 3, 4, -1]), (2, "string", "two", []), (3, "instance", None, [5, 1]), (4, "class", None, [6]), (5, "record", None, [7, 8]), (6, "string", "hidden", []), (7, "string", "bad\x01", []), (8, "string", "eight", []), (9, "string", "root", [])], "node long, kind string, text string, refs array<long>")
    roots = spark.createDataFrame([(1,), (3,), (9,), (77,)], "root long")
    assert {r.root: r.texts for r in bodies.nested_strings(roots, nodes).collect()} == {1: ["eight", "two"], 3: ["eight", "two"], 9: ["root"]}
    assert {r.root: r.texts for r in bodies.nested_strings(roots, nodes, depth=1).collect()} == {1: ["two"], 9: ["root"]}
    assert {r.root: r.texts for r in bodies.nested_strings(roots, nodes, most_nodes=3, most_strings=1).collect()} == {1: ["two"], 9: ["root"]}


def test_constants_as_source(spark):
    from factweave.functions import constants

    def node(n, kind, number=None, real=None, text=None, member=None, arguments=None, refs=None, keys=None, types=None):
        return ("g", n, kind, number, real, text, member, arguments, refs, keys, types)

    nodes = [
        node(1, "list", arguments="<int>", refs=[2, 3, 1]), node(2, "int", 7), node(3, "null"), node(4, "map", refs=[]), node(5, "map", arguments="<String, List<int>>", refs=[6, 1]), node(6, "string", text="a'$"), node(7, "record", 0, refs=[2]), node(8, "record", 5, refs=[2]),
        node(9, "enum", text="Color@12", member="red"), node(10, "instance", text="P@3", refs=[2, 42, 99], keys=["x", "y", "z"], types=[None, "unboxed:int", None]), node(11, "closure", text="main.<anonymous closure>"), node(12, "closure"), node(13, "type", text="int?"), node(14, "type", text="List<int>"),
        node(15, "double", real=1.0), node(16, "bool", 1), node(17, "list", refs=[2] * 30), node(18, "set", refs=[18]), *[node(20 + k, "list", refs=[21 + k]) for k in range(6)],
    ]
    want = {
        1: "const <int>[7, null, aot.snapshotRef(1)]", 4: "const <dynamic, dynamic>{}", 5: "const <String, List<int>>{'a\\'\\$': const <int>[7, null, aot.snapshotRef(1)]}", 7: "(7,)", 8: "aot.snapshotRef(8)", 9: "Color.red", 10: "aot.constObject('P', <String, Object?>{'x': 7, 'y': 42, 'z': aot.snapshotRef(99)})",
        11: "aot.constClosure('main.<anonymous closure>')", 12: "aot.snapshotRef(12)", 13: "int", 14: "aot.constType('List<int>')", 15: "1.0", 16: "true", 17: "const [" + "7, " * 24 + "/* 6 more */]", 18: "const {aot.snapshotRef(18)}", 20: "const [const [const [const [aot.snapshotRef(24)]]]]", 77: None,
    }
    df = spark.createDataFrame(nodes, f"graph string, {constants.NODE}")
    roots = spark.createDataFrame([("g", k) for k in want], "graph string, root long")
    assert {r.root: r.text for r in constants.render_constants(df, roots, "graph").collect()} == want
    assert [constants.type_prefix(a, n) for a, n in (("<String, List<String>>", 2), ("<String, List<String>", 2), ("<a,b>", 1), (None, 1))] == ["<String, List<String>>", "", "", ""]
    assert constants.unboxed_text(0x3FF8000000000000, None) == "1.5" and constants.unboxed_text(0x3FF8000000000000, "double?") == "1.5" and constants.unboxed_text(-(1 << 62), None) == "-2.0" and constants.unboxed_text(0x7FF8000000000001, None) == "aot.unboxedBits(0x7ff8000000000001)"
