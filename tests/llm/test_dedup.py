"""Line dedup and SimHash against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import components, line_dedup, simhash


def plain_lines(rows, min_docs=5):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return re.sub("[A-Z]", lambda m: m[0].lower(), line)

    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40 and i is not None:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_line_dedup(table, request):
    docs = request.getfixturevalue(table)
    out = line_dedup.line_dedup(docs.withColumn("_n_lines", F.lit("x")).withColumn("_N_DROPPED", F.lit("y")))
    assert out.columns == [*docs.columns, "_n_lines", "_N_DROPPED", "_n_lines_", "_n_dropped_"]
    assert {(r[0], r[1]) for r in out.select("_n_lines", "_N_DROPPED").collect()} <= {("x", "y")}  # the caller's own data
    got = [(r.doc_id, r._n_lines_, r._n_dropped_, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()]
    want = plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(got, key=str) == want
    if table == "odd_docs":
        assert sum(r[2] for r in want) == 6


def plain_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_simhash(table, request):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    fps = sorted({f for _, f in rows})
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for i, f in rows:
        least[root[f]] += [i] if i is not None else []
    want = sorted(((i, f, min(least[root[f]], default=None)) for i, f in rows), key=str)
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("pairwise", [128, 3])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_keep_every_connection(spark, bits, pairwise):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = {0, (1 << 64) - 1}
    for x in base:  # chains of near fingerprints, and crowds that share blocks
        for _ in range(40):
            fps.add(x)
            for b in rng.integers(0, 64, rng.integers(0, 3)):
                x ^= 1 << int(b)
        fps |= {base[0] ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 64, (30, 2))}
    fps = sorted(fps)
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= bits])
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bits, pairwise).collect()
    assert all(((r.u ^ r.v) & ((1 << 64) - 1)).bit_count() <= bits for r in edges)
    assert roots(fps, [(r.u % (1 << 64), r.v % (1 << 64)) for r in edges]) == root


def test_fingerprint_of_many_shingles(monkeypatch):
    text = " ".join(f"w{k % 977}" for k in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "STEP", 257)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (180, 2))] + [(1000 + k, 1001 + k) for k in range(100)] + [(2000, 2001 + k) for k in range(100)] + [(7, 7)]
    edges = spark.createDataFrame(pairs, "u long, v long")
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == roots(nodes, [p for p in pairs if p[0] != p[1]])
    assert components.connected_components(edges.where(F.lit(False))).count() == 0
