"""Suffix dedup against brute force over all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from factweave.llm import suffix_dedup as sd


def plain(rows, length=200):
    seen = Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        seen.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        spans = int(np.diff(gone.astype(int), prepend=0).clip(0).sum())
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted(seed=1, n=120):
    """Texts that share passages with small edits, cut ends, repeats within themselves, and runs of one letter."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé ", k=rng.randint(1, 8))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=rng.randint(20, 140))) for _ in range(8)]
    out = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            passage = rng.choice(passages)
            if kind < 0.5:
                a = rng.randint(0, 60)
                passage = passage[a : a + rng.randint(150, 500)]
                if rng.random() < 0.4 and passage:
                    k = rng.randrange(len(passage))
                    passage = passage[:k] + "#" + passage[k + 1 :]
                text += passage
            elif kind < 0.6:
                text += rng.choice("xy") * rng.randint(150, 450)
            else:
                text += " ".join(rng.choices(words, k=rng.randint(1, 60)))
        out.append((i, text))
    return out


@pytest.mark.parametrize("crowded", [8192, 2, 0])
def test_planted(spark, crowded):
    rows = planted()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, sd.suffix_digests(frame, crowded=crowded).collect()), key=str) == plain(rows)


def test_parts_follow_the_bytes(spark, monkeypatch):
    rows = planted(5, 200)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(sd, "PART_BYTES", 20_000)
    own = frame.selectExpr("xxhash64(doc_id) AS d1", "doc_id AS d2", "text")
    found = sd.repeated_spans(own)
    assert found.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, sd.suffix_digests(frame).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_tables(table, request):
    docs = request.getfixturevalue(table)
    got = sorted(map(tuple, sd.suffix_digests(docs).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("length", [12, 31])
def test_short_lengths_and_small_blocks(spark, monkeypatch, length):
    rows = [(i, t[:400]) for i, t in planted(7, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.suffix_digests(frame, length=length).collect()), key=str) == plain(rows, length)


def test_blocks_do_not_matter(monkeypatch):
    data = b"".join(t.encode() for _, t in planted(3, 60))
    ends = np.array([1000, 1000, 5000, len(data)])
    whole = sd.Anchors().of(np.frombuffer(data, np.uint8), ends)
    own = sd.Anchors()
    monkeypatch.setattr(sd, "BLOCK", 700)
    for a, b in zip(whole, own.of(np.frombuffer(data, np.uint8), ends), strict=True):
        assert a.tolist() == b.tolist()


def test_loser_tree_merges_with_prefixes():
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(500)]
    runs = [sorted(strings[k::7]) for k in range(7)]

    def coded(run):
        before = b""
        for x in run:
            yield x, sd.common_prefix(before, x), None
            before = x

    got = list(sd.LoserTree([coded(r) for r in runs]))
    assert [x for x, _, _ in got] == sorted(strings)
    assert all(k == sd.common_prefix(a[0], b) for a, (b, k, _) in zip(got, got[1:], strict=False))


def test_run_roundtrip():
    entries = sorted([(b"abcd", b"x", [(0, 5, 1, 0)]), (b"abce", b"xy", [(1, 7, 2, 1), (0, 9, 1, 1)]), (b"b", b"", [(0, 1, 0, 0)])])
    back = list(sd.read_run(sd.write_run(np.array([[1, 2], [3, 4]]), entries)))
    assert [(r, left, [tuple(o) for o in own.tolist()]) for r, _, (left, _, own) in back] == entries
