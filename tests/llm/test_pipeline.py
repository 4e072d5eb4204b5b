"""The pipeline's stages against plain Python, and near copies against exact similarity."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import bpe, simhash, vocab
from factweave.llm.staging import BATCH_BYTES, small_batches, stage


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(800)]
    rows, group = [], {}
    for g in range(25):
        base = rng.choices(words, k=rng.randint(60, 400))
        for c in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.004, 0.01, 0.015]))):
                own[rng.randrange(len(own))] = rng.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own)))
    crowd = rng.choices(words, k=300)
    for _ in range(150):
        own = list(crowd)
        own[rng.randrange(300)] = rng.choice(words)
        group[len(rows)] = 99
        rows.append((len(rows), " ".join(own)))
    return rows, group


def test_near_copies_meet(spark, copies):
    rows, group = copies
    found = {r.id: r.component for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    members = defaultdict(list)
    for i, g in group.items():
        members[g].append(i)
    missed = asked = 0
    for own in members.values():
        for a in own:
            for b in own:
                if a < b and similarity(sets[a], sets[b]) >= 0.87:  # well above the threshold: least hashes estimate it
                    asked += 1
                    missed += found[a] != found[b]
    assert asked > 5000 and missed == 0
    roots = {}
    for i, c in found.items():
        assert roots.setdefault(c, group[i]) == group[i]  # no two groups merge
        assert c <= i


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    kept = [(r.doc_id, r.text) for r in simhash.drop_similar(odd_docs).collect()]
    assert (5, "word") in kept and (6, "word") not in kept and (None, "null key") in kept
    assert simhash.drop_similar(no_docs).count() == 0


def test_stages(spark):
    from conftest import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encoding"]
    counts = [docs.count()]
    own = bpe.ByteBpe(vocab.path("byte_bpe_50k.json"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = stage(function(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.round_trip and r.token_ids == own.encode(texts[r.doc_id]).tolist() and r.n_tokens == len(r.token_ids) for r in rows)


def batches_of(docs):
    """Rows and bytes of each batch that Python is handed."""

    def measure(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["rows", "bytes"])

    return docs.mapInArrow(measure, "rows bigint, bytes bigint").collect()


@pytest.mark.parametrize("name", ["identify_languages", "dedup_documents", "decontaminate", "encode"])
def test_stages_with_workers_take_small_batches(spark, docs, no_docs, name):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    wide = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    held = spark.conf.get(limit)
    try:
        spark.conf.unset(limit)
        getattr(corpus_pipeline, name)(spark, docs if name == "identify_languages" else no_docs, "/root/testdata/sf0.001")
        found = batches_of(wide)
        assert sum(x.rows for x in found) == 4000
        assert max(x.bytes for x in found) < 1.2 * BATCH_BYTES

        spark.conf.set(limit, "1m")
        small_batches(spark)
        assert max(x.bytes for x in batches_of(wide)) < 1.2 * (1 << 20)
    finally:
        spark.conf.set(limit, held)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs):
    from conftest import SF

    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        for _, function in corpus_pipeline.STAGES:
            out = function(spark, docs, SF)
            assert out.count() <= docs.count()


def exact_groups(rows):
    """Least key of each row's group over pairs of similarity 0.8 or more, by all pairs."""
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if root(a) != root(b) and similarity(sets[a], sets[b]) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted((i, least[root(k)]) for k, (i, _) in enumerate(rows))


def groups_found(spark, rows, **options):
    return sorted((r.id, r.component) for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect())


def edited(rng, base, edits):
    own = list(base)
    for at in rng.sample(range(len(own) // 10), edits):
        own[at * 10 + 5] = f"new{rng.random()}"
    return " ".join(own)


def test_simhash_groups_alone(spark, monkeypatch):
    """Without blocks of least hashes, the stage still joins near copies whose fingerprints differ in two bits or fewer, and drops them."""
    from xxhash import xxh64_intdigest

    rng = random.Random(21)
    rows = []
    for _ in range(40):
        base = [f"w{rng.random()}" for _ in range(1500)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, edited(rng, base, 1))]

    def plain(text):
        hashes = [xxh64_intdigest(b" ".join(x), 42) for x in shingles(text)]
        return sum((2 * sum(h >> k & 1 for h in hashes) > len(hashes)) << k for k in range(64))

    prints = [plain(t) for _, t in rows]
    near = [k for k in range(0, len(rows), 2) if (prints[k] ^ prints[k + 1]).bit_count() <= 2]
    assert 10 < len(near) < 40
    monkeypatch.setattr(simhash, "_blocks_met", lambda heads: heads.sparkSession.createDataFrame([], "block long, node long, n long"))
    assert groups_found(spark, rows) == [(k, k - 1 if k - 1 in near else k) for k, _ in rows]
    kept = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, _ in rows if k - 1 not in near]


def test_simhash_groups_are_held_against_their_sets(spark, monkeypatch):
    """One fingerprint for all texts: they are one SimHash group, and only similar sets join."""
    rng = random.Random(22)
    rows = [(k, " ".join(f"w{rng.random()}" for _ in range(60))) for k in range(6)]
    rows += [(6, rows[0][1] + " more"), (7, rows[3][1] + " more")]
    monkeypatch.setattr(simhash, "linked_classes", lambda classes, most_bits=2: classes.select("fp", "least", F.lit(0).cast("long").alias("component")))
    assert groups_found(spark, rows) == exact_groups(rows)


def test_crowd_near_only_to_its_base(spark):
    rng = random.Random(3)
    base = [f"w{rng.random()}" for _ in range(400)]
    rows = [(k, edited(rng, base, 6)) for k in range(2000)]
    rows[1234] = (1234, " ".join(base))
    assert 0.85 < similarity(shingles(rows[0][1]), shingles(rows[1234][1])) and similarity(shingles(rows[0][1]), shingles(rows[1][1])) < 0.8
    assert {c for _, c in groups_found(spark, rows)} == {0}


def test_crowds_are_compared_in_full(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.random()}" for _ in range(400)]
    other = edited(rng, base, 9).split()  # too far from the base, but under the same blocks
    rows = [(k, edited(rng, base if k % 2 else other, rng.choice([2, 6, 8]))) for k in range(300)]
    rows += [(300, " ".join(base)), (301, " ".join(other))]
    rows = [(k, t) for k, (_, t) in enumerate(rng.sample(rows, len(rows)))]
    want = exact_groups(rows)
    assert len({c for _, c in want}) > 1
    for pairwise in (2, 8, 64, 1 << 30):
        assert groups_found(spark, rows, pairwise=pairwise) == want
    monkeypatch.setattr(simhash, "TILE", 40)
    monkeypatch.setattr(simhash, "FEW", 7)
    assert groups_found(spark, rows, pairwise=8) == want


def test_similarity_is_exact_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(150):
        base = [f"w{rng.random()}" for _ in range(1000)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, edited(rng, base, rng.choice([19, 21, 22, 23, 24])))]
    assert groups_found(spark, rows) == exact_groups(rows)


def test_repeated_passages_and_repeated_keys(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(40):
        base = [f"w{rng.random()}" for _ in range(300)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + base[40:60] * 50))]
    assert groups_found(spark, rows) == exact_groups(rows)
    one, two = ([f"{x}{rng.random()}" for _ in range(300)] for x in "xy")
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, edited(rng, one, 2)), (3, edited(rng, two, 2))]
    assert {c for _, c in groups_found(spark, rows)} == {1}


def plain_language(model, texts):
    """Whether each text has a language that explains it with a score of 0.5 or more, by sums over all cuts of its words."""
    import re

    import numpy as np

    numbers, longest = {p: n + 2 for n, p in enumerate(model.pieces)}, max(map(len, model.pieces))
    known = {}

    def logs(word):
        if word not in known:
            ahead = [np.zeros(len(model.langs))]
            for end in range(1, len(word) + 1):
                ways = [(start, numbers.get(word[start:end], 1 if end - start == 1 else None)) for start in range(max(0, end - longest), end)]
                ahead.append(np.logaddexp.reduce([ahead[start] + np.log(model.chances[piece]) for start, piece in ways if piece is not None]))
            known[word] = ahead[-1]
        return known[word]

    out = []
    for text in texts:
        words = ["".join(c for c in w if c.isalpha()) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        rows = [logs("▁" + w) for w in words if w]
        total = np.sum(rows, axis=0) if rows else None
        out.append(total is not None and 1 / np.exp(total - total.max()).sum() >= 0.5)
    return out


def plain_lines_kept(rows):
    import re

    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    gone = lambda i, line: len(holders.get(key(line), ())) >= 5 and i != max(holders[key(line)])
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in rows]


def test_run_against_plain_python(spark):
    import re

    from conftest import SF
    from test_filters import plain_match
    from tokenizers import Tokenizer

    from factweave.llm import langid

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    about = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    kept = plain_language(langid.fit(docs, vocab.path("piece_bpe_32k.model")), [t for _, t in rows])
    rows = plain_lines_kept([r for r, k in zip(rows, kept, strict=True) if k])
    group = dict(exact_groups(rows))
    rows = [(i, t) for i, t in rows if group[i] == i]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    item_words = [(x, words(x)) for x in items]
    rows = [(i, t) for i, t in rows if not any(len(w & words(t)) >= 3 and plain_match(x, t) for x, w in item_words)]
    library = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.token_ids for i, r in got.items()} == want and 100 < len(want) < docs.count()
    assert all((r.lang, r.source) == about[i] and r.round_trip and r.n_tokens == len(want[i]) for i, r in got.items())


def test_recall_at_the_threshold(spark):
    """Pairs of similarity 0.8 to 0.87 at all lengths: what least hashes lose before the sets are compared."""
    rng = random.Random(13)
    rows, asked = [], []
    for n in [60, 120, 250, 500, 1000] * 60:
        base = [f"w{rng.random()}" for _ in range(n)]
        own = list(base)
        edits = max(1, round(n * rng.uniform(0.014, 0.0225)))
        for at in rng.sample(range(n // 10), min(edits, n // 10)):
            own[at * 10 + 5] = f"new{rng.random()}"
        if 0.8 <= similarity(shingles(" ".join(base)), shingles(" ".join(own))) < 0.87:
            asked.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(own))]
    found = dict(groups_found(spark, rows))
    met = sum(found[a] == found[b] for a, b in asked)
    assert len(asked) > 100 and met >= 0.99 * len(asked)
