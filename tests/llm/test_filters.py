"""Decontamination, license scans and language ID against plain Python and planted cases."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import decontamination as dc
from factweave.llm import langid, licenses, vocab

ITEMS = [
    (1, "What is the total price of 12 apples at 3 dollars each if Anna pays with 50 dollars at the market today?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards brew a strange green potion near an old mill"),
    (3, "short item of five words"),
    (4, "tiny one"),
    (5, None),
    (6, "the quick brown fox jumps over the lazy dog while seven wizards brew a strange green potion near an old mill"),
    (7, ""),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, doc_id string")


def found(spark, items, texts):
    docs = spark.createDataFrame([(k, t, "d") for k, t in enumerate(texts)], "doc_id long, text string, item_id string")
    return {(r.doc, r.item): r for r in dc.contaminated(docs, items).collect()}


def test_planted_items(spark, items):
    filler = "some other words stand here before and after the passage without meaning anything at all"
    got = found(spark, items, [
        f"{filler}. {ITEMS[0][1]} {filler}",  # 0: verbatim
        f"{filler}. {ITEMS[0][1].replace('12', '45').replace('3 dollars', '7 euros').replace('50 dollars', '90 euros').replace('Anna', 'Bob')}",  # 1: other values
        f"{filler}. {ITEMS[0][1].replace('apples', 'pears').replace('total', 'whole').replace('pays', 'went').replace('market', 'shop')}",  # 2: other words
        f"{filler}\n{ITEMS[1][1].upper()}\n{filler}",  # 3: other case
        f"{ITEMS[1][1][:60]} {filler}",  # 4: too little of it
        f"we saw a {ITEMS[2][1]} there",  # 5: short item
        "tiny one",  # 6: too short an item
        None, "", filler,
    ])
    assert {k for k in got} == {(0, 1), (1, 1), (3, 2), (5, 3)}
    assert got[0, 1].verbatim and not got[1, 1].verbatim


def test_inconsistent_values_are_no_match(spark, items):
    item = "If Anna has 5 pens and 5 books and 5 cups then Anna gives 5 of them away to 5 friends in school"
    own = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item.replace("5", "8")), (2, "If Anna has 1 pens and 2 books and 3 cups then Anna gives 4 of them away to 9 friends in school")], "doc_id long, text string")
    assert [r.doc for r in dc.contaminated(docs, own).collect()] == [1]


def plain_tokens(text):
    """(kind, value, opens) of each token, read one by one: kinds are word, num, unit, Name."""
    out, opens = [], True
    for part in re.findall(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n\r]", text or ""):
        if part in ".!?\n\r":
            opens = opens or bool(out)
            continue
        low = part.lower()
        if part[0].isdecimal():
            kind = "num"
        elif out and out[-1][0] == "num" and not opens and low in dc.UNITS:
            kind = "unit"
        elif out and out[-1][0] == "num" and low in dc.UNITS:
            kind = "unit"
        else:
            kind = "Name" if part[0].isupper() and not part.isupper() else "word"
        out.append((kind, low, opens))
        opens = False
    return out


def plain_readings(text):
    """Three lists of (template token, value or None): openers as words, openers as names, all literal."""
    tokens = plain_tokens(text)
    out = []
    for named in (False, True):
        own = []
        for kind, low, opens in tokens:
            if kind == "Name" and (named or not opens):
                if own and own[-1][0] == "<name>" and not opens:
                    continue
                own.append(("<name>", low))
            else:
                own.append((f"<{kind}>", low) if kind in ("num", "unit") else (low, None))
        out.append(own)
    return [*out, [(low, None) for _, low, _ in tokens]]


def plain_windows(own, size):
    """place -> (template window, values); a window grows until it has four words."""
    out = {}
    for s in range(len(own)):
        for e in range(s + size, len(own) + 1):
            literal = all(v is None for _, v in own[s:e])
            if literal or sum(v is None for _, v in own[s:e]) >= 4:
                out[s] = (tuple(t for t, _ in own[s:e]), [(t, v) for t, v in own[s:e] if v is not None])
                break
    return out


def plain_match(item, text):
    """Whether an item stands in a text, by the definition of windows, alignments and consistent values. All in plain Python."""
    views = plain_readings(item)
    size = 8 if len(views[2]) >= 8 else 5
    for own, other in zip(views, plain_readings(text), strict=True):
        mine, theirs = plain_windows(own, size), plain_windows(other, size)
        need = min(dc.ENOUGH, -(-len(mine) // 2))
        places = {}
        for d, (window, values) in theirs.items():
            places.setdefault(window, []).append((d, values))
        hits = [(d - i, i, pairs) for i, (window, values) in mine.items() for d, found in places.get(window, []) for pairs in [list(zip(values, found, strict=True))]]
        for width, offset in ((1, 0), (2 * dc.DRIFT + 1, dc.DRIFT), (2 * dc.DRIFT + 1, 2 * dc.DRIFT)):
            runs = {}
            for shift, i, pairs in hits:
                runs.setdefault((shift + offset) // width, []).append((i, pairs))
            for run in runs.values():
                pairs = {p for _, own_pairs in run for p in own_pairs}
                if len({i for i, _ in run}) >= need and len({a for a, _ in pairs}) == len(pairs):
                    return True
    return False


def test_against_brute_force(spark, docs):
    from conftest import SF

    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(b.item_id, b.text) for b in benchmark.collect()]
    words = {i: set(re.findall(r"\w+", (t or "").lower())) for i, t in texts.items()}
    want = {(i, k) for k, own in items for i, t in texts.items() if len(set(re.findall(r"\w+", own.lower())) & words[i]) >= 3 and plain_match(own, t)}
    got = {(r.doc, r.item) for r in dc.contaminated(docs, benchmark).collect()}
    assert got == want and got


def test_against_brute_force_with_new_values(spark):
    import random

    rng = random.Random(12)
    names = ["Anna", "Bob", "Carla", "Dan", "Eve", "New York", "Rio"]
    frames = [
        "{n} has {a} apples and {b} pears. {m} takes {a} of them to the market. How many are left for {n}?", "If {n} runs {a} km in {b} minutes, how fast does {m} run {c} km in {b} minutes?",
        "Add {a}, {b}, {c}, {a}, {b} and then multiply by {c}, {a}, {b}. Which of {a} {b} {c} is the largest number now?", "the old mill by the river grinds corn for the village every day of the week",
        "{n} {a} {b} {c} {m} {a} {b} {c}", "Is {a} less than {b}?",
    ]
    fill = lambda f: f.format(n=rng.choice(names), m=rng.choice(names), a=rng.randint(2, 99), b=rng.randint(2, 99), c=rng.randint(2, 99))
    items = [(k, fill(frames[k % len(frames)])) for k in range(18)]
    texts = []
    for _ in range(150):
        own = fill(rng.choice(frames))
        if rng.random() < 0.3:
            parts = own.split()
            parts[rng.randrange(len(parts))] = rng.choice(["other", "7", "Zoe", "words here"])
            own = " ".join(parts)
        texts.append(rng.choice(["", "We ask. ", "some words before "]) + own + rng.choice(["", " And more", ". 5 7 9"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc, r.item) for r in dc.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    least = {own: k for k, own in reversed(items)}  # items that repeat have their least id
    want = {(i, k) for i, t in enumerate(texts) for own, k in least.items() if plain_match(own, t)}
    assert got == want and len(got) > 100


def test_dense_items_meet_with_new_values(spark):
    item = "Add 3 4 5 6 7 8 9 to 10 11 12 and then divide 13 14 15 by 16 17 to find which of 18 19 20 21 is right"
    again = re.sub(r"\d+", lambda m: str(int(m[0]) + 70), item)
    assert holds(spark, item, [f"we ask: {again} now", again.replace("divide", "split").replace("find", "see").replace("right", "left")]) == {0: False}


def test_windows_do_not_depend_on_segments(monkeypatch, docs):
    texts = [r.text for r in docs.limit(20).collect()]
    windows = lambda t: [dc.window_hashes(tokens, slots, doc, 8)[0].tolist() for _, tokens, slots, _, doc in dc.Templates().readings_of([t])]
    whole = [windows(t) for t in texts]
    together = dc.Templates().readings_of(texts)
    assert [sorted(dc.window_hashes(tokens, slots, doc, 8)[0].tolist()) for _, tokens, slots, _, doc in together] == [sorted(h for t in texts for r, *view in dc.Templates().readings_of([t]) if r == own for h in dc.window_hashes(view[0], view[1], view[3], 8)[0].tolist()) for own, *_ in together]
    monkeypatch.setattr(dc, "SEGMENT_CHARS", 50)
    assert [windows(t) for t in texts] == whole


def test_drop_contaminated(spark, items, odd_docs, no_docs):
    assert dc.drop_contaminated(odd_docs.withColumnRenamed("words", "_found"), items).count() == odd_docs.count()
    assert dc.drop_contaminated(no_docs, items).count() == 0
    assert dc.contaminated(odd_docs, items.where(F.lit(False))).count() == 0


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["odd_docs", "docs", "no_docs"])
def test_license_base(table, request):
    docs = request.getfixturevalue(table)
    rows = licenses.license_scan(docs).collect()
    want = sorted(((r.doc_id, *plain_base(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=str) == want
    for r in rows:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def plain_rules(text):
    """Detections of all rules on one text, suppressed pair by pair."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    if not re.search(licenses.PREFILTER.replace("\\x{10FFFF}", "\U0010ffff").replace("\\u0080", "\x80"), (text or "").lower()):
        return set()
    words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)) + " "
    every = []
    for rule, label, keyword, expression, priority, _ in licenses.rules():
        if " " + keyword in words:
            every += [(m.start(), m.end(), priority, rule, label) for m in re.finditer(f"(?<= )(?:{expression})(?= )", words)]
    keep = set()
    for a in every:
        if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and (b[:3] != a[:3] and (b[1] - b[0] > a[1] - a[0] or b[2] > a[2]) or b[:3] == a[:3] and b[3] < a[3]) for b in every):
            keep.add(a[4])
    return keep


def test_license_rules(spark):
    texts = [
        "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0",
        "Released under the MIT License.", "available under the terms of the Mozilla Public License 2.0 or the BSD 3-Clause license", "nothing of the kind", "Subject to the Apache License, Version 2.0 and the zlib license",
        "License: MIT License: MIT\nLicensed under the Apache License, Version 2.0; released under the MIT license", "permit the licensee", None,
    ]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = set(plain_base(t)[4].split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == plain_rules(t) | base, t
    assert got[0].labels == "cc-by-nc,cc-by-nc-sa" and got[0].base_labels == "cc-by-nc"  # the base label stands though the longer name suppresses its rule
    assert got[2].labels == "gpl-3" and got[3].labels == "apache-2" and got[6].labels == "" and got[6].score == 0


def test_rules_are_many_and_compile():
    rows = licenses.rules()
    assert len(rows) >= 600 and len(licenses._notices()) >= 170 and len({r[3] for r in rows}) == len(rows)
    assert all(re.compile(r[3]) and " " not in r[2] for r in rows)


@pytest.fixture(scope="module")
def model(docs):
    return langid.fit(docs, vocab.path("piece_bpe_32k.model"))


def test_forward_sums_all_segmentations(model):
    lattice = langid.Lattice(model.pieces)
    numbers = {p: n + 2 for n, p in enumerate(model.pieces)}

    def plain(word, k):
        if not word:
            return 1.0
        total = 0.0
        for size in range(1, min(len(word), lattice.longest) + 1):
            piece = numbers.get(word[:size], 1 if size == 1 else None)
            if piece is not None:
                total += model.chances[piece, k] * plain(word[size:], k)
        return total

    for word in ["▁the", "▁und", "▁él中é", "▁a"]:
        got = langid.forward(lattice.find([word]), model.chances)[-1][0]
        assert np.allclose(got, [plain(word, k) for k in range(len(model.langs))])


def test_chances_are_probabilities(model):
    assert np.allclose(model.chances.sum(axis=0), 1) and (model.chances[0] == 0).all() and (model.chances >= 0).all()


def test_all_letter_pieces_of_the_vocabulary_count(model):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=vocab.path("piece_bpe_32k.model"))
    pieces = {own.id_to_piece(i) for i in range(own.get_piece_size())}
    assert set(model.pieces) - {"▁"} == {x for x in pieces if x.removeprefix("▁").isalpha() and x == x.lower()} - {"▁"}


def plain_log(model, word):
    """Log-probability of a marked word by language: sums over all cuts with exact fractions of integers."""
    from fractions import Fraction

    numbers = {p: n + 2 for n, p in enumerate(model.pieces)}
    out = []
    for k in range(len(model.langs)):
        ahead = [Fraction(1)]
        for end in range(1, len(word) + 1):
            total = Fraction(0)
            for start in range(max(0, end - 40), end):
                piece = numbers.get(word[start:end], 1 if end - start == 1 else None)
                if piece is not None:
                    total += ahead[start] * Fraction(model.chances[piece, k])
            ahead.append(total)
        top = ahead[-1]
        shift = top.denominator.bit_length() - top.numerator.bit_length()
        out.append(np.log(float(top * 2**shift)) - shift * np.log(2))
    return out


def test_words_of_any_length_are_one_lattice(model, monkeypatch):
    words = ["straße" * 3, "internationalization" * 5, "x" * 90, "unbelievablé" * 12]
    scorer = langid.Scorer(model)
    for step in (langid.STEP, 17):
        monkeypatch.setattr(langid, "STEP", step)
        for word in words:
            want = plain_log(model, "▁" + word)
            assert np.allclose(scorer.totals(iter([word]))[0][:-1], want, rtol=1e-9)
            assert np.allclose(langid.forward_log(scorer.lattice, "▁" + word, scorer.logs), want, rtol=1e-9)
            scorer._forget()


def test_long_words_are_learned_alike(model, monkeypatch):
    counts = {"a": {"wonderful" * 3: 5, "word": 9}, "b": {"wunderbar" * 4: 2, "wort": 3}}
    plain = langid.SegmentModel.fit(model.pieces, counts).chances
    monkeypatch.setattr(langid, "DECADES", 0)
    assert np.allclose(plain, langid.SegmentModel.fit(model.pieces, counts).chances)


def test_scores_stay_numbers(spark, model):
    heavy = langid.SegmentModel.fit(model.pieces, {"a": {"the": 10**13}, "b": {"und": 10**13}})
    docs = spark.createDataFrame([(1, "中é" * 40), (2, "the " * 900), (3, "q" * 300_000)], "doc_id long, text string")
    rows = langid.predict(docs, heavy).collect()
    assert all(0 <= r.score <= 1 and r.lang_pred in "ab" for r in rows)


def test_prediction_reads_the_text_alone(spark, docs, model):
    few = docs.limit(40)
    other = few.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("elsewhere").alias("source"))
    a, b = ({r.doc_id % 1_000_000: (r.lang_pred, r.score) for r in langid.predict(x, model).collect()} for x in (few, other))
    assert a == b


def test_nothing_is_learned_from_the_held_out_third(spark, docs, model):
    import zlib

    marked = docs.withColumn("text", F.when(langid.held_out(F.col("doc_id")), F.lit("zzz qqq " * 50)).otherwise(F.col("text"))).withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    again = langid.fit(marked, vocab.path("piece_bpe_32k.model"))
    assert again.langs == model.langs and np.array_equal(again.chances, model.chances)
    rows = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_held_out_accuracy(docs, model):
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out(F.col("doc_id"))).collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(known) > 30 and sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known)


def test_odd_texts(odd_docs, no_docs, model):
    rows = langid.predict(odd_docs, model).collect()
    texts = odd_docs.select("text").collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    by_text = dict(zip([t.text for t in texts], rows, strict=True))
    for t in (None, "", " ", "12345 !!! ...", "²½Ⅷ"):
        assert by_text[t].lang_pred == "und" and by_text[t].score == 0
    assert langid.predict(no_docs, model).count() == 0
    kept = langid.keep_identified(odd_docs, model)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < len(rows)


def test_no_labels(odd_docs):
    empty = langid.fit(odd_docs.withColumn("lang", F.lit(None).cast("string")), vocab.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in langid.predict(odd_docs, empty).collect()} == {"und"}


def test_long_words_and_segments(model, monkeypatch):
    one = langid.Scorer(model).totals(iter(["une longue phrase " * 30, "x" * 500]))
    monkeypatch.setattr(langid, "SEGMENT_CHARS", 40)
    assert np.allclose(one, langid.Scorer(model).totals(iter(["une longue phrase " * 30, "x" * 500])))


def holds(spark, item, texts):
    own = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r.doc: r.verbatim for r in dc.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), own).collect()}


def test_names_that_open_sentences(spark):
    item = "Tom has 5 apples. Ann buys 3 more. Tom eats 2 of them. How many are left?"
    got = holds(spark, item, [
        "Some words. " + item.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "9").replace("3", "4"),
        "Some words. " + item.replace("Tom", "Bob Jones").replace("Ann", "Eve").replace("5", "9"),
        "Some words. Bob has 5 apples. Eve buys 3 more. Sue eats 2 of them. How many are left?",  # one name became two
        "Tom sees 5 pears. Ann sold 3 more. Tom hid 2 in there. How often did they fall?",
    ])
    assert got == {0: False, 1: False}


def test_names_of_more_words(spark):
    item = ITEMS[0][1]
    got = holds(spark, item, [f"we read: {item.replace('Anna', 'Maria Smith Jones').replace('12', '45')}", item.replace("12 apples", "1 200 apples").replace("Anna", "Bob")])
    assert got == {0: False, 1: False}


@pytest.mark.parametrize("item", ["What is 3 + 5 + 7 + 9 + 11 + 13?", "Add 3 4 and 5 6", "When Anna Met Bob And Carl Near Dora Or Emil By Fritz Ulm", "then Anna saw Bob and Carl and Dora and Emil and Fritz in Ulm"])
def test_dense_items_match_word_for_word(spark, item):
    filler = "some other words stand here"
    assert holds(spark, item, [f"{filler} {item} {filler}", f"{filler} {item.lower()} {filler}", f"{filler}\n{item.upper()}", filler]) == {0: True, 1: True, 2: True}


def samples(expression):
    """Texts that match an expression: each alternative, and each optional part once with and once without."""
    from itertools import islice, product
    from re import _constants as c, _parser

    def walk(tree):
        parts = []
        for op, arg in tree:
            if op is c.LITERAL:
                parts.append([chr(arg)])
            elif op is c.NOT_LITERAL:
                parts.append(["q"])
            elif op is c.IN:
                first = arg[0]
                parts.append(["3" if first[0] is c.CATEGORY else chr(first[1][0] if first[0] is c.RANGE else first[1])])
            elif op is c.BRANCH:
                parts.append([x for branch in arg[1] for x in walk(branch)])
            elif op is c.SUBPATTERN:
                parts.append(walk(arg[3]))
            elif op is c.MAX_REPEAT:
                parts.append([*([""] if arg[0] == 0 else []), *[x * max(1, arg[0]) for x in walk(arg[2])]])
            else:
                raise ValueError(op)
        return ["".join(x) for x in islice(product(*parts), 400)]

    return walk(_parser.parse(expression))


def test_notices_are_found(spark):
    texts = {
        "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2,gpl-2-or-later", "see https://www.gnu.org/licenses/lgpl-3.0.html": "lgpl-3", "<https://creativecommons.org/licenses/by-nc-sa/4.0/>": "cc-by-nc-sa",
        "MIT OR Apache-2.0": "mit-or-apache-2", 'MODULE_LICENSE("Dual BSD/GPL")': "bsd-or-gpl", "Apache-2.0 WITH LLVM-exception": "llvm-exception", "GPL-2.0-only WITH Classpath-exception-2.0": "gpl-2-classpath",
        "the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl-2-or-later",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.": "zlib", "This file is in the public domain.": "public-domain",
        "we may use the files only with care": "", "This is a book of songs": "",
    }
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).collect()}
    assert got == texts
    for text in texts:
        assert plain_rules(text) == set(got[text].split(",")) - {""}


def test_no_gate_stops_what_a_rule_matches():
    gate = re.compile(licenses.PREFILTER.replace("\\x{10FFFF}", "\U0010ffff").replace("\\u0080", "\x80"))
    for _, label, keyword, expression, _, _ in licenses.rules():
        for text in samples(expression):
            assert re.fullmatch(expression, text), (expression, text)
            assert f" {keyword}" in f" {text} ", (label, keyword, text)
            assert gate.search(text) and gate.search(text.replace(" ", " \n-")), (label, text)


def test_names_and_bodies_that_gates_or_rules_missed(spark):
    texts = {
        "licensed under the Common Development and Distribution License": "cddl", "SPDX-License-Identifier: BSL-1.0": "boost", "released under the FreeBSD license": "bsd-2-clause", "SPDX-License-Identifier: 0BSD": "0bsd",
        "Creative Commons Attribution 4.0": "cc-by", "subject\n  to the zlib terms": "zlib",
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "isc",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    }
    got = {r.doc_id: r.labels for r in licenses.license_scan(spark.createDataFrame([(t, t) for t in texts], "doc_id string, text string")).collect()}
    assert got == texts
