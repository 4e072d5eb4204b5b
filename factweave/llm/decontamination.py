"""Benchmark decontamination by template windows.

Texts and benchmark items become sequences of template tokens: numbers turn into <num>, a unit after a number into
<unit>, capitalised words (not those in capitals) into one <name> for neighbours, any other word into itself in lower case. A
capitalised word that opens a sentence may be a name or not, so a text has two such readings; a third one is literal, with all
tokens in lower case. Windows of eight tokens are hashed; items of five to seven tokens use windows of five. A template window
that holds fewer than four words goes on until it has four, however many numbers and names stand between them, so texts
dense in placeholders have windows like any other; literal windows need no words. Document windows pass a bitmap of the benchmark's hashes, which
has a fixed size however long the benchmark is, and what passes is hash-joined with the benchmark's windows.

Windows of one document, item and reading with one alignment belong together, also where the alignment moves a little.
A document is contaminated if enough literal windows agree, or if enough templates agree and the item's values (the first
word of a name) map to the document's values consistently, which is what a question with new numbers or names looks like.

Defined cases: a null or empty text or item has no tokens and meets nothing; an item of fewer than five tokens is too
short to be told from chance and meets nothing; an item of fewer than four words besides numbers and names meets only its
own words, as no template tells it from chance; ties of an item's texts and items that repeat are reported by their least id; repeated rows give
repeated results only once; empty tables give an empty result; other columns are ignored. Long texts are cut into tokens
in segments; their windows are those of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import PieceNumbers, RaggedPool, byte_groups, kept, texts_of
from .staging import free_name, stage
from .token_counts import _ANY_WHITE, segments

WINDOW, SHORT_WINDOW = 8, 5
#: Windows that have to agree along one alignment, or half of the item's if that is fewer.
ENOUGH = 6
#: Words that a template window holds at least; it grows until it does.
LEAST_WORDS = 4
#: Places by which an alignment may move within one run.
DRIFT = 2
#: Readings of a text: sentence openers as words, as names, and all tokens as they stand.
PLAIN, NAMED, LITERAL = 0, 1, 2
BITMAP_BITS = 1 << 24
REMEMBERED = 200_000
#: Bytes of text that are read at once.
GROUP_BYTES = 1 << 19
SEGMENT_CHARS = 1 << 20

#: Words that are units when they follow a number.
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg t gram grams kilogram kilograms ton tons lb lbs oz pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ms hz khz mhz ghz w kw v a j n pa c f k percent degrees degree dollar dollars euro euros cent cents usd eur gbp kb mb gb tb mph kmh".split())

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+")
_PARTS = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n\r]")
NUMBER, CAPITAL, UNIT, OPENS, CLOSES = 1, 2, 4, 8, 16
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x51ED270B7F3A9C11, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _flat(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and flags of the tokens of all pieces, and each piece's number of tokens. A piece's end may close a sentence."""
    from xxhash import xxh64_intdigest

    hashes, flags, sizes = [], [], []
    for piece in pieces:
        before, opens = len(hashes), False
        for part in _PARTS.findall(piece):
            first = part[0]
            if first in ".!?\n\r":
                if len(hashes) > before:
                    flags[-1] |= CLOSES
                opens = True
                continue
            low = part.lower()
            flags.append((NUMBER if first.isdecimal() else CAPITAL if first.isupper() and not part.isupper() else 0) | (UNIT if low in UNITS else 0) | (OPENS if opens else 0))
            hashes.append(xxh64_intdigest(low.encode()))
            opens = False
        if opens and len(hashes) == before:  # marks alone: they close what stands before the piece
            hashes.append(0)
            flags.append(CLOSES)
        sizes.append(len(hashes) - before)
    return np.array(hashes, np.uint64), np.array(flags, np.uint8), np.array(sizes, np.int64)


def readings(hashes: np.ndarray, flags: np.ndarray, doc: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Readings of texts whose tokens lie behind each other, `doc` saying whose a token is: number, token hashes, 1, 2, 3 where a
    number, name or unit stands, each one's place among its text's tokens, and whose it is.

    Marks that stood alone are gone. NAMED leaves out texts where no capitalised word opens a sentence, as it would be PLAIN.
    """
    if not len(hashes):
        return [(r, hashes, np.zeros(0, np.uint8), np.zeros(0, np.int64), doc) for r in (PLAIN, LITERAL)]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    opens = (flags & OPENS).astype(bool) | new
    opens[1:] |= (flags[:-1] & CLOSES).astype(bool)
    number = (flags & NUMBER).astype(bool)
    unit = np.zeros(len(flags), bool)
    unit[1:] = number[:-1] & ~new[1:]
    unit &= (flags & UNIT).astype(bool)
    capital = (flags & CAPITAL).astype(bool) & ~unit
    real = hashes != 0
    hashes, opens, capital, fixed, doc = hashes[real], opens[real], capital[real], (number * np.uint8(1) + unit * np.uint8(3))[real], doc[real]
    at = np.arange(len(doc)) - _starts(doc)
    templated = np.select([fixed == 1, fixed == 3], [_NUM, _UNIT], hashes)
    out = []
    for reading, name, own in ((PLAIN, capital & ~opens, None), (NAMED, capital, capital & opens)):
        goes_on = np.zeros(len(name), bool)
        goes_on[1:] = name[1:] & name[:-1] & ~opens[1:] & (doc[1:] == doc[:-1])
        keep = ~goes_on
        if own is not None:
            if not own.any():
                continue
            asked = np.zeros(int(doc[-1]) + 1, bool)
            asked[doc[own]] = True
            keep &= asked[doc]
        out.append((reading, np.where(name, _NAME, templated)[keep], np.where(name, np.uint8(2), fixed)[keep], at[keep], doc[keep]))
    return [*out, (LITERAL, hashes, np.zeros(len(hashes), np.uint8), at, doc)]


def _starts(doc: np.ndarray) -> np.ndarray:
    """For each token where its text begins."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    return np.repeat(first, np.diff([*first, len(doc)])) if len(doc) else first


class _Powers:
    """Powers of an odd number and of its inverse, as many as were asked for."""

    base = int(_MIX) | 1

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            size = 1 << size.bit_length()
            powers = np.full((2, size), [[self.base], [pow(self.base, -1, 1 << 64)]], np.uint64)
            powers[:, 0] = 1
            self.up, self.down = np.multiply.accumulate(powers, axis=1)
        return self.up, self.down


_POWERS = _Powers()


def window_hashes(tokens: np.ndarray, slots: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A signed hash of each window, where it starts and where it ends: behind `size` tokens and LEAST_WORDS words, all of one text."""
    none = np.zeros(0, np.int64)
    if len(tokens) < size:
        return none, none, none
    starts = np.arange(len(tokens) - size + 1)
    ends = starts + size
    if slots.any():
        words = np.flatnonzero(slots == 0)
        last = np.cumsum(slots == 0)[: len(starts)] - (slots[: len(starts)] == 0) + LEAST_WORDS - 1  # words before a place, and those it needs
        there = last < len(words)
        starts, ends = starts[there], np.maximum(ends[there], words[last[there]] + 1)
    whole = doc[ends - 1] == doc[starts]
    starts, ends = starts[whole], ends[whole]
    up, down = _POWERS.of(len(tokens))
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * down[starts]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(31))).view(np.int64), starts, ends


class Templates:
    """Template tokens of texts for one worker; distinct pieces between spaces are cut into tokens once."""

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.numbers, self.hashes, self.flags = PieceNumbers(), RaggedPool(np.uint64), RaggedPool(np.uint8)

    def _look(self, text: str) -> np.ndarray:
        pieces = text.split(" ")
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def _cut_pending(self) -> None:
        if self.numbers.pending:
            hashes, flags, sizes = _flat(self.numbers.pending)
            self.hashes.extend(hashes, sizes)
            self.flags.extend(flags, sizes)
            self.numbers.pending.clear()

    def _forget_at_limit(self) -> None:
        if self.numbers.forget_at(REMEMBERED):
            self._forget()

    def tokens_of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and flags of one text's tokens, a segment at a time."""
        hashes, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for part in segments(text, SEGMENT_CHARS, _ANY_WHITE):
            numbers = self._look(part)
            self._cut_pending()
            hashes.append(self.hashes.take(numbers))
            flags.append(self.flags.take(numbers))
            self._forget_at_limit()
        return np.concatenate(hashes), np.concatenate(flags)

    def readings_of(self, texts: list[str]) -> list[tuple]:
        """All readings of texts; the new pieces of those of ordinary size are cut together."""
        if any(len(text) > SEGMENT_CHARS for text in texts):
            found = [self.tokens_of(text) for text in texts]
            hashes, flags = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            sizes = np.array([len(x[0]) for x in found], np.int64)
        else:
            held = [self._look(text) for text in texts]
            self._cut_pending()
            numbers = np.concatenate(held) if held else np.zeros(0, np.int64)
            hashes, flags = self.hashes.take(numbers), self.flags.take(numbers)
            before = np.concatenate([[0], np.cumsum(self.hashes.sizes[numbers])])
            ends = np.cumsum([len(x) for x in held], dtype=np.int64)
            sizes = np.diff(before[ends], prepend=0)
            self._forget_at_limit()
        return readings(hashes, flags, np.repeat(np.arange(len(texts)), sizes))


def _slot_values(words: list[str], slots: np.ndarray, at: np.ndarray, start: int, end: int) -> list[str]:
    """The values in a window of a text with these words."""
    return [f"{slots[k]}:{words[at[k]]}" for k in range(start, end) if slots[k]]


def _words(text: str) -> list[str]:
    return [x.lower() for x in _TOKEN.findall(text)]


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """hash, reading, item, item_place, item_slots and windows, the number of windows of the item in this reading."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates()
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for k, x in zip(batch.column(0), texts_of(batch.column(1)), strict=True):
                views, words = own.readings_of([x]), _words(x)
                size = WINDOW if len(views[-1][1]) >= WINDOW else SHORT_WINDOW
                for reading, tokens, slots, at, doc in views:
                    hashes, starts, ends = window_hashes(tokens, slots, doc, size)
                    n = len(hashes)
                    values = [_slot_values(words, slots, at, a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    for row in zip(hashes.tolist(), [reading] * n, [k.as_py()] * n, starts.tolist(), values, [n] * n, strict=True):
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), batch.schema.field(0).type, pa.int64(), pa.list_(pa.string()), pa.int64()), strict=True)], names=["hash", "reading", "item", "item_place", "item_slots", "windows"])

    kind = dict(items.dtypes)[key]
    distinct = items.groupBy(F.col(text).alias("text")).agg(F.min(key).alias("item"))
    return distinct.select("item", "text").mapInArrow(cut, f"hash bigint, reading int, item {kind}, item_place bigint, item_slots array<string>, windows bigint")


def _bitmap(windows: DataFrame) -> np.ndarray:
    """One bit for each of BITMAP_BITS remainders of the hashes; at most that many bits reach the driver."""
    place = F.pmod("hash", F.lit(BITMAP_BITS)) + 1  # the functions count from 1
    parts = windows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in parts.collect():
        first = (row.bucket - 1) * 4096
        out[first : first + 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def document_windows(docs: DataFrame, bitmap: np.ndarray, key: str = "doc_id", text: str = "text", short: bool = True) -> DataFrame:
    """hash, reading, doc, doc_print, doc_place, doc_at (its token in the text) and doc_slots of the windows whose hash has its bit set."""
    sizes = (WINDOW, SHORT_WINDOW) if short else (WINDOW,)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        own = kept(("templates",), Templates)
        for batch in batches:
            rows: list[int] = []
            columns: list[list] = [[], [], [], [], [], []]
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for first, last in byte_groups(lengths, GROUP_BYTES):
                texts = list(texts_of(batch.column(1).slice(first, last - first)))
                prints: dict[int, int] = {}
                words: dict[int, list[str]] = {}
                for (reading, tokens, slots, at, doc), size in product(own.readings_of(texts), sizes):
                    hashes, starts, ends = window_hashes(tokens, slots, doc, size)
                    bit = hashes & (BITMAP_BITS - 1)
                    hit = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                    if not len(hit):
                        continue
                    begins = np.searchsorted(doc, np.arange(len(texts)))
                    for h, s, e in zip(hashes[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), strict=True):
                        d = int(doc[s])
                        if d not in prints:
                            prints[d], words[d] = xxh64_intdigest(texts[d].encode()) - (1 << 63), _words(texts[d])
                        for column, value in zip(columns, (h, reading, prints[d], s - int(begins[d]), int(at[s]), _slot_values(words[d], slots, at, s, e)), strict=True):
                            column.append(value)
                        rows.append(first + d)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *arrays], names=["doc", "hash", "reading", "doc_print", "doc_place", "doc_at", "doc_slots"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(cut, f"doc {kind}, hash bigint, reading int, doc_print bigint, doc_place bigint, doc_at bigint, doc_slots array<string>")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", enough: int = ENOUGH) -> DataFrame:
    """One row for each document and item that meet: doc, item, matched windows, windows of the item, place, verbatim."""
    known = stage(item_windows(items, item_key, item_text), "item-windows")
    met = document_windows(docs, _bitmap(known), key, text).join(known, ["hash", "reading"])
    pairs = F.zip_with("item_slots", "doc_slots", lambda a, b: F.struct(a.alias("item"), b.alias("doc")))
    # Each exact alignment, and two sets of overlapping bands of alignments: what moves by DRIFT or less lies within a band.
    shift, band = F.col("doc_place") - F.col("item_place"), 2 * DRIFT + 1
    bands = [F.struct(F.lit(k).alias("set"), F.floor((shift + DRIFT * k) / n).alias("shift")) for k, n in ((0, 1), (1, band), (2, band))]
    met = met.select("doc", "doc_print", "item", "windows", "reading", "item_place", "doc_at", pairs.alias("pairs"), F.explode(F.array(*bands)).alias("run"))
    runs = met.groupBy("doc", "doc_print", "item", "windows", "reading", "run").agg(
        F.count_distinct("item_place").alias("matched"),
        F.min("doc_at").alias("place"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    consistent = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item"]))) == F.size("pairs")
    need = F.least(F.lit(enough), F.ceil(F.col("windows") / 2))
    runs = runs.where((F.col("matched") >= need) & consistent)
    literal = F.coalesce(F.max(F.when(F.col("reading") == LITERAL, F.col("matched"))), F.lit(0))
    return runs.groupBy("doc", "item").agg(F.max("matched").alias("matched"), F.max("windows").alias("windows"), F.min("place").alias("place"), (literal >= F.max("matched")).alias("verbatim"))


def drop_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; all columns unchanged."""
    name = free_name(docs, "_found")
    found = stage(contaminated(docs, items, key, text).select(F.col("doc").alias(name)).distinct(), "contaminated")
    return docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col(name)), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(docs, items).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matched", "windows", "place", "verbatim")
