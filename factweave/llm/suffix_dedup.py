"""Suffix-array dedup: removal of every byte that a repeated string of `length` bytes covers.

Not all suffixes are sorted but those at anchors. In each window of `length` bytes, the anchor is the start of the 64-byte
string with the least hash (the leftmost of equals) within the window, so equal windows have their anchors at equal
offsets, and a window repeats exactly if its anchor meets another one that agrees with it far enough to both sides. An
anchor owns the windows that chose it, a range of starts shorter than a window; the bytes that its repeated windows cover
therefore follow from the first and the last of them.

1.  All anchors' hashes are counted. Two bitmaps of fixed size tell which hashes repeat and which are crowded; a wrong
    bit only adds work.
2.  Each task sorts the suffixes at its repeated anchors into runs and writes them front-coded: the length shared with
    the suffix before, then the rest; equal contexts are one entry. Runs are exchanged by the anchor's hash, to as many
    parts as the counted anchors need for `PART_BYTES` each, so a task holds the same however large the table is.
3.  Runs are merged by a loser tree that knows each head's common prefix with the last winner and compares only what
    lies behind it. The merged order gives the common prefixes to the right of the anchors, and sorting the bytes before
    the anchors backwards gives those to the left. Both together give each anchor's first and last repeated window.
4.  Anchors with a crowded hash, as boilerplate in very many documents has, would load one task. Their windows are
    hashed to 128 bits and counted instead, exchanged by hash and packed. A task first settles what it can by itself and
    asks only for windows beyond the first and last repeated ones it knows. The result is the same.

Matches never cross documents. Defined cases: null and empty texts have no bytes and lose none; rows that repeat are
copies of each other and lose their windows; null keys are kept as they are; an empty table gives an empty result; other
columns are left alone; equal strings have no order, all of them go. Long texts are hashed in blocks, so memory beyond the
text itself is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_groups
from .staging import stage

LENGTH, ANCHOR = 200, 64
#: Bytes that are hashed at once, and bytes of text from which one set of runs is made.
BLOCK, RUN_BYTES = 1 << 20, 32 << 20
#: Occurrences of an anchor's string from which its windows are counted instead of its suffixes sorted.
CROWDED = 8192
#: Bytes of contexts and windows that one part holds before front-coding, about.
PART_BYTES = 32 << 20
REPEATED_BITS, CROWDED_BITS = 1 << 26, 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = 1 << 64


def anchor_bytes(length: int) -> int:
    return min(ANCHOR, max(1, length // 3))


class Anchors:
    """Chooses anchors. A block's windows are decided by their own bytes alone, so blocks and documents need no order."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.anchor = anchor_bytes(length)
        self.reach = length - self.anchor + 1
        size = BLOCK + 2 * length
        self.bits = np.uint64(size.bit_length())  # the same for all blocks, as equal windows must choose alike
        self.up, self.down = (self._powers(b, size) for b in (_BASE, pow(_BASE, -1, _WRAP)))

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        out = (sums[self.anchor :] - sums[: -self.anchor]) * self.down[: len(sums) - self.anchor]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out

    def _block(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchors of a block of joined texts: place, first and last window, hash. ends: where the texts end."""
        if len(data) < self.length:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        hashes = self._hashes(data)
        bits = self.bits
        least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
        span = 1
        while 2 * span <= self.reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < self.reach:
            least = np.minimum(least[: len(least) - (self.reach - span)], least[self.reach - span :])
        chosen = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(chosen))
        text_end = np.repeat(ends, np.diff(ends, prepend=0))[: len(chosen)]
        inside = starts + self.length <= text_end
        chosen, starts = chosen[inside], starts[inside]
        if not len(chosen):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        new = np.concatenate([[True], chosen[1:] != chosen[:-1]])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        return chosen[first], starts[first], starts[last], hashes[chosen[first]]

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """place, first window, last window and hash of all anchors of joined texts that end at `ends`."""
        parts, begin = [], 0
        while begin < len(data):
            stop = min(len(data), begin + BLOCK)
            upto = min(len(data), stop + self.length - 1)
            own = np.unique(np.minimum(ends[ends > begin], upto)) - begin
            place, first, last, hashes = self._block(data[begin:upto], own)
            parts.append([place + begin, first + begin, last + begin, hashes])
            begin = stop
        for before, after in pairwise(parts):  # an anchor with windows in two blocks is one anchor
            if len(before[0]) and len(after[0]) and before[0][-1] == after[0][0]:
                after[1][0] = before[1][-1]
                for k in range(4):
                    before[k] = before[k][:-1]
        if not parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; its first `known` bytes are not read."""
    size = min(len(a), len(b))
    x, y = a[known:size], b[known:size]
    if x == y:
        return size
    rest = len(x)
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + rest - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted runs of (string, common prefix with the run's string before, payload).

    A head's prefix is the one it shares with the last winner. The head that shares more is the smaller one, and nothing
    is compared; at a tie the comparison starts behind the shared prefix, and the loser keeps what it shares with its winner.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, object]]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The winner of a and b; the loser stays at the node."""
        heads, shared = self.heads, self.shared
        if heads[b] is None:
            winner, loser = a, b
        elif heads[a] is None:
            winner, loser = b, a
        elif shared[a] != shared[b]:
            winner, loser = (a, b) if shared[a] > shared[b] else (b, a)
        else:
            x, y, known = heads[a][0], heads[b][0], shared[a]
            both = common_prefix(x, y, known)
            winner, loser = (a, b) if x[both : both + 1] <= y[both : both + 1] else (b, a)
            shared[loser] = both
        self.losers[node] = loser
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, object]]:
        """The strings in order, each with its common prefix with the one before."""
        heads, shared, losers = self.heads, self.shared, self.losers
        while heads[self.winner] is not None:
            winner = self.winner
            text, _, payload = heads[winner]
            yield text, shared[winner], payload
            heads[winner] = head = next(self.runs[winner], None)
            shared[winner] = head[1] if head is not None else 0
            node = (winner + self.size) // 2
            while node:
                winner = self._play(node, losers[node], winner)
                node //= 2
            self.winner = winner


#: One occurrence of an entry: document's number in the run, anchor's place, offsets of its first and last window.
OCCURRENCE = np.dtype([("doc", "<i4"), ("place", "<i8"), ("far", "<i2"), ("near", "<i2")])


def write_run(docs: np.ndarray, entries: list[tuple[bytes, bytes, list[tuple]]]) -> bytes:
    """A front-coded run. docs: two numbers that stand for each document. entries: sorted (right, left backwards, occurrences)."""
    shared, rests, left_shared, left_rests, counts, occurrences = [], [], [], [], [], []
    before = left_before = b""
    for right, left, own in entries:
        k, m = common_prefix(before, right), common_prefix(left_before, left)
        shared.append(k)
        rests.append(right[k:])
        left_shared.append(m)
        left_rests.append(left[m:])
        counts.append(len(own))
        occurrences += own
        before, left_before = right, left
    columns = [np.array(shared, "<i2"), np.array([len(x) for x in rests], "<i2"), np.array(left_shared, "<i2"), np.array([len(x) for x in left_rests], "<i2"), np.array(counts, "<i4")]
    head = np.array([len(docs), len(entries), len(occurrences)], "<i8")
    return b"".join([head.tobytes(), docs.astype("<i8").tobytes(), *(c.tobytes() for c in columns), np.array(occurrences, OCCURRENCE).tobytes(), *rests, *left_rests])


def read_run(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(right, shared, (left, documents, occurrences)) of each entry."""
    n_docs, n, n_all = np.frombuffer(blob, "<i8", 3).tolist()
    at = 24
    docs = np.frombuffer(blob, "<i8", 2 * n_docs, at).reshape(-1, 2)
    at += 16 * n_docs
    columns = []
    for kind, size in (("<i2", 2), ("<i2", 2), ("<i2", 2), ("<i2", 2), ("<i4", 4)):
        columns.append(np.frombuffer(blob, kind, n, at).tolist())
        at += size * n
    occurrences = np.frombuffer(blob, OCCURRENCE, n_all, at)
    at += OCCURRENCE.itemsize * n_all
    left_at = at + sum(columns[1])
    right = left = b""
    used = 0
    for shared, rest, left_shared, left_rest, count in zip(*columns, strict=True):
        right = right[:shared] + blob[at : at + rest]
        left = left[:left_shared] + blob[left_at : left_at + left_rest]
        at, left_at = at + rest, left_at + left_rest
        yield right, shared, (left, docs, occurrences[used : used + count])
        used += count


def _spans_of_group(rights: list[bytes], shared: list[int], payloads: list[tuple], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What an anchor string's entries lose: (documents, numbers, starts, ends). shared: right prefixes with the entry before."""
    n = len(rights)
    if n == 1:
        _, docs, own = payloads[0]
        if len(own) > 1:
            yield docs, own["doc"], own["place"] - own["far"], own["place"] - own["near"] + length
        return
    lefts = [p[0] for p in payloads]
    if n == 2:
        right = np.array([[len(rights[0]), shared[1]], [shared[1], len(rights[1])]])
        both = common_prefix(lefts[0], lefts[1])
        left = np.array([[len(lefts[0]), both], [both, len(lefts[1])]])
    else:
        order = sorted(range(n), key=lefts.__getitem__)
        left_shared = np.array([0, *(common_prefix(lefts[a], lefts[b]) for a, b in pairwise(order))])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        right_shared = np.array(shared)
    for k, (_, docs, own) in enumerate(payloads):
        if len(own) > 1:  # the same context twice
            yield docs, own["doc"], own["place"] - own["far"], own["place"] - own["near"] + length
            continue
        if n == 2:
            l, r = left[k, 1 - k : 2 - k], right[k, 1 - k : 2 - k]
        else:
            r = _outward(right_shared, k)
            l = _outward(left_shared, int(place[k]))[place]
            others = np.arange(n) != k
            l, r = l[others], r[others]
        far, near = int(own["far"][0]), int(own["near"][0])
        most, least = np.minimum(l, far), np.maximum(length - r, near)
        meets = least <= most
        if meets.any():
            at = own["place"]
            yield docs, own["doc"], at - most[meets].max(), at - least[meets].min() + length


def _outward(shared: np.ndarray, k: int) -> np.ndarray:
    """Common prefix of sorted string k with every other one, from those of neighbours; its own entry means nothing."""
    out = np.empty(len(shared), np.int64)
    out[k] = 0
    if k:
        out[:k] = np.minimum.accumulate(shared[1 : k + 1][::-1])[::-1]
    if k + 1 < len(shared):
        out[k + 1 :] = np.minimum.accumulate(shared[k + 1 :])
    return out


def merged_spans(blobs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Documents' numbers (rows of two) and spans (rows of start and end) that the merged runs settle."""
    own_anchor = anchor_bytes(length)
    docs_out, spans_out = [], []

    def settle(rights: list[bytes], shared: list[int], payloads: list[tuple]) -> None:
        # Entries of different runs with one context become one entry with all occurrences.
        seen: dict[tuple[bytes, bytes], int] = {}
        kept_rights, kept_shared, kept, least = [], [], [], length
        for right, k, (left, docs, own) in zip(rights, shared, payloads, strict=True):
            least = min(least, k) if kept_rights else k
            at = seen.get((right, left))
            if at is None:
                seen[right, left] = len(kept)
                kept_rights.append(right)
                kept_shared.append(least)
                kept.append([(left, docs, own)])
                least = length
            else:
                kept[at].append((left, docs, own))
        payload = []
        for parts in kept:
            if len(parts) == 1:
                payload.append(parts[0])
            else:
                shift = np.cumsum([0, *(len(p[1]) for p in parts[:-1])])
                joined = np.concatenate([p[2] for p in parts])
                joined["doc"] += np.repeat(shift, [len(p[2]) for p in parts]).astype("<i4")
                payload.append((parts[0][0], np.concatenate([p[1] for p in parts]), joined))
        for docs, numbers, starts, ends in _spans_of_group(kept_rights, kept_shared, payload, length):
            docs_out.append(docs[numbers])
            spans_out.append(np.column_stack([starts, ends]))

    rights: list[bytes] = []
    shared: list[int] = []
    payloads: list[tuple] = []
    for right, k, payload in LoserTree([read_run(b) for b in blobs]):
        if rights and k < own_anchor:
            settle(rights, shared, payloads)
            rights, shared, payloads = [], [], []
        rights.append(right)
        shared.append(k)
        payloads.append(payload)
    if rights:
        settle(rights, shared, payloads)
    if not docs_out:
        return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    return np.concatenate(docs_out), np.concatenate(spans_out)


#: A window that a task knows: its hash, whether the task has it twice, and else the anchor that asks for it.
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("twice", "?"), ("doc", "<i4"), ("start", "<i8")])


def crowded_windows(data: bytes, doc: np.ndarray, begins: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Windows to exchange, and spans (document, start, end) that this task settles by itself. Places are in `data`."""
    from xxhash import xxh3_128_digest

    sizes = last - first + 1
    ends = np.cumsum(sizes)
    starts = np.arange(ends[-1]) + np.repeat(first - (ends - sizes), sizes)
    raw = b"".join([xxh3_128_digest(data[s : s + length]) for s in starts.tolist()])
    hashes = np.frombuffer(raw, [("h1", "<u8"), ("h2", "<u8")])
    order = np.lexsort((hashes["h2"], hashes["h1"]))
    new = np.concatenate([[True], (hashes["h1"][order][1:] != hashes["h1"][order][:-1]) | (hashes["h2"][order][1:] != hashes["h2"][order][:-1])])
    group = np.empty(len(starts), np.int64)
    group[order] = np.cumsum(new) - 1
    twice = (np.bincount(group) > 1)[group]

    settled, ask = [], ~twice
    owner = np.repeat(np.arange(len(first)), sizes)
    known = np.flatnonzero(twice)
    if len(known):
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), -1)
        np.minimum.at(low, owner[known], starts[known])
        np.maximum.at(high, owner[known], starts[known])
        ask &= ~((starts > low[owner]) & (starts < high[owner]))
        for k in np.flatnonzero(high >= 0).tolist():
            settled.append((int(doc[k]), int(low[k] - begins[k]), int(high[k] - begins[k] + length)))
    # One entry for each window the task has twice, and one for each that it has once: those inside a settled span ask for nothing, yet others may need them.
    representative = order[new]
    wanted = np.zeros(len(starts), bool)
    wanted[representative] = True
    wanted |= ask
    out = np.zeros(int(wanted.sum()), WINDOW)
    out["h1"], out["h2"], out["twice"] = hashes["h1"][wanted], hashes["h2"][wanted], twice[wanted]
    out["doc"] = np.where(ask[wanted], doc[owner[wanted]], -1)
    out["start"] = starts[wanted] - begins[owner[wanted]]
    return out, settled


def counted_spans(blobs: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Documents' numbers and spans of the windows that meet others."""
    docs, windows, shift = [], [], 0
    for blob in blobs:
        n_docs = int(np.frombuffer(blob, "<i8", 1)[0])
        docs.append(np.frombuffer(blob, "<i8", 2 * n_docs, 8).reshape(-1, 2))
        own = np.frombuffer(blob, WINDOW, offset=8 + 16 * n_docs).copy()
        own["doc"][own["doc"] >= 0] += shift
        windows.append(own)
        shift += n_docs
    every, all_docs = np.concatenate(windows), np.concatenate(docs)
    order = np.lexsort((every["h2"], every["h1"]))
    every = every[order]
    new = np.concatenate([[True], (every["h1"][1:] != every["h1"][:-1]) | (every["h2"][1:] != every["h2"][:-1])])
    group = np.cumsum(new) - 1
    repeated = (np.bincount(group) + np.bincount(group, every["twice"]) > 1)[group] & (every["doc"] >= 0)
    found = every[repeated]
    return all_docs[found["doc"]], np.column_stack([found["start"], found["start"] + length])


def _bit(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    place = np.mod(hashes.view(np.int64), bits)
    return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """One bit for each remainder of `hash`, as bytes; its size is fixed."""
    place = F.pmod("hash", F.lit(bits)) + 1  # the functions count from 1
    parts = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        out[(row.bucket - 1) * 4096 : row.bucket * 4096] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a slice of texts, joined, and where each ends."""
    parts = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column]
    return b"".join(parts), np.cumsum([len(x) for x in parts], dtype=np.int64)


def _packed_spans(docs: np.ndarray, spans: np.ndarray) -> pa.RecordBatch:
    """One row for each document, its spans joined where they touch and packed as pairs of numbers."""
    names = ["d1", "d2", "spans"]
    if not len(docs):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=names)
    order = np.lexsort((spans[:, 0], docs[:, 1], docs[:, 0]))
    docs, spans = docs[order], spans[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]).any(axis=1)]))
    stops = [*first[1:].tolist(), len(docs)]
    packed = [union_spans(spans[a:b]).astype("<i8").tobytes() for a, b in zip(first.tolist(), stops, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(docs[first, 0]), pa.array(docs[first, 1]), pa.array(packed, pa.binary())], names=names)


def union_spans(spans: np.ndarray) -> np.ndarray:
    """The maximal runs that spans (rows of start and end) cover."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.column_stack([spans[first, 0], reach[np.concatenate([first[1:], [len(spans)]]) - 1]])


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """d1, d2 and packed spans: what each document loses, in parts that are still to be joined. docs: d1, d2 and the text."""
    spark = docs.sparkSession
    rows = docs.select("d1", "d2", F.col(text))

    def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length)
        for batch in batches:
            column = batch.column(2)
            for a, b in byte_groups((x.as_buffer().size if x.is_valid else 0 for x in column), RUN_BYTES):
                data, ends = _joined(column.slice(a, b - a))
                hashes, counts = np.unique(anchors.of(np.frombuffer(data, np.uint8), ends)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "n"])

    counts = rows.mapInArrow(anchor_counts, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    counts = stage(counts, "anchor-counts")
    repeats, crowds = _bitmap(counts, REPEATED_BITS), _bitmap(counts.where(F.col("n") > crowded), CROWDED_BITS)
    shared = spark.sparkContext.broadcast((repeats, crowds))  # fixed size
    # An anchor is sent with the bytes around it, or as the windows that chose it: about a third of the length many.
    sent = F.when(F.col("n") > crowded, F.col("n") * (length // 3) * WINDOW.itemsize).otherwise(F.col("n") * (2 * length - anchor_bytes(length)))
    parts = int((counts.agg(F.sum(sent)).first()[0] or 0) // PART_BYTES) + 1

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (repeats, crowds) = Anchors(length), shared.value
        left_most = length - anchors.anchor
        for batch in batches:
            column = batch.column(2)
            names = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            for a, b in byte_groups((x.as_buffer().size if x.is_valid else 0 for x in column), RUN_BYTES):
                data, ends = _joined(column.slice(a, b - a))
                place, first, last, hashes = anchors.of(np.frombuffer(data, np.uint8), ends)
                wanted = _bit(repeats, hashes, REPEATED_BITS)
                place, first, last, hashes = place[wanted], first[wanted], last[wanted], hashes[wanted]
                if not len(place):
                    continue
                doc = np.searchsorted(ends, place, "right")
                begin = np.concatenate([[0], ends])[doc]
                crowd = _bit(crowds, hashes, CROWDED_BITS)
                own_names = names[a:b]
                part = (hashes % np.uint64(parts)).astype(np.int64)
                found: dict[int, dict[tuple[bytes, bytes], list[tuple]]] = {}
                calm = np.flatnonzero(~crowd)
                for p, at, d, s, e, f, l in zip(*(x[calm].tolist() for x in (part, place, doc, begin, ends[doc], first, last)), strict=True):
                    context = data[at : min(at + length, e)], data[max(s, at - left_most) : at][::-1]
                    found.setdefault(p, {}).setdefault(context, []).append((d, at - s, at - f, at - l))
                blobs = [(p, 0, _run_blob(own_names, own)) for p, own in found.items()]
                if crowd.any():
                    windows, settled = crowded_windows(data, doc[crowd], begin[crowd], first[crowd], last[crowd], length)
                    to = (windows["h1"] % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(to, kind="stable")
                    for own in np.split(windows[order], np.flatnonzero(np.diff(to[order])) + 1):
                        blobs.append((int(own["h1"][0] % np.uint64(parts)), 1, _window_blob(own_names, own)))
                    if settled:
                        numbers = np.array(settled, np.int64)
                        blobs.append((int(numbers[0, 0]) % parts, 2, np.array([len(numbers)], "<i8").tobytes() + own_names[numbers[:, 0]].astype("<i8").tobytes() + numbers[:, 1:].astype("<i8").tobytes()))
                for p, kind, blob in blobs:
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for batch in batches:
            for kind, blob in zip(batch.column("kind").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                blobs[kind].append(blob)
        found = [merged_spans(blobs[0], length)] if blobs[0] else []
        found += [counted_spans(blobs[1], length)] if blobs[1] else []
        for blob in blobs[2]:
            n = int(np.frombuffer(blob, "<i8", 1)[0])
            found.append((np.frombuffer(blob, "<i8", 2 * n, 8).reshape(-1, 2), np.frombuffer(blob, "<i8", 2 * n, 8 + 16 * n).reshape(-1, 2)))
        yield _packed_spans(np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found]))

    exchanged = rows.mapInArrow(runs, "part bigint, kind int, blob binary")
    # The number of partitions is given, so the tasks grow with the table too and are not merged.
    return exchanged.repartition(parts, "part").groupBy("part").applyInArrow(settle, "d1 bigint, d2 bigint, spans binary")


def _run_blob(names: np.ndarray, found: dict[tuple[bytes, bytes], list[tuple]]) -> bytes:
    numbers = sorted({o[0] for own in found.values() for o in own})
    at = {d: k for k, d in enumerate(numbers)}
    entries = [(right, left, [(at[d], *rest) for d, *rest in own]) for (right, left), own in sorted(found.items())]
    return write_run(names[numbers], entries)


def _window_blob(names: np.ndarray, windows: np.ndarray) -> bytes:
    numbers = np.unique(windows["doc"][windows["doc"] >= 0])
    own = windows.copy()
    asking = own["doc"] >= 0
    own["doc"][asking] = np.searchsorted(numbers, own["doc"][asking])
    return np.array([len(numbers)], "<i8").tobytes() + names[numbers].astype("<i8").tobytes() + own.tobytes()


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """key, kept binary, n_bytes, n_removed, n_spans of every row."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.select("key", "text", F.xxhash64("key", "text").alias("d1"), F.xxhash64(F.lit("suffix"), "text", "key").alias("d2"))
    spans = stage(repeated_spans(own, "text", length, crowded), "spans")
    spans = spans.groupBy(F.col("d1").alias("s1"), F.col("d2").alias("s2")).agg(F.collect_list("spans").alias("spans"))
    return own.join(spans, (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")), "left").select(F.col("key").alias(key), "text", "spans")


def cut_text(text: bytes, packed: list[bytes] | None) -> tuple[bytes, np.ndarray]:
    """What is left of a text, and the maximal runs that are gone."""
    if not packed:
        return text, np.zeros((0, 2), np.int64)
    spans = union_spans(np.frombuffer(b"".join(packed), "<i8").reshape(-1, 2))
    bounds = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)), spans


def suffix_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for x, packed in zip(batch.column(1), batch.column(2), strict=True):
                whole = x.as_buffer().to_pybytes()
                kept, spans = cut_text(whole, packed.as_py())
                for column, value in zip(columns, (len(whole), len(whole) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = dict(docs.dtypes)[key]
    return suffix_dedup(docs, key, text, length, crowded).mapInArrow(digest, f"`{key}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
