"""SimHash near-dedup by pigeonhole blocks.

A fingerprint has one bit for each bit of a 64-bit hash: set if more than half of the shingles' hashes have it. Documents
with one fingerprint form a class, and only classes are linked. The 64 bits are cut into four blocks; two fingerprints
that differ in at most two bits agree on at least two blocks, so each class is filed under all six pairs of blocks, and
classes that meet under a pair are verified by Hamming distance.

A pair of blocks under which very many classes meet (a large group of near copies) is not compared pair by pair. Its
classes are filed once more under each fingerprint at distance one or zero: two fingerprints differ in at most two bits
exactly if they share such a neighbour, no more than 65 classes can share one, and each of them is linked to the least.
That keeps every connection, and the work is in proportion to the number of classes.

`similar_documents` asks for a similarity of shingle sets on top. It forms SimHash groups in the same way, from the fingerprints of the
distinct shingles, and compares each member's set with that of its group's first. At a similarity of 0.8, fingerprints differ in about
ten of 64 bits, and no split into blocks has one that all such pairs share and that still tells documents apart. So more blocks are cut
from the space of hashes: the least hash of each of 128 ranges, four of which are a block. A pair of
similarity 0.8 shares no block with probability (1 - 0.8^4)^32, less than one in ten million. Pairs whose least hashes agree in
enough ranges are then compared by their distinct shingles, which alone decide. In blocks that very many sets share, members are first linked to a
few of their block; then all that is outside a block's largest component is compared with all of the block, in tiles.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer words than a shingle holds
are one shingle; repeated rows fall into one class; a null key is never a representative unless all of its component's
keys are null; an empty table gives an empty result; other columns are left alone. Equal fingerprints, or equal sets of
shingles, tie: they are one class under its least key. Long texts are cut into shingles in bounded steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmaps import bitmap_of, in_bitmap
from .chunks import keep_nothing, texts_of
from .components import connected_components
from .staging import free_name, stage

BITS, BLOCKS = 64, 4
WIDTH = BITS // BLOCKS
#: Classes under one pair of blocks up to which they are compared pair by pair.
PAIRWISE = 128
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts + bits[whole:].sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str, shingle: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of every shingle, repeats included, in bounded steps. Words are runs of bytes other than white space, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if words and len(words) < shingle:
        yield np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    for first in range(0, len(words) - shingle + 1, STEP):
        part = words[first : first + STEP + shingle - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(shingle)]))  # ends with the shortest
        yield np.fromiter((xxh64_intdigest(x, 42) for x in joined), np.uint64)


def fingerprint(text: str, shingle: int = 3) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts."""
    counts, size = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += _bit_counts(hashes)
        size += len(hashes)
    return int(np.packbits(counts * 2 > size, bitorder="little").view(np.uint64)[0]) if size else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """id and fp, the fingerprint as a signed 64-bit number, of every row. No shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(add, f"id {dict(docs.dtypes)[key]}, fp bigint")


def _block_pairs(fp: Column) -> Column:
    """One number for each pair of blocks: which pair, and its 32 bits."""
    block = [F.shiftrightunsigned(fp, WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) for k in range(BLOCKS)]
    return F.array(*[F.lit(n << 2 * WIDTH).bitwiseOR(F.shiftleft(block[a], WIDTH)).bitwiseOR(block[b]) for n, (a, b) in enumerate(combinations(range(BLOCKS), 2))])


def _signed(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def links(classes: DataFrame, most_bits: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Edges u, v between distinct fingerprints `fp` that keep every connection over at most `most_bits` (two or fewer) differing bits."""
    if not 0 <= most_bits <= BLOCKS - 2:
        raise ValueError("four blocks serve at most two differing bits")
    filed = classes.select("fp", F.explode(_block_pairs(F.col("fp"))).alias("pair"))
    sizes = filed.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(filed.join(sizes, "pair"), "block-pairs")

    few = met.where(F.col("n") <= pairwise)
    left, right = few.select("pair", F.col("fp").alias("v")), few.select("pair", F.col("fp").alias("u"))
    near = left.join(right, "pair").where((F.col("u") > F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most_bits)).select("u", "v")

    # With two bits allowed, neighbours at distance one meet; with one bit, a neighbour also has to be one of the two.
    many = met.where(F.col("n") > pairwise).select("fp").distinct()
    around = many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(k)).cast("long")) for k in range(BITS)])).alias("near"))
    stars = around.groupBy("near").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if most_bits == 2:
        stars = stars.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u"))
    else:
        stars = stars.where(F.array_contains("fps", F.col("near"))).select(F.col("near").alias("v"), F.explode("fps").alias("u")).where(F.lit(most_bits == 1))
    return near.union(stars.where("u <> v").select("u", "v")).distinct()


def linked_classes(classes: DataFrame, most_bits: int = 2) -> DataFrame:
    """classes, distinct fp and `least`, with component, which fingerprints share that links join."""
    found = connected_components(links(classes.select("fp"), most_bits))
    joined = classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return stage(joined, "class-components")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, most_bits: int = 2) -> DataFrame:
    """key, fp and component, the least key reachable over links, of every row."""
    marked = stage(fingerprints(docs, key, text, shingle), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined = linked_classes(classes, most_bits)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(joined.join(least, "component").select("fp", "component_id"), "class-names")
    return marked.join(named, "fp").select(F.col("id").alias(key), "fp", "component_id")


#: Ranges of the hash space, ranges in a block, and what stands for the least hash of an empty range.
RANGES, ROWS, EMPTY = 128, 4, 0xFFFFFFFF
#: Share of the similarity asked for that the estimate from least hashes has to reach before the sets themselves are compared.
LOOSE = 0.75
#: Members and bytes of shingles on the side of a tile that has all members, and on the one that has those outside the largest component, about.
TILE, TILE_BYTES, FEW, FEW_BYTES = 1024, 8 << 20, 1024, 8 << 20
#: Bits of the bitmaps of blocks that several sets share, and of the keys of texts that are read once more.
BLOCK_BITS, KEY_BITS = 1 << 26, 1 << 24
_STARTS = np.arange(RANGES, dtype=np.uint64) << np.uint64(57)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    kept = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(text, shingle):
        kept = np.union1d(kept, hashes)
    return kept


def _name_of(kept: np.ndarray) -> tuple[int, int]:
    """Two numbers that stand for a set of shingles."""
    from xxhash import xxh3_128_intdigest

    whole = xxh3_128_intdigest(kept.tobytes())
    return (whole >> 64) - (1 << 63), whole % (1 << 64) - (1 << 63)


def _block(raw: bytes, k: int) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(raw[4 * ROWS * k : 4 * ROWS * (k + 1)], k) - (1 << 63)


def least_hashes(kept: np.ndarray) -> np.ndarray:
    """The least hash of each range of the hash space, EMPTY where it has none; kept: hashes in order."""
    at = np.searchsorted(kept, _STARTS)
    least = np.full(RANGES, EMPTY, np.uint32)
    full = np.diff([*at, len(kept)]) > 0
    least[full] = np.minimum(kept[at[full]] >> np.uint64(25) & np.uint64(0xFFFFFFFF), EMPTY - 1)
    return least


def sketch(text: str, shingle: int) -> tuple[bytes, int, int, list[int], int]:
    """One byte of each range's least hash (0: none), two numbers for the set of shingles, one for each block that is not empty, and the set's fingerprint."""
    kept = shingle_set(text, shingle)
    least = least_hashes(kept)
    raw = least.tobytes()
    short = np.where(least == EMPTY, 0, least % 255 + 1).astype(np.uint8)
    blocks = [_block(raw, k) for k in np.flatnonzero((least != EMPTY).reshape(-1, ROWS).any(axis=1)).tolist()]
    parts = (kept[k : k + STEP] for k in range(0, len(kept), STEP))
    return short.tobytes(), *_name_of(kept), blocks, int(np.uint64(fingerprint_of(parts)).view(np.int64))


def sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            columns = list(zip(*[sketch(x, shingle) for x in texts_of(batch.column(1))], strict=True)) or [()] * 5
            rest = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rest], names=["id", "least", "w1", "w2", "blocks", "fp"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(add, f"id {dict(docs.dtypes)[key]}, least binary, w1 bigint, w2 bigint, blocks array<bigint>, fp bigint")


def _simhash_pairs(prints: DataFrame) -> DataFrame:
    """Pairs u, v of each node and the least of its SimHash group: fingerprints that links of two bits or fewer join.

    prints: node, fp. One pair for each node, however large the group is.
    """
    linked = linked_classes(stage(prints.groupBy("fp").agg(F.min("node").alias("least")), "set-fingerprints"))
    first = linked.groupBy("component").agg(F.min("least").alias("v"))
    named = stage(linked.join(first, "component").select("fp", "v"), "simhash-groups")
    return prints.join(named, "fp").where("node > v").select(F.col("node").alias("u"), "v")


def _blocks_met(heads: DataFrame) -> DataFrame:
    """block, node, n of the blocks that n > 1 sets share. Only counts and what passes the bitmap of shared blocks move."""
    counts = stage(heads.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count("*").alias("n")).where("n > 1"), "block-counts")
    shared = heads.sparkSession.sparkContext.broadcast(bitmap_of(counts.select(F.col("block").alias("hash")), BLOCK_BITS))  # fixed size

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            blocks = lists.flatten().to_numpy()
            keep = in_bitmap(shared.value, blocks)
            nodes = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(blocks[keep])], names=["node", "block"])

    return stage(heads.select("node", "blocks").mapInArrow(file, "node bigint, block bigint").join(counts, "block"), "blocks-met")


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """node and shingles, the distinct shingles' hashes in order, of the classes asked for; read from the texts once more."""
    asked = stage(classes.select("node", "w1", "w2", "least_id").join(nodes, "node"), "asked")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap_of(asked.select(F.xxhash64("least_id").alias("hash")), KEY_BITS))  # fixed size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_nothing()
        for batch in batches:
            texts = batch.column(0).filter(pa.array(in_bitmap(wanted.value, batch.column(1).to_numpy())))
            for x in texts_of(texts):
                kept = shingle_set(x, shingle)
                w1, w2 = _name_of(kept)
                yield pa.RecordBatch.from_arrays([pa.array([w1]), pa.array([w2]), pa.array([kept.view(np.int64)], pa.list_(pa.int64()))], names=["w1", "w2", "shingles"])

    texts = docs.select(F.col(text), F.xxhash64(F.col(key)))  # texts stay where they are
    # A key may stand for several texts: the set itself says which class it belongs to.
    found = texts.mapInArrow(cut, "w1 bigint, w2 bigint, shingles array<bigint>").dropDuplicates(["w1", "w2"])
    return found.join(asked.select("w1", "w2", "node"), ["w1", "w2"]).select("node", "shingles")


def _estimates(a: np.ndarray, b: np.ndarray, empty: int) -> np.ndarray:
    """Similarities of sets as their least hashes suggest them. With one byte of each hash they are larger by one in 256 of what differs."""
    same = ((a == b) & (a != empty)).sum(axis=-1)
    return same / np.maximum(((a != empty) | (b != empty)).sum(axis=-1), 1)


def _likely(pairs: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """The pairs u, v whose estimate reaches `least`."""

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, RANGES) for c in ("a_least", "b_least"))
                yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(_estimates(a, b, 0) >= least))

    pairs = pairs.join(heads.select(F.col("node").alias("u"), F.col("least").alias("a_least")), "u")
    pairs = pairs.join(heads.select(F.col("node").alias("v"), F.col("least").alias("b_least")), "v")
    return pairs.select("u", "v", "a_least", "b_least").mapInArrow(guess, "u bigint, v bigint")


def _exact(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs u, v whose sets of shingles have the similarity."""
    pairs = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    both = F.size(F.array_intersect("a", "b"))
    return pairs.where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v")


def _tile_links(similarity: float):
    """Links between the two sides of a tile that join components; a pair is looked at under the first block that it shares.

    One side holds members of a block, the other some that are outside its largest component. Two of these meet in two tiles
    and are looked at in one.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, component, outside = (table.column(c).to_numpy() for c in ("node", "component", "outside"))
        sets = [np.asarray(x.values).view(np.uint64) for x in table.column("shingles")]
        least = np.array([least_hashes(x) for x in sets]).reshape(-1, RANGES)
        across = table.column("across").to_numpy(zero_copy_only=False).astype(bool)
        block = table.column("block")[0].as_py()
        raw = least[0].tobytes()
        this = next(k for k in range(RANGES // ROWS) if _block(raw, k) == block)
        full = (least != EMPTY).reshape(-1, RANGES // ROWS, ROWS).any(axis=2)
        side = np.flatnonzero(~across)
        found: list[tuple] = []
        for a in np.flatnonzero(across).tolist():
            open_ = side[(component[side] != component[a]) & (~outside[side].astype(bool) | (node[side] < node[a]))]
            shared = (least[a] == least[open_]).reshape(-1, RANGES // ROWS, ROWS).all(axis=2) & full[a]
            guess = _estimates(least[a], least[open_], EMPTY)
            good = np.flatnonzero((shared.argmax(axis=1) == this) & (guess >= LOOSE * similarity))
            found += zip((-guess[good]).tolist(), [a] * len(good), open_[good].tolist(), strict=True)
        parent: dict = {}

        def root(x: int) -> int:
            while x in parent:
                x = parent[x]
            return x

        out: list[tuple] = []
        for _, a, b in sorted(found):  # the surest first: what they join needs no further comparison
            ra, rb = root(int(component[a])), root(int(component[b]))
            if ra != rb:
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                    parent[max(ra, rb)] = min(ra, rb)
                    out.append((int(node[a]), int(node[b])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return compare


def _open_members(many: DataFrame, found: DataFrame) -> DataFrame:
    """The members of crowded blocks that hold more than one component: block, node, component."""
    named = stage(many.join(found, many["node"] == found["node"], "left").select("block", many["node"], F.coalesce("component", many["node"]).alias("component")), "crowds")
    several = named.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("block")
    return stage(named.join(stage(several, "open-blocks"), "block"), "open-members")


def _tiles(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """block, i, j, across, node, component, outside: the tiles in which members of a block meet those outside its largest component.

    members: block, node, component. sizes: node, size, the number of its shingles.
    """
    members = stage(members.join(sizes, "node"), "sized-members")
    counts = members.groupBy("block", "component").agg(F.count("*").alias("n"))
    main = counts.groupBy("block").agg(F.max(F.struct("n", "component")).alias("main")).select("block", F.col("main.component").alias("main"))
    members = members.join(stage(main, "main-components"), "block").withColumn("outside", (F.col("component") != F.col("main")).cast("int"))
    members = stage(members.select("block", "node", "component", "outside", "size"), "sided-members")
    parts = lambda keep, n, size: F.ceil(F.greatest(F.sum(keep) / n, F.sum(8 * F.col("size") * keep) / size))
    grid = members.groupBy("block").agg(parts(F.lit(1), TILE, TILE_BYTES).alias("rows"), parts(F.col("outside"), FEW, FEW_BYTES).alias("columns"))
    members = members.join(stage(grid, "tile-grid"), "block")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["node", "component", "outside"]
    side = members.select("block", place("rows", 1).alias("i"), every("columns").alias("j"), F.lit(0).alias("across"), *kept)
    few = members.where("outside = 1").select("block", every("rows").alias("i"), place("columns", 2).alias("j"), F.lit(1).alias("across"), *kept)
    return side.union(few)


def _stars(found: DataFrame) -> DataFrame:
    return found.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def _crowd_components(many: DataFrame, edges: DataFrame, heads: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Components over edges and the links within crowded blocks: their members are compared until no two of different components are left."""
    found = stage(connected_components(edges), "components")
    members = _open_members(many, found)
    # A base has links to many of its copies: the member with most links is compared with all others first.
    degrees = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = members.join(degrees, "node").groupBy("block").agg(F.max(F.struct("degree", "node", "component")).alias("hub")).select("block", "hub.node", "hub.component")
    hubs = stage(hubs.select("block", F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hubs")
    pairs = members.join(hubs, "block").where("component <> hub_component").select(F.greatest("node", "hub").alias("u"), F.least("node", "hub").alias("v")).distinct()
    fresh = stage(_exact(_likely(stage(pairs, "hub-pairs"), heads, LOOSE * similarity), sets, similarity), "near-hubs")
    if not fresh.isEmpty():
        found = stage(connected_components(_stars(found).union(fresh)), "components")
        members = _open_members(many, found)

    tiles = _tiles(members, sets.select("node", F.size("shingles").alias("size"))).join(sets, "node")
    fresh = stage(tiles.groupBy("block", "i", "j").applyInArrow(_tile_links(similarity), "u bigint, v bigint"), "near-crowds")
    return found if fresh.isEmpty() else connected_components(_stars(found).union(fresh))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, pairwise: int = 64) -> DataFrame:
    """id and component, the least key reachable over pairs of the similarity or more, of every row with a key that has company."""
    docs = docs.where(F.col(key).isNotNull())
    marked = stage(sketches(docs, key, text, shingle), "sketches")
    # Documents with one set of shingles are a class; one sketch stands for it, under a number of the class's own.
    classes = marked.groupBy("w1", "w2").agg(F.min("id").alias("least_id"), F.min_by(F.struct("least", "blocks", "fp"), "id").alias("head"))
    classes = stage(classes.select("w1", "w2", "least_id", F.monotonically_increasing_id().alias("node"), "head.least", "head.blocks", "head.fp"), "sketch-classes")
    # SimHash groups first. Their members go to the sets without an estimate: their fingerprints are verified.
    grouped = _simhash_pairs(classes.select("node", "fp"))
    heads = classes.select("node", "least", "blocks")
    met = _blocks_met(heads)
    few, many = met.where(F.col("n") <= pairwise), met.where(F.col("n") > pairwise)
    pairs = few.select("block", F.col("node").alias("v")).join(few.select("block", F.col("node").alias("u")), "block").where("u > v").select("u", "v")
    # Crowded blocks: first with two members only, which joins most of a group of near copies. The rest follows in _crowd_links.
    ends = many.join(many.groupBy("block").agg(F.min("node").alias("low"), F.max("node").alias("high")), "block")
    pairs = pairs.union(ends.select(F.col("node").alias("u"), F.col("low").alias("v"))).union(ends.select(F.col("high").alias("u"), F.col("node").alias("v")))
    # What lies further apart than two bits meets by least hashes.
    likely = _likely(stage(pairs.where("u <> v").distinct(), "pairs"), heads, LOOSE * similarity)
    pairs = stage(likely.union(grouped).distinct(), "likely-pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).union(many.select("node")).distinct()
    sets = stage(_sets(docs, classes, asked, key, text, shingle), "shingle-sets")
    edges = stage(_exact(pairs, sets, similarity), "near")
    found = connected_components(edges) if many.isEmpty() else _crowd_components(many, edges, heads, sets, similarity)
    found = stage(found, "sketch-components")
    names = classes.select("w1", "w2", "least_id", "node")
    joined = names.join(found, "node").select("w1", "w2", "least_id", "component")
    linked = joined.join(joined.groupBy("component").agg(F.min("least_id").alias("least_key")), "component").select("w1", "w2", "least_key")
    named = stage(names.join(linked, ["w1", "w2"], "left").select("w1", "w2", F.coalesce("least_key", "least_id").alias("component")), "sketch-names")
    return marked.select("id", "w1", "w2").join(named, ["w1", "w2"]).select("id", "component")


def drop_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with the least key of each group; rows without a key stay, and rows that share one stay or go together."""
    name = free_name(docs, "_gone")
    gone = stage(similar_documents(docs, key, text, **options).where("id <> component").select(F.col("id").alias(name)).distinct(), "similar")
    return docs.join(gone, F.col(f"`{key}`") == F.col(name), "left_anti")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


