"""Exact top-k search by inner product with a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it: each pivot's vectors fall into annuli. With pivot p,
a query q and a vector x at distance d from p, the triangle inequality gives |q - x| >= | |q - p| - d |, and so
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 has an upper bound for a whole annulus; q.p + |q| d is another one. A query sorts the
annuli by their bounds and expands in that order, some at a time: the first one, the next `STEPS`, then the rest. What it
has found sets the score to beat, and it stops at the first annulus whose bound is below; within an annulus it reads only
the slices by distance that reach the score. All others can hold nothing better.

Pivots and the edges of annuli come from a bounded sample (`SAMPLE` distinct vectors); every vector is indexed and the
result is exact whatever the sample was. The number of pivots grows with the square root of the number of vectors, up to
`MOST_PIVOTS`, so the statistics of annuli have a size bound. Equal vectors are one entry with their k + 1 least ids, since
no other of them can be among the k best with ties to smaller ids. Annuli are dealt in chunks of vectors, and queries in
blocks of neighbours, those whose best annulus is the same; a chunk of vectors goes only to blocks that ask for it, so
what is shuffled follows the pairs of chunk and block that the bounds leave, and no task holds an unbounded group.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; a row
that repeats counts once; rows with one id and different vectors are candidates each; vectors of unequal length are
compared as if padded with zeros; fewer than k candidates are all returned; products beyond 64 bits are clipped to them;
ties go to the smaller id; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

PIVOTS, MOST_PIVOTS, SHELLS, SAMPLE = 32, 256, 8, 4096
#: Annuli that a query expands to at most after its first one, before the score to beat is taken anew.
STEPS = 8
#: Vectors and queries that one group of a task holds, about; vectors in a slice of an annulus.
CHUNK, QUERY_CHUNK, SLICE = 4096, 4096, 512
_LONG = np.iinfo(np.int64)


def _pack(rows: np.ndarray) -> list[tuple[bytes, bool]]:
    """Each row of whole numbers as 16-bit integers if they fit, else as doubles."""
    if not rows.size:
        return [(b"", False)] * len(rows)
    small = np.abs(rows).max(axis=1) <= 32767
    return [(r.astype("<i2").tobytes(), False) if s else (r.astype("<f8").tobytes(), True) for r, s in zip(rows, small, strict=True)]


def _unpack(vectors: list[bytes], wide: list[bool], dim: int | None = None) -> np.ndarray:
    rows = [np.frombuffer(v, "<f8" if w else "<i2") for v, w in zip(vectors, wide, strict=True)]
    dim = max([dim or 0, *map(len, rows)])
    if all(len(r) == dim for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), dim)
    out = np.zeros((len(rows), dim))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _even(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dim = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, dim - x.shape[1]))) if x.shape[1] < dim else x for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows as 64-bit integers."""
    a, b = _even(a, b)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in r] for r in m] for m in (a, b))
    return np.array([[min(max(sum(x * y for x, y in zip(r, s, strict=True)), _LONG.min), _LONG.max) for s in right] for r in left], np.int64)


def quantised(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """id, vec and wide of the rows that take part: floor(scale * x), packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column(1), batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = np.array([len(x) if x.is_valid else -1 for x in lists], np.int64)
            ends = np.cumsum(np.maximum(sizes, 0))
            found: list[tuple[bytes, bool] | None] = [None] * len(sizes)
            for size in set(sizes.tolist()) - {-1}:
                at = np.flatnonzero(sizes == size)
                rows = values[(ends[at] - size)[:, None] + np.arange(size)]
                good = np.isfinite(rows).all(axis=1)
                for k, x in zip(at[good].tolist(), _pack(np.floor(scale * rows[good])), strict=True):
                    found[k] = x
            keep = [k for k, x in enumerate(found) if x is not None and ids[k].is_valid]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())).cast(pa.int64()), pa.array([found[k][0] for k in keep], pa.binary()), pa.array([found[k][1] for k in keep], pa.bool_())], names=["id", "vec", "wide"])

    return vectors.select(F.col(key), F.col(column)).mapInArrow(pack, "id bigint, vec binary, wide boolean")


class Pivots:
    """Pivots, the edges of their annuli, and a sample of vectors whose scores are lower bounds of what is to be found."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, pivots: int = PIVOTS, shells: int = SHELLS) -> None:
        self.sample, self.ids, self.shells = sample, ids, shells
        chosen = [0]
        gaps = self._gaps(sample, sample[:1])[:, 0]
        while len(chosen) < min(pivots, len(sample)) and gaps.max() > 0:
            chosen.append(int(gaps.argmax()))
            gaps = np.minimum(gaps, self._gaps(sample, sample[chosen[-1:]])[:, 0])
        centres = sample[chosen]
        for _ in range(4):  # a few rounds of k-means
            nearest = self._gaps(sample, centres).argmin(axis=1)
            centres = np.array([sample[nearest == k].mean(axis=0) if (nearest == k).any() else centres[k] for k in range(len(centres))])
        self.centres = centres
        gaps = self._gaps(sample, centres)
        nearest, gap = gaps.argmin(axis=1), gaps.min(axis=1)
        quantiles = np.linspace(0, 1, shells + 1)[1:-1]
        self.edges = np.array([np.quantile(gap[nearest == k], quantiles) if (nearest == k).any() else np.zeros(shells - 1) for k in range(len(centres))])

    @staticmethod
    def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = _even(a, b)
        with np.errstate(all="ignore"):
            return np.nan_to_num(np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)), nan=np.inf)

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus of each vector and its distance to the pivot."""
        gaps = self._gaps(vectors, self.centres)
        nearest = gaps.argmin(axis=1)
        gap = gaps[np.arange(len(vectors)), nearest]
        return nearest * self.shells + (gap[:, None] > self.edges[nearest]).sum(axis=1), gap

    def bounds(self, queries: np.ndarray, pivot: np.ndarray, least: np.ndarray, most: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, [query, annulus]: pivot, least and greatest distance, greatest squared length."""
        q, centres = _even(queries, self.centres)
        with np.errstate(all="ignore"):
            gap = self._gaps(q, centres)[:, pivot]
            square = (q * q).sum(1)[:, None]
            apart = np.maximum(np.maximum(gap - most, least - gap), 0)
            slack = 1e-6 * (square + norm + gap * gap + most * most + 1)  # rounding
            bound = np.minimum((square + norm - apart * apart) / 2, (q @ centres.T)[:, pivot] + np.sqrt(square) * most) + slack
        return np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def _best(queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query: score first, then the smaller id."""
    order = np.lexsort((ids, -scores, queries))
    of = queries[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff([*first, len(of)]))
    return order[rank < k]


def _search_group(pivots: Pivots, k: int):
    def search(queries: pa.Table, data: pa.Table) -> pa.Table:
        names = ["query", "id", "score"]
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        data = data.sort_by("gap")
        x = _unpack(data["vec"].to_pylist(), data["wide"].to_pylist())
        q = _unpack(queries["vec"].to_pylist(), queries["wide"].to_pylist())
        query_ids, beat = queries["id"].to_numpy(), queries["beat"].to_numpy()
        gap, pivot = data["gap"].to_numpy(), int(data["cell"][0].as_py()) // pivots.shells
        least_ids = data["first_id"].to_numpy()
        norm = (x * x).sum(1)
        found: list[list[np.ndarray]] = [[], [], []]
        for first in range(0, len(x), SLICE):
            part = slice(first, first + SLICE)
            bound = pivots.bounds(q, np.array([pivot]), gap[part].min(keepdims=True), gap[part].max(keepdims=True), norm[part].max(keepdims=True))[:, 0]
            active = np.flatnonzero(bound >= beat)
            if len(active):
                scores = products(q[active], x[part])
                a, b = np.nonzero(scores >= beat[active][:, None])
                for column, value in zip(found, (active[a], b + first, scores[a, b]), strict=True):
                    column.append(value)
        if not found[0]:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        of, at, scores = map(np.concatenate, found)
        best = _best(of, scores, least_ids[at], k + 1)
        of, at, scores = of[best], at[best], scores[best]
        more = data["ids"].combine_chunks()
        ends = np.asarray(more.offsets)
        sizes = np.diff(ends)[at]
        row = np.repeat(np.arange(len(at)), sizes)
        index = np.repeat(ends[at], sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = more.values.to_numpy()[index]
        keep = ids != query_ids[of[row]]
        of, ids, scores = of[row][keep], ids[keep], scores[row][keep]
        best = _best(of, scores, ids, k)
        return pa.table([query_ids[of[best]], ids[best], scores[best]], names=names)

    return search


def _place(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unpack(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                cell, gap = pivots.place(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(gap), pa.array((x * x).sum(1))], names=[*batch.schema.names, "cell", "gap", "norm"])

    return run


class Annuli:
    """What is known of each annulus: pivot, distances, greatest squared length and number of chunks."""

    def __init__(self, pivots: Pivots, facts: list) -> None:
        self.pivots = pivots
        self.cells, self.least, self.most, self.norm, count = (np.array([r[i] for r in facts]) for i in range(5))
        self.chunks = np.ceil(count / CHUNK).astype(int)

    def sorted_bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the annuli by falling bound, and the bounds."""
        bounds = self.pivots.bounds(queries, self.cells // self.pivots.shells, self.least, self.most, self.norm)
        order = np.argsort(-bounds, axis=1, kind="stable")
        return order, np.take_along_axis(bounds, order, axis=1)

    def first(self, k: int):
        """id, vec, wide, beat and home of queries: a score that k sampled vectors reach, and the annulus of the highest bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _unpack(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                scores = products(q, self.pivots.sample)
                beat = np.full(len(q), _LONG.min)
                if scores.shape[1] > k:  # a sampled vector may be the query's own
                    scores = np.where(batch.column(0).to_numpy()[:, None] == self.pivots.ids, _LONG.min, scores)
                    beat = np.partition(scores, -k, axis=1)[:, -k]
                home = self.cells[self.sorted_bounds(q)[0][:, 0]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beat), pa.array(home.astype(np.int32))], names=["id", "vec", "wide", "beat", "home"])

        return run

    def expand(self, begin: int, stop: int | None):
        """The annuli from rank `begin` to `stop` of each query's order whose bound reaches its score: id, vec, wide, beat, block, cell, chunk."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _unpack(batch.column("vec").to_pylist(), batch.column("wide").to_pylist())
                order, bounds = self.sorted_bounds(q)
                reach = bounds[:, begin:stop] >= batch.column("beat").to_numpy()[:, None]
                a, at = np.nonzero(reach)
                b = order[:, begin:stop][a, at]
                repeat = self.chunks[b]
                a, b = np.repeat(a, repeat), np.repeat(b, repeat)
                chunk = np.arange(len(a)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                own = batch.select(["id", "vec", "wide", "beat", "block"]).take(pa.array(a))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(self.cells[b].astype(np.int32)), pa.array(chunk.astype(np.int32))], names=[*own.schema.names, "cell", "chunk"])

        return run


def asked_chunks(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the index once for each block of queries that asks for their chunk; no others move."""
    wanted = stage(asked.select("cell", "chunk", "block").distinct(), "asked-chunks")
    return index.join(wanted, ["cell", "chunk"])


def top_k(vectors: DataFrame, k: int = 20, query_every: int = 20, key: str = "vec_id", column: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by query_every."""
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, key, column, scale).distinct(), "vectors")
    first = Window.partitionBy("vec", "wide").orderBy("id")
    distinct = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)  # limited before the shuffle
    distinct = stage(distinct.groupBy("vec", "wide").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("first_id", F.array_min("ids")), "distinct-vectors")

    drawn = distinct.select("vec", "wide", "first_id").orderBy(F.xxhash64("vec"), "vec", "wide").limit(SAMPLE).collect()
    if not drawn:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    wanted = min(MOST_PIVOTS, max(PIVOTS, int(distinct.count() ** 0.5) // 16))
    pivots = Pivots(_unpack([bytes(r.vec) for r in drawn], [r.wide for r in drawn]), np.array([r.first_id for r in drawn]), wanted)

    placed = "vec binary, wide boolean, ids array<bigint>, first_id bigint, cell int, gap double, norm double"
    index = stage(distinct.select("vec", "wide", "ids", "first_id").mapInArrow(_place(pivots), placed), "index")
    facts = index.groupBy("cell").agg(F.min("gap").alias("least"), F.max("gap").alias("most"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()  # at most MOST_PIVOTS * SHELLS rows
    annuli = Annuli(pivots, facts)
    chunks = spark.createDataFrame([(int(c), int(n)) for c, n in zip(annuli.cells, annuli.chunks, strict=True)], "cell int, chunks int")
    index = index.join(F.broadcast(chunks), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec"), F.col("chunks")).cast("int")).drop("chunks")  # one row for each annulus

    routed = "id bigint, vec binary, wide boolean, beat bigint, home int"
    queries = stage(rows.where(F.col("id") % query_every == 0).mapInArrow(annuli.first(k), routed), "queries")
    shares = queries.groupBy("home").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("shares"))  # one row for each annulus at most
    block = F.struct(F.col("home"), F.pmod(F.xxhash64("id", "vec"), F.col("shares")).cast("int").alias("share"))
    queries = stage(queries.join(F.broadcast(shares), "home").select("id", "vec", "wide", "beat", F.to_json(block).alias("block")), "query-blocks")

    keys = ["cell", "chunk", "block"]
    searched = "id bigint, vec binary, wide boolean, beat bigint, block string, cell int, chunk int"
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    found = None
    for begin, stop in ((0, 1), (1, 1 + STEPS), (1 + STEPS, None)):
        if begin >= len(annuli.cells):
            break
        asked = stage(queries.mapInArrow(annuli.expand(begin, stop), searched), "asked")
        met = asked.groupBy(keys).cogroup(asked_chunks(index, asked).groupBy(keys)).applyInArrow(_search_group(pivots, k), "query bigint, id bigint, score bigint")
        found = met if found is None else found.union(met)
        found = stage(found.distinct().withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "found").select("query", "id", "score", "rank")
        reached = found.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").alias("reached"))
        queries = stage(queries.join(reached, "id", "left").select("id", "vec", "wide", F.greatest("beat", "reached").alias("beat"), "block"), "queries")
        found = found.select("query", "id", "score")
    best = found.withColumn("rank", F.row_number().over(ranked))
    return best.select(F.col("query").alias("query_id"), F.col("rank").cast("int"), F.col("id").alias("vec_id"), "score")


def op3_exact_search(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
