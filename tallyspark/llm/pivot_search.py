"""Exact top-k inner products by a pivot-distance index.

Vectors of whole numbers are keyed by their nearest pivot and their distance to it. A pivot's vectors, by distance, form
annuli (rings of equal width, the last one open), and an annulus is stored in chunks of bounded size, so many equal vectors
spread over chunks. For a query, the triangle inequality bounds the distance to any vector of an annulus from below, and
with the largest norm there the inner product from above: (n² + |q|² - gap²) / 2, and n |q|.

A query expands the annuli in falling order of that bound: first one chunk of each until ``SEED`` vectors are seen, whose
k-th score is a threshold; then all annuli whose bound reaches it. The others cannot hold a result, so they are never
read. Queries travel to the chunks they need; a chunk is held once while its queries stream past it.

The pivots are a bounded sample; all vectors are indexed. Pivots and the table of annuli have at most ``MAX_PIVOTS`` and
``MAX_PIVOTS * RINGS`` rows, whatever the data, and go to all tasks.

Vectors that are null or hold null or non-finite components take no part. A vector shorter than the longest counts as
padded with zeros. Repeated rows are so many candidates; a query id that repeats searches with its smallest vector. A null
id is no query and no candidate. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.plans.lineage import cut
from tallyspark.sources.tables import spread

MAX_PIVOTS, RINGS = 128, 8
CHUNK = 4096  # vectors scored as one matrix
SEED = 512  # vectors seen before the threshold is taken, at least
EXACT = 2.0**53


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, width)


def whole_vectors(vectors: DataFrame, scale: int, id: str, embedding: str) -> tuple[DataFrame, int]:
    """``id`` and ``v`` (binary, 64-bit whole numbers ``floor(scale * x)``), and the number of components."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(embedding).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.filter(F.col(id).isNotNull() & usable).select(F.col(id).cast("long").alias("id"), x.alias("x"))
    width = max(1, good.agg(F.max(F.size("x"))).first()[0] or 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(lists), width))
            out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
            whole = np.floor(out * scale).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in whole], pa.binary())], names=["id", "v"])

    return spread(good).mapInArrow(run, "id long, v binary"), width


class Annuli:
    """The fixed-size tables that every task gets: pivots, and per annulus its distances, largest norm and rows."""

    def __init__(self, pivots: np.ndarray, step: float):
        self.pivots, self.step = pivots.astype(np.float64), step
        self.square = (self.pivots**2).sum(1)

    def distances(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(np.float64)
        return np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] + self.square - 2 * v @ self.pivots.T))

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Annulus of each vector, and its distance to the pivot."""
        d = self.distances(v)
        near = d.argmin(1)
        own = d[np.arange(len(v)), near]
        return near * RINGS + np.minimum(own // self.step, RINGS - 1).astype(np.int64), own

    def keep(self, rows: list) -> None:
        self.key, self.low, self.high, self.norm, self.rows = (np.array(c, np.float64) for c in zip(*rows)) if rows else (np.zeros(0),) * 5
        self.key, self.rows = self.key.astype(np.int64), self.rows.astype(np.int64)
        self.chunks = -(-self.rows // CHUNK)

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product of each query with any vector of each annulus, with room for rounding."""
        d = self.distances(v)[:, self.key // RINGS]
        gap = np.maximum(0, np.maximum(self.low - d, d - self.high) - 1e-6 * (1 + d))
        size = np.sqrt((v.astype(np.float64) ** 2).sum(1))[:, None]
        top = np.minimum((self.norm**2 + size**2 - gap**2) / 2, self.norm * size)
        return top + 1e-6 * (1 + np.abs(top) + self.norm * size)


def build(vectors: DataFrame, width: int) -> tuple[DataFrame, Annuli]:
    """Chunks (``key``, ``chunk``, ``ids``, ``v``), and the annuli."""
    n = vectors.count()
    wanted = min(MAX_PIVOTS, max(4, 2 ** round(np.log2(max(1, n) / 8192 + 1))))
    sample = vectors.orderBy(F.xxhash64("id", "v")).limit(8 * wanted).select("v").toArrow()  # bounded: 8 * MAX_PIVOTS
    rows = np.unique(_matrix(sample.column(0), width), axis=0) if n else np.zeros((1, width), np.int64)
    rows = rows[np.random.default_rng(1).permutation(len(rows))]
    annuli = Annuli(rows[:wanted], 1.0)
    spread_of = annuli.distances(rows).min(1)
    annuli.step = max(1.0, float(spread_of.max()) / (RINGS - 1))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(1), width)
            at, d = annuli.keys(v)
            size = np.sqrt((v.astype(np.float64) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at), pa.array(d), pa.array(size)], names=["id", "v", "key", "d", "size"])

    keyed = vectors.mapInArrow(key, "id long, v binary, key long, d double, size double")
    annuli.keep([tuple(r) for r in keyed.groupBy("key").agg(F.min("d"), F.max("d"), F.max("size"), F.count("*")).collect()])  # at most MAX_PIVOTS * RINGS rows
    if not n:
        return keyed.selectExpr("key", "0 AS chunk", "v AS ids", "v"), annuli
    pieces = F.element_at(F.create_map(*[F.lit(int(x)) for k, c in zip(annuli.key, annuli.chunks) for x in (k, c)]), F.col("key"))
    dealt = keyed.select("id", "v", "key", F.pmod(F.xxhash64("id", "v"), pieces).cast("int").alias("chunk"))

    def gather(group: pa.Table) -> pa.Table:
        one = [pa.array([group.column(c)[0].as_py()], t) for c, t in (("key", pa.int64()), ("chunk", pa.int32()))]
        ids, v = group.column("id").to_numpy().tobytes(), b"".join(group.column("v").to_pylist())
        return pa.table([*one, pa.array([ids], pa.binary()), pa.array([v], pa.binary())], names=["key", "chunk", "ids", "v"])

    return cut(dealt.groupBy("key", "chunk").applyInArrow(gather, "key long, chunk int, ids binary, v binary")), annuli


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _visit(chunks: DataFrame, wanted: DataFrame, width: int, k: int) -> DataFrame:
    """The best ``k`` of each chunk for each query that wants it: ``query_id, vec_id, score``."""
    blocks = chunks.select("key", "chunk", F.lit(None).cast("long").alias("query"), "ids", "v")
    asks = wanted.select("key", "chunk", F.col("id").alias("query"), F.lit(None).cast("binary").alias("ids"), "v")
    rows = blocks.union(asks).repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.col("query").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = v = None
        for batch in batches:
            head = np.flatnonzero(batch.column(2).is_null().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *head], [*head, batch.num_rows]):
                if a in head:
                    ids, v = np.frombuffer(batch.column(3)[a].as_py(), np.int64), np.frombuffer(batch.column(4)[a].as_py(), np.int64).reshape(-1, width)
                    order = np.argsort(ids, kind="stable")
                    ids, v = ids[order], v[order]
                    a += 1
                for x in range(a, b, 256):
                    part = batch.slice(x, min(256, b - x))
                    own = part.column(2).to_numpy()
                    s = _scores(_matrix(part.column(4), width), v)
                    out = [], [], []
                    for i in range(len(own)):
                        at = np.flatnonzero(ids != own[i])
                        if len(at) > k:  # all that reach the k-th score, then the smaller ids of those
                            line = s[i, at]
                            at = at[line >= np.partition(line, len(line) - k)[len(line) - k]]
                        best = at[np.argsort(-s[i, at], kind="stable")[:k]]
                        out[0].append(np.full(len(best), own[i]))
                        out[1].append(ids[best])
                        out[2].append(s[i, best])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score long")


def _asks(queries: DataFrame, annuli: Annuli, width: int, choose: Callable[[np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """Rows (``id, v, key, chunk``) for the chunks that ``choose`` names for each query, from its bounds and threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                for i, at, chunk in choose(annuli.bounds(_matrix(part.column(1), width)), part.column(2).to_numpy(zero_copy_only=False)):
                    take = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(annuli.key[at]), pa.array(chunk.astype(np.int32))], names=["id", "v", "key", "chunk"])

    return queries.mapInArrow(run, "id long, v binary, key long, chunk int")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products, ties to the smaller id, itself left out."""
    whole, width = whole_vectors(vectors, scale, id, embedding)
    whole = cut(whole)
    chunks, annuli = build(whole, width)
    ids = vectors.filter(is_query).select(F.col(id).cast("long").alias("id")).distinct()
    queries = cut(whole.join(ids, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))

    def first(bounds: np.ndarray, _: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.argsort(-bounds, 1)
        seen = np.cumsum(np.minimum(annuli.rows[order], CHUNK // 2), 1)
        for i in range(len(bounds)):
            at = order[i, : int(np.searchsorted(seen[i], SEED)) + 1]
            yield i, at, np.zeros(len(at))

    def rest(bounds: np.ndarray, threshold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        order = np.argsort(-bounds, 1)
        seen = np.cumsum(np.minimum(annuli.rows[order], CHUNK // 2), 1)
        for i in range(len(bounds)):
            begun = order[i, : int(np.searchsorted(seen[i], SEED)) + 1]
            at = np.flatnonzero(bounds[i] >= threshold[i])
            skip = np.isin(at, begun).astype(np.int64)  # their first chunk was seen
            n = annuli.chunks[at] - skip
            chunk = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(skip, n)
            yield i, np.repeat(at, n), chunk

    none = F.lit(float("-inf"))
    seeds = cut(_best(_visit(chunks, _asks(queries.withColumn("t", none), annuli, width, first), width, k), k))
    least = seeds.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("t"))
    open_queries = queries.join(least, "id", "left").select("id", "v", F.coalesce("t", none).alias("t"))
    more = _visit(chunks, _asks(open_queries, annuli, width, rest), width, k)
    return _best(seeds.drop("rank").union(more), k).select("query_id", "rank", "vec_id", "score")
