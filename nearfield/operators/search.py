"""Exact top-k: the relation that every index approximates.

Collections are DataFrames (vec_id, embedding[, labels]), queries (q_id, q_vec), results (q_id, rank, vec_id, dist) with ties by
id. A stated set of queries meets all rows in blocks: the queries travel to the rows' partitions, each partition keeps
its k best for each query, and only those are shuffled, so moved data grows with queries and partitions, not with rows.
Query sets beyond QUERY_BYTES are taken in several blocks, one after the other, each with a scan of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.metrics import Metric, doubles, metric
from nearfield.functions.predicates import Predicate
from nearfield.sources.workdir import fresh

#: Bytes of query vectors that are sent to the workers at once, and distances computed at once.
QUERY_BYTES, AT_ONCE = 64 << 20, 1 << 22
#: Queries that knn_columns takes at most.
FEW = 10_000


def matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None) -> np.ndarray:
    """Vectors of an Arrow list column as rows; all of one length, or of dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("a vector is null")
    sizes = np.asarray(column.value_lengths())
    dim = dim if dim is not None else int(sizes[0]) if len(sizes) else 0
    if (sizes != dim).any():
        raise ValueError(f"a vector has {int(sizes[sizes != dim][0])} dimensions, not {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Best:
    """The k nearest rows seen so far for each query; room is taken as rows come, so k may exceed them. A distance that isn't a number is none."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.empty(0, dtype=np.int64) for _ in range(queries)]
        self.dist = [np.empty(0) for _ in range(queries)]

    def bound(self, q: int) -> float:
        """The distance that a row may not exceed to be taken."""
        return float(self.dist[q][-1]) if len(self.dist[q]) == self.k else math.inf

    def add(self, q: int, ids: np.ndarray, dist: np.ndarray) -> None:
        there = ~np.isnan(dist)
        ids, dist = np.concatenate([self.ids[q], ids[there]]), np.concatenate([self.dist[q], dist[there]])
        order = np.lexsort((ids, dist))[: self.k]
        self.ids[q], self.dist[q] = ids[order], dist[order]

    def table(self, q_ids: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(q_ids, [len(x) for x in self.ids])
        ids, dist = (np.concatenate(x) if x else np.empty(0, kind) for x, kind in ((self.ids, np.int64), (self.dist, np.float64)))
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(ids), pa.array(dist)], names=["q_id", "vec_id", "dist"])


def scan(q: np.ndarray, x: np.ndarray, ids: np.ndarray, m: Metric, best: Best) -> None:
    """Offer rows to the queries' best: BLAS names the candidates, the exact kernel decides. Where BLAS gives no finite number the kernel is always asked."""
    if not len(ids) or not best.k:
        return
    step = max(1, AT_ONCE // max(1, len(x)))
    with np.errstate(invalid="ignore", over="ignore"):
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            near = m.exact(part[:, None, :], x[None, :, :]) if m.rough is None else m.rough(part, x)
            sure = np.isfinite(near)
            slack = 0.0 if m.rough is None else 1e-9 * (1 + float(np.abs(near).max(initial=0, where=sure)))
            k = min(best.k, len(ids))
            limit = np.partition(np.where(sure, near, np.inf), k - 1, axis=1)[:, k - 1]
            for i in range(len(part)):
                rows = np.flatnonzero((near[i] <= min(limit[i], best.bound(lo + i)) + slack) | ~sure[i])
                if len(rows):
                    best.add(lo + i, ids[rows], m.exact(part[i][None], x[rows]))


def _nearest(batches: Iterator[pa.RecordBatch], queries, k: int, name: str | Metric) -> Iterator[pa.RecordBatch]:
    q_ids, q = queries.value
    m, best = metric(name), Best(len(q_ids), k)
    for batch in batches:
        if len(batch):
            scan(q, matrix(batch.column(1), q.shape[1]), batch.column(0).to_numpy(), m, best)
    yield best.table(q_ids)


def query_blocks(queries: DataFrame, block_bytes: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries in blocks of bounded size."""
    ids, rows, dim = [], [], None
    for r in queries.select(F.col("q_id").cast("long"), doubles("q_vec").alias("q_vec")).toLocalIterator(prefetchPartitions=True):
        if r.q_vec is None or dim not in (None, len(r.q_vec)):
            raise ValueError("query vectors are null or differ in dimensions")
        dim = len(r.q_vec)
        ids.append(r.q_id)
        rows.append(r.q_vec)
        if len(rows) * dim * 8 >= block_bytes:
            yield np.array(ids, dtype=np.int64), np.array(rows)
            ids, rows = [], []
    if rows:
        yield np.array(ids, dtype=np.int64), np.array(rows)


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """(q_id, rank, vec_id, dist): the k nearest of candidates(q_id, vec_id, dist) for each query."""
    order = Window.partitionBy("q_id").orderBy("dist", "vec_id")
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q_id", "rank", "vec_id", "dist")


def live(vectors: DataFrame, predicate: Predicate | None = None, deleted: DataFrame | None = None, labels: str = "labels") -> DataFrame:
    """The rows that a search may return: matching and not deleted. Both are applied before any distance."""
    if predicate is not None and not predicate.always:
        vectors = vectors.where(predicate.column(F.col(labels)))
    return vectors if deleted is None else vectors.join(deleted.select("vec_id").distinct(), "vec_id", "left_anti")


def block_by_block(queries: DataFrame, k: int, work: Callable[[tuple[np.ndarray, np.ndarray], Callable], DataFrame], block_bytes: int = QUERY_BYTES) -> DataFrame:
    """top_k of work(block, send) for every block of queries; send broadcasts what the block's tasks need.

    One block stays a plan. Of several, each is run and written to the shared folder before the next is read, and what it sent is freed, so neither
    the driver nor an executor holds more than a block.
    """
    spark, schema = queries.sparkSession, "q_id long, rank int, vec_id long, dist double"
    blocks, sent, paths = query_blocks(queries, block_bytes), [], []

    def send(value):
        sent.append(spark.sparkContext.broadcast(value))
        return sent[-1]

    block, after = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], schema)
    if after is None:
        return top_k(work(block, send), k)
    while block is not None:
        paths.append(fresh(spark, "block"))
        top_k(work(block, send), k).write.parquet(paths[-1])
        while sent:
            sent.pop().destroy()
        block, after = after, next(blocks, None)
    return spark.read.schema(schema).parquet(*paths)


def in_blocks(queries: DataFrame, rows: DataFrame, work: Callable, k: int, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """top_k of work(batches, queries=...) over rows for every block of queries."""
    return block_by_block(queries, k, lambda block, send: rows.mapInArrow(partial(work, queries=send(block)), "q_id long, vec_id long, dist double"), block_bytes)


def knn(vectors: DataFrame, queries: DataFrame, k: int, by: str | Metric = "l2", predicate: Predicate | None = None, deleted: DataFrame | None = None, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """Exact top-k of the live rows for every query: exactly min(k, rows) of them. k = 0 gives none.

    An infinite distance counts as any other; a row whose distance isn't a number (a component is NaN, or infinite in both) is left out
    of that query's result. Null vectors and vectors of other dimensions than the queries' are errors. Ties go to the smaller id.
    """
    if k < 0:
        raise ValueError("k is negative")
    m = metric(by)
    rows = live(vectors, predicate, deleted).select(F.col("vec_id").cast("long"), doubles("embedding").alias("embedding"))
    return in_blocks(queries, rows, partial(_nearest, k=k, name=m if by is m else m.name), k, block_bytes)


def knn_columns(vectors: DataFrame, queries: DataFrame, k: int, by: str | Metric = "l2", predicate: Predicate | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The same relation in Catalyst expressions alone, for a stated set of at most FEW queries, whose side is broadcast."""
    rows = live(vectors, predicate, deleted).select("vec_id", doubles("embedding").alias("e"))
    few = queries.select("q_id", doubles("q_vec").alias("q"))
    if few.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} queries; knn takes any number")
    pairs = rows.join(F.broadcast(few))
    return top_k(pairs.select("q_id", "vec_id", metric(by).column(F.col("q"), F.col("e")).alias("dist")).where(~F.isnan("dist")), k)


def rescored(candidates: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, by: str | Metric = "l2") -> DataFrame:
    """Exact distances of candidates(q_id, vec_id), and the k nearest: an equi-join to the vectors by id."""
    rows = candidates.select("q_id", "vec_id").join(vectors.select("vec_id", doubles("embedding").alias("e")), "vec_id").join(queries.select("q_id", doubles("q_vec").alias("q")), "q_id")
    return top_k(rows.select("q_id", "vec_id", metric(by).column(F.col("q"), F.col("e")).alias("dist")), k)
