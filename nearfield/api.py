"""The library's classes for lists of vectors: small conveniences over the DataFrame operators.

Ids are positions in the list a collection is built from. A search of one query returns [(id, distance)], a batch a list of
them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from nearfield.functions.metrics import engine_info, metric, register
from nearfield.functions.predicates import Predicate
from nearfield.operators.compressed import CompressedIndex
from nearfield.operators.graph import GraphIndex
from nearfield.operators.layered import LayeredIndex
from nearfield.operators.postings import PostingIndex
from nearfield.operators.search import knn
from nearfield.sources.vecs import read as read_vecs
from nearfield.sources.vecs import write as write_vecs

__all__ = ["CompressedIndex", "GraphIndex", "LayeredIndex", "PostingIndex", "Predicate", "engine_info", "knn", "metric", "queries", "read_vecs", "register", "search", "search_batch", "search_ids", "vectors", "write_vecs"]


def vectors(spark: SparkSession, rows: Sequence[Sequence[float]], labels: Sequence[Sequence[int]] | None = None, first: int = 0) -> DataFrame:
    """(vec_id, embedding[, labels]) from lists."""
    if labels is not None and len(labels) != len(rows):
        raise ValueError("there must be a row of labels for each vector")
    if labels is not None and any(not 0 <= x < 1 << 63 for row in labels for x in row):
        raise ValueError("labels are whole numbers from 0 below 2^63")
    if labels is None:
        return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")
    return spark.createDataFrame([(first + i, [float(x) for x in v], [int(x) for x in w]) for i, (v, w) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<float>, labels array<long>")


def queries(spark: SparkSession, rows: Sequence[Sequence[float]]) -> DataFrame:
    """(q_id, q_vec) from lists."""
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "q_id long, q_vec array<double>")


def search_batch(index, rows: Sequence[Sequence[float]], k: int = 10, **options) -> list[list[tuple[int, float]]]:
    """The results of every query, in their order."""
    out: list[list[tuple[int, float]]] = [[] for _ in rows]
    for r in index.search(queries(index.spark, rows), k, **options).orderBy("q_id", "rank").collect():
        out[r.q_id].append((r.vec_id, r.dist))
    return out


def search(index, row: Sequence[float], k: int = 10, **options) -> list[tuple[int, float]]:
    return search_batch(index, [row], k, **options)[0]


def search_ids(index, row: Sequence[float], k: int = 10, **options) -> list[int]:
    return [i for i, _ in search(index, row, k, **options)]
