"""Aggregates over vectors and over results: centre, medoid, degrees, recall, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.metrics import Metric, doubles, metric


def centroid(vectors: DataFrame) -> DataFrame:
    """One row (centroid): the mean of each dimension, summed in decimals so that the order of rows doesn't show."""
    parts = vectors.select(F.posexplode(doubles("embedding")).alias("pos", "x"))
    means = parts.groupBy("pos").agg((F.sum(F.col("x").cast("decimal(38,18)")).cast("double") / F.count("*")).alias("x"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def medoid(vectors: DataFrame, by: str | Metric = "l2") -> DataFrame:
    """One row (vec_id, dist): the row nearest to the centroid, the first id among equals."""
    rows = vectors.select("vec_id", doubles("embedding").alias("e")).join(F.broadcast(centroid(vectors)))  # one row
    return rows.agg(F.min(F.struct(metric(by).column(F.col("centroid"), F.col("e")).alias("dist"), "vec_id")).alias("m")).select("m.vec_id", "m.dist")


def value_range(vectors: DataFrame) -> DataFrame:
    """One row (lo, hi): the least and the greatest element of all."""
    return vectors.agg(F.min(F.array_min(doubles("embedding"))).alias("lo"), F.max(F.array_max(doubles("embedding"))).alias("hi"))


def nearest_of_each(candidates: DataFrame) -> DataFrame:
    """candidates(q_id, vec_id, dist) with each id once, at its least distance."""
    return candidates.groupBy("q_id", "vec_id").agg(F.min("dist").alias("dist"))


def in_degrees(edges: DataFrame) -> DataFrame:
    """(vec_id, in_degree, sources) of edges(vec_id, neighbors)."""
    flat = edges.select("vec_id", F.explode("neighbors").alias("to"))
    return flat.groupBy(F.col("to").alias("vec_id")).agg(F.count("*").alias("in_degree"), F.array_sort(F.collect_list("vec_id")).alias("sources"))


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(q_id, recall): the share of the truth's first k that the results' first k hold."""
    hit = results.where(F.col("rank") <= k).select("q_id", "vec_id").withColumn("hit", F.lit(1))
    return truth.where(F.col("rank") <= k).join(hit, ["q_id", "vec_id"], "left").groupBy("q_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def radius_recall(results: DataFrame, truth: DataFrame, k: int, slack: float = 0.0) -> DataFrame:
    """(q_id, recall): the share of k results no farther than the truth's k-th, which credits ties."""
    far = truth.where(F.col("rank") <= k).groupBy("q_id").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
    near = results.where(F.col("rank") <= k).join(far, "q_id", "right").groupBy("q_id", "n").agg(F.sum(F.when(F.col("dist") <= F.col("far") + slack, 1).otherwise(0)).alias("hits"))
    return near.select("q_id", (F.least("hits", "n") / F.col("n")).alias("recall"))


def percentiles(times: DataFrame, column: str, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: the exact percentiles of a column, its mean, and rows a second if the column is seconds."""
    parts = [F.percentile(column, F.lit(p)).alias(f"p{p * 100:g}") for p in shares]
    return times.agg(*parts, F.avg(column).alias("mean"), (F.count("*") / F.sum(column)).alias("per_second"))
