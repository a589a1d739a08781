"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Word unigrams and bigrams are hashed into BUCKETS buckets. Raw counts come from every document, target counts from a
bounded sample of the documents that are labelled good; both models are smoothed, and a document's log weight is the log of its
probability under the target's model less that under the raw text's, the sum of its n-grams' log ratios. Adding Gumbel noise from a hash of the id
and keeping the k largest keys draws k documents without replacement in proportion to their weights. The k-th key is
found exactly, 16 bits of it at a time, by counts of at most 65,536 prefixes; no key is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import U, chunks, mix, shingle_hashes, utf8, word_hashes

#: Buckets of the models, labelled documents that are read at most, and counts added to each bucket.
BUCKETS, LABELLED, SMOOTH = 1 << 14, 20_000, 1.0


def buckets(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, n + 1 offsets of the texts' n-grams): every word, and every pair of neighbours."""
    pairs, at = shingle_hashes(words, bounds, 2)
    sizes = np.diff(bounds)
    alone = at[:-1][sizes == 1]  # a text of one word has no pair
    keep = np.ones(len(pairs), dtype=bool)
    keep[alone] = False
    owner = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), np.diff(at))[keep]])
    both = np.concatenate([mix(words ^ U(0x5555)), pairs[keep]]) & U(BUCKETS - 1)
    order = np.argsort(owner, kind="stable")
    return both[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(sizes) + 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, good) to (bucket, raw, target), once for the task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi in chunks(offsets):
                found, at = buckets(*word_hashes(data, offsets, lo, hi, letters=True))
                raw += np.bincount(found, minlength=BUCKETS)
                chosen = np.repeat(good[lo:hi], np.diff(at))
                if chosen.any():
                    target += np.bincount(found[chosen], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def _weigh(batches: Iterator[pa.RecordBatch], ratio) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            weight = np.zeros(len(batch))
            for lo, hi in chunks(offsets):
                found, at = buckets(*word_hashes(data, offsets, lo, hi, letters=True))
                if len(found):
                    weight[lo:hi] = np.add.reduceat(ratio.value[found], np.minimum(at[:-1], len(found) - 1)) * (np.diff(at) > 0)
            ids = batch.column(0)
            seeds = np.array([0 if x is None else x for x in ids.to_pylist()], dtype=np.int64).view(np.uint64)
            u = (mix(seeds * U(0x9E3779B97F4A7C15) + U(29)) >> U(11)).astype(np.float64)
            gumbel = -np.log(-np.log((u + 0.5) / 2.0**53))
            key = weight + gumbel
            yield pa.RecordBatch.from_arrays([ids, pa.array(weight), pa.array(key), pa.array(places(key))], names=["doc_id", "log_weight", "key", "place"])


def places(key: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of finite doubles, equal just where they are."""
    bits = (key + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64((1 << 63) - 1), bits)


def log_ratios(texts: DataFrame) -> np.ndarray:
    """The log of target over raw share of each bucket, from texts(text, good)."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in texts.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))


def kth_largest(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(v, m) for a bigint column: k rows are those above v and m of the rows equal to v. 1 <= k <= rows."""
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = rows if prefix is None else rows.where(F.shiftright(column, shift + 16) == prefix)
        counts = {r[0]: r[1] for r in part.groupBy(F.shiftright(column, shift).alias("p")).count().collect()}
        for p in sorted(counts, reverse=True):
            if left <= counts[p]:
                prefix = p
                break
            left -= counts[p]
    return prefix, left


def resampled(docs: DataFrame, labels: DataFrame, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, log_weight, key, selected) for every row of docs: ceil(share * rows) are drawn.

    The target is the text of rows labelled 1 (of at most LABELLED labels, by a hash of the id); without any, all weights
    are 0. A null or empty text has the log weight 0; whole texts count, so a long one's may be large either way. Rows that repeat an id have equal noise; ties of the key go to the smaller id,
    and rows that tie in both are drawn together, which may exceed the number by their repeats. A null id draws as 0 does.
    Null labels aren't good; an empty table gives an empty one; other columns are passed over.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "resample")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(LABELLED).withColumn("good", F.lit(True))
    texts = rows.join(F.broadcast(good), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    ratio = spark.sparkContext.broadcast(log_ratios(texts))
    weighed = scratch.table(rows.mapInArrow(partial(_weigh, ratio=ratio), "doc_id long, log_weight double, key double, place long"), "weighed")
    total = weighed.count()
    if not total:
        return weighed.select("doc_id", "log_weight", "key", F.lit(False).alias("selected"))
    cut, ties = kth_largest(weighed, "place", int(np.ceil(share * total)))
    same = weighed.where(F.col("place") == cut).select((-F.coalesce("doc_id", F.lit(0))).alias("negative"))
    last, _ = kth_largest(same, "negative", ties)
    chosen = (F.col("place") > cut) | ((F.col("place") == cut) & (-F.coalesce("doc_id", F.lit(0)) >= last))
    return weighed.select("doc_id", "log_weight", "key", chosen.alias("selected"))
