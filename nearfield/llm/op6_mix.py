"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, cut at the budget.

Documents of a source are put in the order of a hash of their id. Hashes are uniform, so equal ranges of them are equal
shares of the source: (source, range) is a partition that no hot source can overfill, and the number of ranges follows the
source's row count. Words are summed along each range, and each range's start comes from the totals of the ranges before
it, a table of one row for every ROWS documents, summed in blocks of GROUPED and then over the blocks. Whole epochs of a source are taken first;
the last, partial one is cut at the exact word. Targets are worked out on the driver for up to MAX_SOURCES sources, and by distributed prefix sums beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Scratch
from .textkit import count_words

#: Documents of a source in one range of hashes, about, and ranges of a source in a block.
ROWS, GROUPED = 4096, 4096
#: Sources whose totals the driver may hold.
MAX_SOURCES = 1_000_000
#: Sources up to which their targets are broadcast.
BROADCAST_SOURCES = 10_000


def fill(sizes: list[int], share: float, most: float, weights: tuple[int, ...]) -> list[float]:
    """Targets of sources, given in their order: share * sum(sizes) dealt by weight, none above most * its size."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weight[i], i))
    left, rest, out = share * sum(sizes), sum(weight), [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = left / rest
        if most * sizes[i] > level * weight[i]:
            for j in order[k:]:
                out[j] = level * weight[j]
            break
        out[i] = most * sizes[i]
        left, rest = left - most * sizes[i], rest - weight[i]
    return out


def running(rows: DataFrame, order: list, values: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with before_<value> for each value: its sum over the rows that come before in the order. Range-sorted parts are summed apart; the driver gets a row for each."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = scratch.table(parts, name)
    starts, sums = [], [0] * len(values)
    for r in sorted(parts.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values)).collect()):
        starts.append((r[0], *sums))
        sums = [a + b for a, b in zip(sums, r[1:], strict=True)]
    kinds = [dict(rows.dtypes)[v] for v in values]
    table = rows.sparkSession.createDataFrame(starts, ", ".join(["_part int", *(f"_start_{v} {k}" for v, k in zip(values, kinds, strict=True))]))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.join(F.broadcast(table), "_part")
    return out.select(*rows.columns, *((F.col(f"_start_{v}") + F.coalesce(F.sum(v).over(before), F.lit(0))).alias(f"before_{v}") for v in values))


def planned(totals: DataFrame, share: float, most: float, weights: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """What `fill` gives and the rest of the plan, for totals(source, source_size, rows) of any number of sources; the driver holds a few numbers."""
    order = [F.col("source").isNull(), F.col("source")]
    made = running(totals.withColumn("one", F.lit(1).cast("long")), order, ["one"], scratch, "by-name").withColumnRenamed("before_one", "source_no")
    made = made.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))).drop("one")
    order = [F.lit(most) * F.col("source_size") / F.col("weight"), F.col("source_no")]
    made = scratch.table(running(made, order, ["source_size", "weight"], scratch, "by-level"), "levels")
    whole = made.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(share * whole["size"]) - F.lit(most) * F.col("before_source_size")) / (F.lit(whole["weight"]) - F.col("before_weight"))
    made = made.withColumn("level", level).withColumn("place", F.struct(order[0].alias("a"), order[1].alias("b")))
    free = made.where(F.lit(most) * F.col("source_size") > F.col("level") * F.col("weight")).agg(F.min(F.struct("place", "level")).alias("first")).first()["first"]
    target = F.lit(most) * F.col("source_size")
    if free is not None:
        kept = (order[0] < free.place.a) | ((order[0] == free.place.a) & (order[1] < free.place.b))
        target = F.when(kept, target).otherwise(F.lit(free.level) * F.col("weight"))
    turns = F.when(F.col("source_size") > 0, F.floor(target / F.col("source_size"))).otherwise(0)
    ranges = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1), F.floor((F.col("rows") - 1) / ROWS) + 1)))).cast("long")
    made = made.select(F.col("source_no").cast("int"), "source", "source_size", target.cast("double").alias("target"), turns.cast("long").alias("turns"), ranges.alias("ranges"))
    return scratch.table(made.withColumn("rest", F.floor("target").cast("long") - F.col("turns") * F.col("source_size")), "plan")


def _sizes(batches: Iterator[pa.RecordBatch], text: int | None) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the text, by its words; with `text` the text is that field of the last column, a whole row, which stays."""
    for batch in batches:
        last = batch.column(batch.num_columns - 1)
        size = pa.array(count_words(last if text is None else last.field(text)))
        kept = batch.columns[:-1] if text is None else batch.columns
        yield pa.RecordBatch.from_arrays([*kept, size], names=[*batch.schema.names[: len(kept)], "size"])


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = "mix", whole: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size counts ``[^\\x20\\x09-\\x0D]+`` in the whole text, however long (null or empty text: 0). Sources are taken in code-point order,
    null last, with `weights` in turn. taken counts the words the mix takes of the row, repeats included; a source's sum to its target
    but for a fraction of a word. Equal input gives equal output. A row with a null id has its place by a hash of its text. Rows that
    repeat an id are rows of their own, in the order of their sizes, and where all values are equal, interchangeable. An empty table
    gives an empty one. Other columns are passed over.

    whole gives all columns of docs and then size, source_size, target and taken, which replace columns of those names.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mix")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    key = [F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")).alias("hash")]
    rows = docs.select(*key, F.col(text_col).alias("text")).mapInArrow(partial(_sizes, text=None), "doc_id long, source string, hash string, size long")
    rows = scratch.table(rows, "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    totals = sums.limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        plan = planned(sums, share, most, weights, scratch)
    else:
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        targets, plan = fill([r.source_size for r in totals], share, most, weights), []
        for i, (r, target) in enumerate(zip(totals, targets, strict=True)):
            turns = int(target // r.source_size) if r.source_size else 0
            plan.append((i, r.source, r.source_size, float(target), turns, int(target) - turns * r.source_size, 1 << max(0, (r.rows - 1) // ROWS).bit_length()))
        plan = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, turns long, rest long, ranges long")
    plan = F.broadcast(plan) if len(totals) <= BROADCAST_SOURCES else plan

    def keyed(rows: DataFrame, *more: str) -> DataFrame:
        found = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("doc_id", "size", "hash", "source_no", "source_size", "target", "turns", "rest", "ranges", *more)
        return found.withColumn("range", F.expr("cast(conv(substr(hash, 1, 8), 16, 10) as bigint) * ranges div 4294967296"))

    starts = keyed(rows).groupBy("source_no", "range").agg(F.sum("size").alias("in_range")).withColumn("block", F.floor(F.col("range") / GROUPED))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = starts.groupBy("source_no", "block").agg(F.sum("in_range").alias("in_block"))
    blocks = blocks.select("source_no", "block", F.coalesce(F.sum("in_block").over(before(["source_no"], "block")), F.lit(0)).alias("base"))
    starts = starts.withColumn("inside", F.coalesce(F.sum("in_range").over(before(["source_no", "block"], "range")), F.lit(0)))
    starts = starts.join(blocks, ["source_no", "block"]).select("source_no", "range", (F.col("base") + F.col("inside")).alias("start"))
    if whole:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
        wide = docs.select(*key, row)
        schema = StructType([*wide.schema.fields, StructField("size", LongType())])
        placed = keyed(wide.mapInArrow(partial(_sizes, text=docs.columns.index(text_col)), schema), "row")
    else:
        placed = keyed(rows)
    within = Window.partitionBy("source_no", "range").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_no", "range"])
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("inner")))
    figures = [F.col("size"), F.col("source_size"), F.col("target"), (F.col("turns") * F.col("size") + cut).alias("taken")]
    if whole:
        return placed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in ("size", "source_size", "target", "taken")), *figures)
    return placed.select("doc_id", *figures)
