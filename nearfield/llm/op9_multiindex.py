"""Embedding near-duplicates by an inverted multi-index.

The halves of a vector have a codebook each; pairs of codes are the cells of a product grid. Every vector is indexed in the
cell of its nearest codes. As a query it visits cells in the order of the sum of its halves' squared distances
(multi-sequence traversal) as far as `reach` beyond its own cell's sum, a bound that is set on a bounded sample of queries,
held against all rows by brute force, so that the target recall is met at any size of the table. Queries meet the members of a visited cell
in blocks, and every candidate is verified by its cosine in double precision. A pair that both sides' visits find is counted where the smaller id
queries. A block gives each vector's number of links and a spanning forest of them, never the pairs, so a crowd of near-equal vectors
costs its comparisons but no rows beyond its own. Codebooks and reach come from the sample; all rows are indexed and all query.

Equal vectors of a label are one entry with a multiplicity, so copies are never paired.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textkit import U, mix

#: Vectors sampled for the codebooks, queries on which reach is set, links of each that count for it, and rounds of k-means.
SAMPLE, TUNE, LINKS, ROUNDS = 20_000, 1_000, 16, 8
#: Vectors in a cell, about; codes of a half; members or visitors of a block.
IN_CELL, CODES, BLOCK = 24, 1024, 512


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of vectors brought to unit length."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances, by rows and codes."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ codes.T) + (codes * codes).sum(axis=1), 0)


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means from distinct random rows; an empty code stays where it is."""
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    codes = x[rng.permutation(len(x))[: min(k, len(x))]].copy()
    for _ in range(ROUNDS):
        near = distances(x, codes).argmin(axis=1)
        sums, n = np.zeros_like(codes), np.bincount(near, minlength=len(codes))
        np.add.at(sums, near, x)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


def visits(one: np.ndarray, two: np.ndarray, reach: float) -> list[int]:
    """Multi-sequence traversal: cells (code of one * codes of two + code of two) by growing sum, as far as reach beyond the first's."""
    a, b = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    least = one[a[0]] + two[b[0]]
    out, heap, seen = [], [(least, 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > least + reach:
            break
        out.append(int(a[i]) * len(two) + int(b[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            if p < len(a) and q < len(b) and (p, q) not in seen:
                seen.add((p, q))
                heapq.heappush(heap, (one[a[p]] + two[b[q]], p, q))
    return out


class Grid:
    """The codebooks and the reach."""

    def __init__(self, sample: np.ndarray, total: int):
        rng = np.random.default_rng(5)
        one, two = halves(sample)
        k = int(min(CODES, max(1, np.sqrt(total / IN_CELL)), max(1, len(sample) // 8)))
        self.one, self.two = codebook(one, k, rng), codebook(two, k, rng)
        self.reach = 0.0

    def tune(self, x: np.ndarray, y: np.ndarray, least: float, recall: float) -> None:
        """Set reach so that a query goes far enough beyond its own cell's sum to find the share `recall` of the links x[i], y[i], from either side, and a tenth more."""
        floor = 2 * (1 - least)  # a link's squared distance
        self.reach = 2 * floor
        if len(x):
            (a1, a2, a), (b1, b2, b) = self.cells(x), self.cells(y)
            rows, m = np.arange(len(x)), len(self.two)
            there = a1[rows, b // m] + a2[rows, b % m] - a1[rows, a // m] - a2[rows, a % m]
            back = b1[rows, a // m] + b2[rows, a % m] - b1[rows, b // m] - b2[rows, b % m]
            self.reach = float(max(floor, 1.1 * np.quantile(np.minimum(there, back), recall)))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        one, two = halves(x)
        d1, d2 = distances(one, self.one), distances(two, self.two)
        return d1, d2, d1.argmin(axis=1) * len(self.two) + d2.argmin(axis=1)


def _visit(batches: Iterator[pa.RecordBatch], grid) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, embedding) to (vec_id, label, cell, home): the own cell first, then those visited."""
    g: Grid = grid.value
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column(2))
        d1, d2, home = g.cells(x)
        found = [visits(d1[i], d2[i], g.reach) for i in range(len(x))]
        at = np.repeat(np.arange(len(x)), [len(f) for f in found])
        cells = np.fromiter((c for f in found for c in f), np.int64, len(at))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells), pa.array(cells == home[at])], names=["vec_id", "label", "cell", "home"])


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _linked(batches: Iterator[pa.RecordBatch], queries, least: float) -> Iterator[pa.RecordBatch]:
    """Of rows (vec_id, label, embedding) those that link with a query (id, label, unit vector): (q, draw, embedding), at most LINKS a query and task, of least draw."""
    ids, names, q = queries.value
    number = {x: k for k, x in enumerate(sorted(set(names)))}
    labels = np.array([number[x] for x in names], dtype=np.int64)
    best: dict[int, list[tuple[int, list[float]]]] = {}
    for batch in batches:
        if not len(batch):
            continue
        x = _matrix(batch.column(2))
        found, own = batch.column(0).to_numpy(), np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], dtype=np.int64)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        for lo in range(0, len(x), 4096):
            part = slice(lo, lo + 4096)
            i, j = np.nonzero((unit[part] @ q.T >= least) & (own[part, None] == labels[None]) & (found[part, None] != ids[None]))
            with np.errstate(over="ignore"):
                draw = (mix((found[part][i].view(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) ^ ids[j].view(np.uint64)) >> U(1)).astype(np.int64)
            order = np.lexsort((draw, j))
            i, j, draw = i[order], j[order], draw[order]
            place = np.arange(len(j)) - np.searchsorted(j, j)  # among a query's links
            for r, k, d in zip((i[place < LINKS] + lo).tolist(), j[place < LINKS].tolist(), draw[place < LINKS].tolist(), strict=True):
                best.setdefault(k, []).append((d, x[r].tolist()))
        best = {k: sorted(v)[:LINKS] for k, v in best.items()}
    rows = [(k, d, v) for k, found in best.items() for d, v in found]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], names=["q", "draw", "embedding"])


def _meet(key: tuple, table: pa.Table, grid, least: float) -> pa.Table:
    """Links between a block of members of a cell and a block of its visitors: (a, null, vectors linked with a) and a spanning forest (a, b, 0)."""
    g: Grid = grid.value
    ids, member = table.column("vec_id").to_numpy(), table.column("member").to_numpy(zero_copy_only=False)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    if member.all() or not member.any():
        return pa.table({"a": [], "b": [], "n": []}, schema=schema)
    x, times = _matrix(table.column("embedding")), table.column("times").to_numpy()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    m, v = np.flatnonzero(member), np.flatnonzero(~member)
    # BLAS finds what may reach the threshold; the cosine itself is summed in one order wherever a pair meets
    i, j = np.nonzero(unit[v] @ unit[m].T >= least - 1e-9)
    i, j = v[i], m[j]
    keep = ids[i] != ids[j]
    i, j = i[keep], j[keep]
    if len(i):
        keep = np.concatenate([cosines(x[i[lo : lo + 65_536]], x[j[lo : lo + 65_536]]) for lo in range(0, len(i), 65_536)]) >= least
        i, j = i[keep], j[keep]
    if len(i):  # does the member visit the visitor's own cell too? then the smaller id's query counts
        d1, d2, home = g.cells(x)
        c1, c2 = home // len(g.two), home % len(g.two)
        both = d1[j, c1[i]] + d2[j, c2[i]] <= d1[j, c1[j]] + d2[j, c2[j]] + g.reach
        keep = ~both | (ids[i] < ids[j])
        i, j = i[keep], j[keep]
    # a row is a member, a visitor or both: places of equal ids are one node
    node, place = np.unique(ids, return_inverse=True)
    a, b = place[i], place[j]
    others = np.bincount(a, times[j], minlength=len(node)) + np.bincount(b, times[i], minlength=len(node))
    some = np.flatnonzero(others)
    one, two = forest(a, b, len(node))
    return pa.table({"a": np.concatenate([node[some], node[one]]), "b": pa.array([*[None] * len(some), *node[two].tolist()], pa.int64()), "n": np.concatenate([others[some].astype(np.int64), np.zeros(len(one), np.int64)])}, schema=schema)


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph with links (a, b): from every node but one of a component to its least, by repeated least neighbours."""
    least = np.arange(nodes)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    child = np.flatnonzero(least != np.arange(nodes))
    return least[child], child


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision, summed dimension by dimension."""
    dot, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        dot += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def near_duplicates(vectors: DataFrame, least: float = 0.98, recall: float = 0.995, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors: links of cosine >= least between rows of equal labels.

    Rows whose label is null or whose vector is null, empty, zero or holds a null or a non-finite number link with nothing,
    and vectors only with those of their length, of which there may be any number of kinds (each is indexed apart). A null id links with nothing and
    has a null component_id and kept. Rows that repeat an id with one vector are one vector, each with a row. A cosine of just `least` links. An empty
    table gives an empty one. Other columns are passed over.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    whole = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", whole & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.withColumn("label", F.concat_ws(":", F.size("embedding").cast("string"), "label"))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 is 0.0
    # rows that link with nothing have a key of their own each, which no entry has, so they don't meet in one partition
    rows = rows.withColumn("key", F.when(F.col("fit"), F.struct(F.xxhash64("label", plain).alias("a"), F.xxhash64(plain, "label", F.lit(1)).alias("b"), F.lit(True).alias("fit"))).otherwise(F.struct(F.xxhash64("vec_id", "label").alias("a"), F.monotonically_increasing_id().alias("b"), F.lit(False).alias("fit"))))
    entries = rows.where("fit").groupBy("key").agg(F.min("vec_id").alias("vec_id"), F.countDistinct("vec_id").alias("times"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    entries = scratch.table(entries, "entries")

    total = entries.count()
    widths = sorted(r[0] for r in entries.select(F.size("embedding")).distinct().collect())
    met = None
    for width in widths:
        own = entries.where(F.size("embedding") == width).select("vec_id", "label", "embedding", "times")
        share = min(1.0, 1.2 * SAMPLE / max(1, total))
        drawn = own.where(F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("vec_id", F.lit(4))).limit(SAMPLE).drop("times").toPandas()
        if not len(drawn):
            drawn = own.limit(1).drop("times").toPandas()
        x = np.array(drawn.embedding.tolist())
        grid = Grid(x, total)
        asked = spark.sparkContext.broadcast((drawn.vec_id.to_numpy()[:TUNE], drawn.label.tolist()[:TUNE], x[:TUNE] / np.linalg.norm(x[:TUNE], axis=1, keepdims=True)))
        links = own.drop("times").mapInArrow(partial(_linked, queries=asked, least=least), "q long, draw long, embedding array<double>")
        links = links.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("draw"))).where(F.col("place") <= LINKS).orderBy("q", "draw").collect()  # TUNE * LINKS vectors at most
        grid.tune(x[[r.q for r in links]], np.array([r.embedding for r in links]).reshape(-1, width), least, recall)
        found = _links(own, spark.sparkContext.broadcast(grid), least, scratch, width)
        met = found if met is None else met.union(found)
    if met is None:
        met = spark.createDataFrame([], "a long, b long, n long")

    groups = components(met.where("b is not null").select("a", "b"), scratch)
    linked = met.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    known = entries.join(linked.withColumnRenamed("a", "vec_id"), "vec_id", "left").join(groups.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    known = known.select("key", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    known = scratch.table(known, "known")
    out = rows.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def _links(entries: DataFrame, grid, least: float, scratch: Scratch, width: int) -> DataFrame:
    """What `_meet` gives for all blocks of all cells; every link counts once."""
    where = scratch.table(entries.drop("times").mapInArrow(partial(_visit, grid=grid), "vec_id long, label string, cell long, home boolean"), f"where-{width}")
    homes = where.where("home").groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("m_blocks"))
    guests = where.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_blocks"))
    sizes = homes.join(guests, ["label", "cell"])
    met = where.join(sizes, ["label", "cell"])
    block = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = met.where("home").select("vec_id", "label", "cell", block("m_blocks", 1).alias("m"), spread("v_blocks").alias("v"), F.lit(True).alias("member"))
    visitors = met.select("vec_id", "label", "cell", spread("m_blocks").alias("m"), block("v_blocks", 2).alias("v"), F.lit(False).alias("member"))
    tiles = members.union(visitors).join(entries.select("vec_id", "embedding", "times"), "vec_id")
    return scratch.table(tiles.groupBy("label", "cell", "m", "v").applyInArrow(lambda key, table: _meet(key, table, grid, least), "a long, b long, n long"), f"links-{width}")
