"""A partitioned index: every vector in the posting of its nearest centroid, searched by probing the nearest postings.

Tables: postings(posting_id, vec_id, embedding[, code]) in parts by posting, sorted by posting; centroids(posting_id, centroid, n);
deleted(vec_id) in parts, one a deletion. Mutations write new versions of the parts they touch and publish them together.

A build assigns every row to the nearest centroid. An insert assigns its own rows only. A posting that reaches the limit is split by
k-means, and then its rows are assigned anew and those rows of a build, or of the postings nearest to an insert's new centroids, that a
new centroid is nearer to move there, in rounds, until none is too large; nothing else is read or moved. A row equally near to several
centroids goes to the smallest id; equal centroids that a split made share their rows by a hash of the id, which keeps postings of
identical vectors below the limit too. Centroids are broadcast; their size is checked against CENTROID_BYTES before any are drawn. Every
row is compared with all of them.

Sign codes are of the residual from a row's own centroid, made again when the row moves, and searched with a floor of the distance that
holds for certain: every row of the probed postings whose floor is within the k-th distance so far is measured exactly, where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import quantizers as Q
from nearfield.functions.metrics import doubles, metric
from nearfield.operators.coded import PAIRS, admit
from nearfield.operators.search import Best, block_by_block, matrix, rescored, top_k
from nearfield.sources.store import Packed, Store

#: Bytes of centroids that are sent to workers; distances to centroids computed at once.
CENTROID_BYTES, BLOCK = 1 << 30, 1 << 19
#: Rounds of splitting, vectors of a posting that place its new centroids, and postings around a new centroid whose rows may move to it.
ROUNDS, SPLIT_SAMPLE, NEIGHBOURS = 64, 2048, 10
#: Rows of a part of the postings, about.
PART_ROWS = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ROWS = "posting_id long, vec_id long, embedding array<float>"


class Centroids:
    """Centroids in memory. Those with ids from `made` on come from splits; of equal ones among them each takes a share of the rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, by: str = "l2", made: float = math.inf):
        self.ids, self.rows, self.by, self.made = ids, rows, by, made

    def _candidates(self, x: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row, position, exact distance) of all centroids that may be among the n nearest, block by block of the rows of x."""
        m, step = metric(self.by), max(1, BLOCK // max(1, len(self.ids)))
        rough = metric("l2").rough if m.name == "euclidean" else m.rough
        size = (self.rows * self.rows).sum(axis=1).max(initial=0)
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            with np.errstate(invalid="ignore", over="ignore"):
                near = rough(part, self.rows) if rough else m.exact(part[:, None, :], self.rows[None])
                limit = np.partition(near, n - 1, axis=1)[:, n - 1] if n > 1 else near.min(axis=1)
                slack = 1e-9 * (1 + np.abs(limit)) + (1e-12 * ((part * part).sum(axis=1) + size) if m.name != "cosine" else 0)
                i, at = np.nonzero(~(near > (limit + slack)[:, None]))
            d = np.empty(len(i))
            for a in range(0, len(i), PAIRS):
                d[a : a + PAIRS] = m.exact(part[i[a : a + PAIRS]], self.rows[at[a : a + PAIRS]])
            yield lo, i, at, d

    def nearest(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, exact distances) of the n nearest centroids of each row, nearest first, by id among equals."""
        n = min(n, len(self.ids))
        out, dist = np.zeros((len(x), n), dtype=np.int64), np.zeros((len(x), n))
        for lo, i, at, d in self._candidates(x, n):
            order = np.lexsort((self.ids[at], d, i))
            i, at, d = i[order], at[order], d[order]
            turn = np.arange(len(i)) - np.searchsorted(i, i)
            first = turn < n
            out[lo + i[first], turn[first]], dist[lo + i[first], turn[first]] = at[first], d[first]
        return out, dist

    def owners(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The posting of each row: of equally near ones that with the smallest id, or if splits made some of them, one of those by a hash of the row's id."""
        out = np.zeros(len(x), dtype=np.int64)
        for lo, i, at, d in self._candidates(x, 1):
            own = self.ids[at]
            order = np.lexsort((own, d, i))
            i, own, d = i[order], own[order], d[order]
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            out[lo + i[starts]] = own[starts]
            if not math.isinf(self.made):
                ends = np.append(starts[1:], len(i))
                for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                    same = own[a:b][(d[a:b] == d[a]) & (own[a:b] >= self.made)]
                    if len(same):
                        out[lo + i[a]] = same[int((ids[lo + i[a]].astype(np.uint64) * _MIX) >> np.uint64(33)) % len(same)]
        return out


def _assign(batches: Iterator[pa.RecordBatch], centroids) -> Iterator[pa.RecordBatch]:
    c: Centroids = centroids.value
    with np.errstate(over="ignore"):
        for batch in batches:
            if len(batch):
                x = matrix(batch.column(1), c.rows.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(c.owners(x, batch.column(0).to_numpy()), pa.int64()), batch.column(0), batch.column(1)], names=["posting_id", "vec_id", "embedding"])


def assign(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(posting_id, vec_id, embedding): each row with its nearest centroid."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>").alias("embedding"))
    return rows.mapInArrow(partial(_assign, centroids=vectors.sparkSession.sparkContext.broadcast(centroids)), _ROWS)


def _distances(c: Centroids, posting: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The distance of each row from its posting's centroid, infinite where there is none; ids are in order."""
    at = np.minimum(np.searchsorted(c.ids, posting), len(c.ids) - 1)
    d, there = np.full(len(x), np.inf), c.ids[at] == posting
    d[there] = metric(c.by).exact(x[there], c.rows[at[there]])
    return d


def _moved(batches: Iterator[pa.RecordBatch], centroids, since: int) -> Iterator[pa.RecordBatch]:
    """Rows (posting_id, vec_id, embedding) that sat in their nearest postings, after those with ids from `since` on were made and others went."""
    c: Centroids = centroids.value
    fresh = c.ids >= since
    new = Centroids(c.ids[fresh], c.rows[fresh], c.by)
    with np.errstate(over="ignore"):
        for batch in batches:
            if len(batch):
                posting, x = batch.column(0).to_numpy().copy(), matrix(batch.column(2), c.rows.shape[1])
                anew = np.flatnonzero(~(new.nearest(x, 1)[1][:, 0] > _distances(c, posting, x)))
                posting[anew] = c.owners(x[anew], batch.column(1).to_numpy()[anew])
                yield pa.RecordBatch.from_arrays([pa.array(posting), batch.column(1), batch.column(2)], names=["posting_id", "vec_id", "embedding"])


def _seated(batches: Iterator[pa.RecordBatch], centroids) -> Iterator[pa.RecordBatch]:
    """(rows, those of them no farther from their posting's centroid than from any)."""
    c: Centroids = centroids.value
    for batch in batches:
        if len(batch):
            x = matrix(batch.column(1), c.rows.shape[1])
            well = _distances(c, batch.column(0).to_numpy(), x) <= c.nearest(x, 1)[1][:, 0]
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64()), pa.array([int(well.sum())], pa.int64())], names=["n", "well"])


def _groups(posting: np.ndarray) -> list[np.ndarray]:
    """Rows of each posting of a batch."""
    order = np.argsort(posting, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(posting[order])) + 1)


def _encode(batches: Iterator[pa.RecordBatch], centroids, text: str) -> Iterator[pa.RecordBatch]:
    """Rows (posting_id, vec_id, embedding) with their codes: of residuals from the posting's centroid for sign codes."""
    own, c = Q.loads(text), centroids.value
    for batch in batches:
        if not len(batch):
            continue
        x, posting = matrix(batch.column(2), own.dim), batch.column(0).to_numpy()
        if isinstance(own, Q.SignBit):
            place = np.searchsorted(c.ids, posting)
            codes = own.encode(x, c.rows[place])
        else:
            codes = own.encode(x)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k.tobytes() for k in codes], pa.binary())], names=[*batch.schema.names, "code"])


class Probe:
    """What a task needs to measure rows of postings: queries, which of them probe a posting, and for residual codes the probed centroids."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, into: dict[int, np.ndarray], centres: dict[int, np.ndarray], by: str, text: str | None):
        self.q_ids, self.q, self.into, self.centres, self.by, self.text = q_ids, q, into, centres, by, text

    def measured(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, ids, distances, their errors) of rows (posting_id, vec_id, embedding or code) for each query that probes their posting."""
        own, m, ready = Q.loads(self.text) if self.text else None, metric(self.by), {}
        for batch in batches:
            if not len(batch):
                continue
            posting, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = Q.unpacked(batch.column(2), own) if own else matrix(batch.column(2), self.q.shape[1])
            for rows in _groups(posting):
                p = int(posting[rows[0]])
                asked = self.into.get(p, ())
                if not len(asked):
                    continue
                if isinstance(own, Q.SignBit):
                    if m.name in ("l2", "euclidean"):
                        d, e = own.estimates(self.q[asked], x[rows], self.centres[p])
                    else:
                        d, e = m.exact(self.q[asked][:, None], own.decode(x[rows], self.centres[p])[None]), None
                elif own:
                    if p not in ready and len(ready) < 1024:
                        ready[p] = own.prepare(self.q[asked])
                    d, e = Q.by_metric(own, self.q[asked], x[rows], self.by, ready.get(p)), None
                else:
                    d, e = m.exact(self.q[asked][:, None], x[rows][None]), None
                for i, k in enumerate(asked):
                    yield k, ids[rows], d[i], (np.zeros(len(rows)) if e is None else e[i])


def _probe(batches: Iterator[pa.RecordBatch], probe, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest for each query, by (estimated) distance."""
    p: Probe = probe.value
    best = Best(len(p.q_ids), k)
    if k:
        for i, ids, d, _ in p.measured(batches):
            near = d <= best.bound(i)
            best.add(i, ids[near], d[near])
    yield best.table(p.q_ids)


def _admitted(batches: Iterator[pa.RecordBatch], probe, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest for each query among rows (posting_id, vec_id, code, embedding), exactly: those are measured that their sign codes leave open."""
    p: Probe = probe.value
    own, m, best, every = Q.loads(p.text), metric(p.by), Best(len(p.q_ids), k), np.arange(len(p.q_ids))
    for batch in batches if k else ():
        posting = batch.column(0).to_numpy()
        asked = [(rows, p.into.get(int(posting[rows[0]]), ())) for rows in _groups(posting)] if len(batch) else []
        whole = [rows for rows, at in asked if len(at) == len(every)]  # postings that all queries probe are taken together
        todo = [([rows], at) for rows, at in asked if 0 < len(at) < len(every)] + ([(whole, every)] if whole else [])
        if not todo:
            continue
        ids, codes, x = batch.column(1).to_numpy(), Q.unpacked(batch.column(2), own), matrix(batch.column(3), own.dim)
        for groups, at in todo:
            rows = np.concatenate(groups)
            centres = np.array([p.centres[int(posting[g[0]])] for g in groups])
            admit(own, p.q, at, x[rows], ids[rows], codes[rows], m, best, centres, np.repeat(np.arange(len(groups)), [len(g) for g in groups]))
    yield best.table(p.q_ids)


class PostingIndex(Packed):
    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark
        m = store.meta
        self.by, self.dim, self.ratio, self.rerank = m["by"], m["dim"], m["ratio"] if m["ratio"] is not None else math.inf, m["rerank"]
        self.most, self.least, self.next_id, self.parts = m["most"], m["least"], m["next_id"], m["parts"]
        self.made, self.given = m.get("made", 0), m.get("given", False)  # the first id of centroids that splits make; whether a caller's stay where they hold no row
        self.quantizer = Q.loads(m["quantizer"]) if m.get("quantizer") else None
        self._centroids: Centroids | None = None
        self._sizes: dict[int, int] = {}

    @property
    def has_quantizer(self) -> bool:
        return self.quantizer is not None

    @classmethod
    def build(cls, spark: SparkSession, path: str, vectors: DataFrame, by: str = "l2", max_posting_size: int = 128, min_posting_size: int = 16, probe_ratio: float = math.inf, quantizer: str | None = None, rerank_size: int = 0, centroids: Centroids | None = None, **options) -> "PostingIndex":
        """Index vectors(vec_id, embedding), ids from 0 without gaps; deterministic in them. centroids: those to begin with, in place of drawn rows; they stay, and are probed, where they hold no row."""
        metric(by)
        n, top, dim, dim_to = vectors.agg(F.count("*"), F.max("vec_id"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n:
            raise ValueError("no vectors")
        if dim != dim_to:
            raise ValueError("vectors differ in dimensions")
        most = max(2, max_posting_size)
        seeds = max(1, n // max(1, most // 2))
        _fits(seeds, dim)
        model = Q.train(quantizer, vectors, **options) if quantizer else None
        store = Store(spark, path)
        if store._numbers():
            raise FileExistsError(path)
        given = centroids is not None
        if centroids is None:
            drawn = vectors.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(seeds).select(doubles("embedding").alias("e")).collect()
            centroids = Centroids(np.arange(len(drawn)), np.array([r.e for r in drawn]), by)
        order = np.argsort(centroids.ids)
        centroids = Centroids(centroids.ids[order], centroids.rows[order], by, int(centroids.ids.max()) + 1)
        store.meta = {"family": "postings", "by": by, "dim": dim, "most": most, "least": min_posting_size, "ratio": None if math.isinf(probe_ratio) else probe_ratio, "rerank": rerank_size, "next_id": top + 1, "parts": min(4096, max(4, n // PART_ROWS)), "made": centroids.made, "given": given, "quantizer": Q.dumps(model) if model else None}
        index = cls(store)
        index._centroids = centroids
        store.write_parts("deleted", spark.createDataFrame([], "vec_id long"), F.lit(0))
        store.write_parts("postings", spark.createDataFrame([], _ROWS if model is None else _ROWS + ", code binary"), F.lit(0))
        index._settle(assign(vectors, centroids), set())
        store.publish()
        store.vacuum()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, by: str | None = None) -> "PostingIndex":
        store = Store(spark, path).open()
        if store.meta.get("family") != "postings":
            raise ValueError(f"{path} holds no posting index")
        if by and by != store.meta["by"]:
            raise ValueError(f"{path} was built with {store.meta['by']}, not {by}")
        return cls(store)

    def centroids(self) -> Centroids:
        """All centroids; the sizes of their postings are known from then on."""
        if self._centroids is None:
            table = self.store.read("centroids")
            _fits(table.count(), self.dim)
            rows = table.orderBy("posting_id").collect()
            self._centroids = Centroids(np.array([r.posting_id for r in rows], dtype=np.int64), np.array([r.centroid for r in rows]), self.by, self.made)
            self._sizes = {r.posting_id: r.n for r in rows if r.n}
        return self._centroids

    def _among(self, table: DataFrame, postings: set[int], how: str = "left_semi") -> DataFrame:
        """The rows of these postings (or with left_anti of all others); their ids are no more than the centroids."""
        ids = self.spark.createDataFrame([(int(p),) for p in sorted(postings)], "posting_id long")
        return table.join(F.broadcast(ids), "posting_id", how)

    def _stored(self, postings: set[int], how: str = "left_semi") -> DataFrame:
        """The kept rows of some postings, from their parts alone."""
        parts = {p % self.parts for p in postings} if how == "left_semi" else None
        return self._among(self.store.read("postings", parts), postings, how).select("posting_id", "vec_id", "embedding")

    def _settle(self, rows: DataFrame, taken: set[int]) -> None:
        """Put rows(posting_id, vec_id, embedding) in place of those that the postings `taken` hold, beside those of others, and split what has reached the limit."""
        store, c = self.store, self.centroids()
        last = c.ids.max()
        for turn in range(ROUNDS):
            _fits(len(c.ids), self.dim)
            rows = store.write(f"draft-{turn}", rows)
            store.discard(f"draft-{turn - 1}")
            counts = {r[0]: r[1] for r in rows.groupBy("posting_id").count().collect()}  # a number a posting
            more = {p for p, n in counts.items() if p not in taken and n + self._sizes.get(p, 0) >= self.most and self._sizes.get(p)}
            large = {p: n for p, n in counts.items() if p not in more and n + (0 if p in taken else self._sizes.get(p, 0)) >= self.most}
            if not more and not large:
                break
            made = self._split(rows, large)
            ids = last + 1 + np.arange(len(made))
            last += len(made)
            keep = ~np.isin(c.ids, list(large))
            new = np.array([r for _, r in made]).reshape(len(made), self.dim)
            since = int(ids[0]) if len(ids) else 0
            c = Centroids(np.concatenate([c.ids[keep], ids]).astype(np.int64), np.concatenate([c.rows[keep], new]), self.by, self.made)
            near = {int(c.ids[i]) for at in (c.nearest(new, NEIGHBOURS)[0] if len(new) and self._sizes else ()) for i in at} - set(ids.tolist())
            loaded = (near | more) - taken
            loaded = {p for p in loaded if self._sizes.get(p)}
            rows = rows if not loaded else rows.unionByName(self._stored(loaded))
            if large:
                rows = rows.mapInArrow(partial(_moved, centroids=self.spark.sparkContext.broadcast(c), since=since), _ROWS)
            taken = taken | loaded | set(large)
        else:
            raise ValueError(f"after {ROUNDS} rounds some postings still hold {self.most} rows or more")
        self._write(rows, counts, taken, c)
        store.discard(f"draft-{turn}")

    def _write(self, rows: DataFrame, counts: dict[int, int], taken: set[int], c: Centroids) -> None:
        """Write the parts that rows or postings taken touch, and the centroids of postings that hold rows."""
        sizes = {p: n for p, n in self._sizes.items() if p not in taken}
        for p, n in counts.items():
            sizes[p] = sizes.get(p, 0) + n
        used = np.isin(c.ids, [p for p, n in sizes.items() if n]) | (self.given & (c.ids < self.made))
        order = np.flatnonzero(used)[np.argsort(c.ids[used])]
        c = Centroids(c.ids[order], c.rows[order], self.by, self.made)
        touched = {p % self.parts for p in taken | set(counts)}
        coded = rows
        if self.quantizer is not None:
            coded = rows.mapInArrow(partial(_encode, centroids=self.spark.sparkContext.broadcast(c), text=Q.dumps(self.quantizer)), _ROWS + ", code binary")
        here = {int(p) for p in self.store.tables["postings"]} & touched
        if here:
            coded = coded.unionByName(self._among(self.store.read("postings", here), taken, "left_anti"))
        coded = coded.withColumn("part", F.pmod("posting_id", F.lit(self.parts)).cast("int"))
        coded = coded.repartition(max(1, len(touched)), "part").sortWithinPartitions("part", "posting_id", "vec_id")
        self.store.write_parts("postings", coded, F.col("part"), touched)
        table = [(int(i), [float(v) for v in r], int(sizes.get(int(i), 0))) for i, r in zip(c.ids, c.rows, strict=True)]
        self.store.write("centroids", self.spark.createDataFrame(table, "posting_id long, centroid array<double>, n long"))
        self._centroids, self._sizes = c, {p: n for p, n in sizes.items() if n}

    def _split(self, rows: DataFrame, large: dict[int, int]) -> list[tuple[int, list[float]]]:
        """(posting, new centroid) of postings that have reached the limit: k-means of some of their rows, k by their size."""
        if not large:
            return []
        half = max(1, self.most // 2)
        sizes = self.spark.createDataFrame([(int(p), int(n)) for p, n in large.items()], "posting_id long, count long")
        order = Window.partitionBy("posting_id").orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id")
        some = rows.join(F.broadcast(sizes), "posting_id").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= SPLIT_SAMPLE)

        def cut(key, table):
            x = matrix(table.sort_by("vec_id").column("embedding"))
            k = max(2, -(-int(table.column("count")[0].as_py()) // half))
            made = Q.lloyd(x, k, 5, np.random.default_rng(key[0].as_py()))
            return pa.table({"posting_id": pa.array([key[0].as_py()] * k, pa.int64()), "centroid": pa.array(made.tolist(), pa.list_(pa.float64()))})

        found = some.groupBy("posting_id").applyInArrow(cut, "posting_id long, centroid array<double>").collect()  # centroids only
        return sorted((r.posting_id, r.centroid) for r in found)

    def live(self, postings: set[int] | None = None) -> DataFrame:
        """The rows that aren't deleted; of some postings, from their parts alone."""
        rows = self.store.read("postings") if postings is None else self.store.read("postings", {p % self.parts for p in postings})
        if postings is not None and len(postings) <= 10_000:
            rows = rows.where(F.col("posting_id").isin(sorted(postings)))  # row groups of other postings aren't read
        elif postings is not None:
            rows = self._among(rows, postings)
        return rows.join(self.store.read("deleted"), "vec_id", "left_anti")

    def _fit(self, q: np.ndarray) -> None:
        if q.shape[1] != self.dim:
            raise ValueError(f"a query has {q.shape[1]} dimensions, not {self.dim}")

    def probes(self, q: np.ndarray, n_probe: int, ratio: float | None = None) -> list[list[int]]:
        """Postings to probe for each query: the nearest n_probe (at least one), up to ratio times the nearest's distance."""
        self._fit(q)
        c, ratio = self.centroids(), self.ratio if ratio is None else ratio
        at, d = c.nearest(q, max(1, n_probe))
        out = []
        for i in range(len(q)):
            keep = d[i] <= d[i, 0] * max(ratio, 1) if math.isfinite(ratio) and d[i, 0] >= 0 else np.ones(len(d[i]), dtype=bool)
            out.append([int(x) for x in c.ids[at[i][keep]]])
        return out

    def search(self, queries: DataFrame, k: int = 10, n_probe: int = 8, ratio: float | None = None, rerank: int | None = None) -> DataFrame:
        """(q_id, rank, vec_id, dist) of the live rows of the probed postings; exact distances unless a quantizer isn't re-ranked.

        Sign codes under (squared) Euclidean are always re-ranked, by what the distances can't be below: all rows that may still be nearer than the
        k-th best so far are measured. Other codes are re-ranked by the `rerank` best.
        """
        rerank = self.rerank if rerank is None else rerank
        coded, schema = self.quantizer is not None, "q_id long, vec_id long, dist double"
        bound = isinstance(self.quantizer, Q.SignBit) and self.by in ("l2", "euclidean")
        wide = max(k, rerank) if coded and not bound else k

        def near(block, send):
            ids, q = block
            c = self.centroids()
            if n_probe >= len(c.ids) and math.isinf(self.ratio if ratio is None else ratio):
                self._fit(q)
                into, live = dict.fromkeys(c.ids.tolist(), np.arange(len(ids))), self.live()  # one list for all
            else:
                listed: dict[int, list[int]] = {}
                for i, postings in enumerate(self.probes(q, n_probe, ratio)):
                    for p in postings:
                        listed.setdefault(p, []).append(i)
                into, live = {p: np.array(asked) for p, asked in listed.items()}, self.live(set(listed))
            centres = dict(zip(into, c.rows[np.searchsorted(c.ids, list(into))], strict=True)) if isinstance(self.quantizer, Q.SignBit) else {}
            probe = send(Probe(ids, q, into, centres, self.by, Q.dumps(self.quantizer) if coded else None))
            if bound:
                return live.select("posting_id", "vec_id", "code", "embedding").mapInArrow(partial(_admitted, probe=probe, k=k), schema)
            rows = live.select("posting_id", "vec_id", "code" if coded else "embedding")
            found = top_k(rows.mapInArrow(partial(_probe, probe=probe, k=wide), schema), wide)
            return rescored(found, live, queries, k, self.by) if coded and rerank else found

        return block_by_block(queries, k, near)

    def insert(self, vectors: DataFrame, publish: bool = True) -> tuple[int, int]:
        """Add rows(embedding); returns the range of their new ids, first and after the last, in the rows' order. Only the parts that they or a split touch are read and written."""
        store = self.store
        staged = store.write("draft-new", vectors.select(F.col("embedding").cast("array<float>").alias("embedding"), F.monotonically_increasing_id().alias("mono")))
        n, a, b = staged.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if n and not a == b == self.dim:
            store.discard("draft-new")
            raise ValueError(f"a vector has not {self.dim} dimensions")
        first = before = self.next_id
        if n:
            part = F.shiftright("mono", 33)
            counts, starts = {r[0]: r[1] for r in staged.groupBy(part).count().collect()}, {}
            for p in sorted(counts):
                starts[p], first = first, first + counts[p]
            start = self.spark.createDataFrame(list(starts.items()), "part long, start long")
            new = staged.withColumn("part", part).join(F.broadcast(start), "part").select((F.col("start") + F.col("mono").bitwiseAND((1 << 33) - 1)).alias("vec_id"), "embedding")
            self._settle(assign(new, self.centroids()), set())
            self.next_id = first
        store.discard("draft-new")
        if publish:
            store.publish(next_id=first)
        else:
            store.meta["next_id"] = first
        return before, first

    def reassign_neighbors(self) -> int:
        """Move every row that doesn't sit in its nearest posting there; returns how many moved."""
        rows, c = self.store.read("postings").select("posting_id", "vec_id", "embedding"), self.centroids()
        now = self.store.write("draft-all", assign(rows.select("vec_id", "embedding"), c))
        both = rows.select("vec_id", F.col("posting_id").alias("was")).join(now, "vec_id").where("was <> posting_id")
        ends = both.select("was", "posting_id").collect()  # rows out of place are few; two numbers of each
        if ends:
            touched = {r.was for r in ends} | {r.posting_id for r in ends}
            self._settle(self._among(now, touched), touched)
        self.store.discard("draft-all")
        if ends:
            self.store.publish()
        return len(ends)

    def delete(self, ids: DataFrame, publish: bool = True) -> int:
        """Mark ids(vec_id) as deleted; unknown ones are passed over. Returns how many are deleted now. Each call adds a part of its own ids alone."""
        known = ids.where((F.col("vec_id") >= 0) & (F.col("vec_id") < self.next_id)).select(F.col("vec_id").cast("long")).distinct()
        self.store.append("deleted", known.join(self.store.read("deleted"), "vec_id", "left_anti"))
        if publish:
            self.store.publish()
        return self.store.read("deleted").count()

    def gc(self) -> None:
        """Rewrite the parts that hold deleted rows without them; postings left with fewer than min_posting_size are dissolved. `deleted` stays."""
        self.centroids()
        rows = self.store.read("postings").select("posting_id", "vec_id", "embedding")
        dead = {r[0]: r[1] for r in rows.join(self.store.read("deleted"), "vec_id", "left_semi").groupBy("posting_id").count().collect()}  # a number a posting
        left = {p: n - dead.get(p, 0) for p, n in self._sizes.items()}
        small = {p for p, n in left.items() if n < self.least}
        if len(small) == len(left):
            small -= {max(left, key=lambda p: (left[p], -p))}
        taken = set(dead) | small
        if taken:
            live = self._stored(taken).join(self.store.read("deleted"), "vec_id", "left_anti").select("posting_id", "vec_id", "embedding")
            keep = ~np.isin(self._centroids.ids, list(small))
            self._centroids = Centroids(self._centroids.ids[keep], self._centroids.rows[keep], self.by, self.made)
            moved = assign(self._among(live, small).select("vec_id", "embedding"), self._centroids)
            self._settle(self._among(live, small, "left_anti").unionByName(moved), taken)
        self.store.publish()

    def compact(self) -> None:
        """Write the centroids and the deletions as one part each, and delete what older states left; postings and results stay as they are."""
        self.store.write("centroids", self.store.read("centroids").orderBy("posting_id"))
        self.store.write_parts("deleted", self.store.read("deleted"), F.lit(0))
        self.store.publish()
        self.store.vacuum()

    def save(self, path: str) -> None:
        """The whole index, newest state only, as a store at a new path."""
        self.store.snapshot(path)

    def is_deleted(self, vec_id: int) -> bool:
        return not self.store.read("deleted").where(F.col("vec_id") == vec_id).isEmpty()

    def get_vector(self, vec_id: int) -> list[float] | None:
        """The vector, or None if it is deleted or unknown."""
        r = self.live().where(F.col("vec_id") == vec_id).select("embedding").first()
        return None if r is None else list(r.embedding)

    def stats(self) -> dict:
        sizes = self.store.read("postings").groupBy("posting_id").count().agg(F.count("*").alias("postings"), F.max("count").alias("max")).first()
        deleted = self.store.read("deleted").count()
        return {"live": self.live().count(), "deleted": deleted, "postings": sizes.postings, "max_posting": sizes.max or 0, "dim": self.dim}

    def in_nearest(self) -> float:
        """The share of rows that sit in the posting of a nearest centroid, each compared with all centroids; equally near ones count alike."""
        rows, sent = self.store.read("postings").select("posting_id", "embedding"), self.spark.sparkContext.broadcast(self.centroids())
        return rows.mapInArrow(partial(_seated, centroids=sent), "n long, well long").agg(F.sum("well") / F.sum("n")).first()[0]

    def snapshot(self, target: str) -> list[str]:
        return self.store.snapshot(target)

    @classmethod
    def restore(cls, spark: SparkSession, source: str, path: str) -> "PostingIndex":
        Store(spark, source).open().snapshot(path)
        return cls.open(spark, path)


def _fits(centroids: int, dim: int) -> None:
    if centroids * dim * 8 > CENTROID_BYTES:
        raise ValueError(f"centroids take more than {CENTROID_BYTES} bytes; build with a larger max_posting_size")
