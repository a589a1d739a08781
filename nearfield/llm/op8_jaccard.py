"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection of sorted arrays.

Every set of distinct word shingles falls in a geometric band of sizes; a *tile* holds the sets of one band and those
of the next that may still reach the threshold with them. All sets order their elements alike, rare ones first: by how often an
element's hash was counted over the whole corpus (a table of 2^TALLY counters, whatever the corpus' size), then by the hash. Two
sets that link share at least ceil(t * n) elements, n the larger's size, so the first n - ceil(t * n) + 1 elements of each, n its own
size, hold a common one: sets meet only in buckets (tile, element), and no pair is lost. They share at least ceil(2t / (1 + t) * n) elements too, n the
smaller's size, so the common one is among the smaller's first n - ceil(2t / (1 + t) * n) + 1: rows of a bucket without a partner of a fitting size, the
smaller with the element that near its beginning, are dropped. The counts decide the order, never what is found.
Buckets that hold the same sets become one, weighted by their number.

In the others each set is compared with hubs first, those it shares most buckets with; components of those links settle most
buckets, since two sets of one component need no comparison. What is left is compared in blocks, all members against all others of a
different component (blocks of a bucket's largest component don't meet each other): popcounts of bitmaps bound the overlap from
above, and only pairs that pass are intersected; in the first rounds, which join most components, each set's best pairs by that
bound. Nothing is capped; no bucket or set has to fit in one task, and no pair inside a settled group is made.

Equal sets are one node, so copies are never paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .scratch import Scratch
from .textkit import U, chunks, mix, shingle_hashes, shingle_sets, utf8, word_hashes

#: Largest size of a band over its smallest.
RATIO = 3
#: Counters of the elements' frequencies, as a power of two, and those that travel in one row.
TALLY, SLICE = 20, 4096
#: Rows of a bucket up to which it is compared with other buckets' contents; larger ones stay as they are.
HOLD = 1 << 16
#: Members of a block that are compared with those of another, and sets that are checked against a hub in one group.
BLOCK, GROUP = 512, 256
#: Bits of a bitmap for an element, at least, over 1 less the threshold: 6 at 0.8, 3 at 0.9. What the bound lets through below the threshold is then as wide at either.
BITS = 30
#: Hubs that a set is checked against; rounds in which blocks give each set's BEST pairs only, before all that are left.
HUBS, ROUNDS, BEST = 1, 1, 2
#: Bitmaps of sets that share buckets, and texts of sets to be intersected, are found by a broadcast of ids up to this many, by a shuffled join beyond.
BROADCAST_IDS = 1_000_000
_STEP = U(0x9E3779B97F4A7C15)


class Banding:
    """Tiles and the listing of a set, for the threshold num/den. level: a grade of each counter's frequency; without it all elements count as equally frequent."""

    def __init__(self, num: int, den: int, level: np.ndarray | None = None):
        self.num, self.den, self.level = num, den, level

    @lru_cache(None)  # noqa: B019
    def low(self, band: int) -> int:
        """The smallest size in a band."""
        x = 1
        for _ in range(band):
            x = max(x + 1, x * RATIO)
        return x

    @lru_cache(None)  # noqa: B019
    def tiles(self, n: int) -> list[int]:
        """The tiles of a set of n elements: its band's, and the one before if a set of that band may link with it."""
        band = 0
        while self.low(band + 1) <= n:
            band += 1
        return [band, band - 1] if band and n * self.num <= (self.low(band) - 1) * self.den else [band]

    def signatures(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket hashes of a set, of its rarest elements for each tile, and which of them hold it as the smaller of a pair."""
        n, num, den = len(x), self.num, self.den
        first, near = n + num * n // -den + 1, n + 2 * num * n // -(num + den) + 1
        rank = x >> U(8)
        if self.level is not None:
            rank = rank | self.level[(x >> U(64 - TALLY)).astype(np.int64)].astype(np.uint64) << U(56)
        rank = np.sort(np.partition(rank, first - 1)[:first] if first < n else rank)
        tiles = self.tiles(n)
        small = np.arange(first) < near
        return np.concatenate([mix(rank ^ mix(np.array([tile + 1], np.uint64) * _STEP)) for tile in tiles]), np.concatenate([small if tile == tiles[0] else np.zeros(first, dtype=bool) for tile in tiles])


def _tally(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Counts of the elements' hashes, once for the task: (slice, its counters in as few bytes as they need)."""
    counts = np.zeros(1 << TALLY, dtype=np.int64)
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in chunks(offsets):
                runs, _ = shingle_hashes(*word_hashes(data, offsets, lo, hi), words)
                counts += np.bincount((runs >> U(64 - TALLY)).astype(np.int64), minlength=1 << TALLY)
    parts = [part.astype(np.min_scalar_type(int(part.max()))).tobytes() for part in counts.reshape(-1, SLICE)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def _graded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's slices, summed: (slice, a byte for each counter, a quarter of a power of two a grade)."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(part, f"<u{len(part) // SLICE}").astype(np.int64)
    parts = [np.floor(4 * np.log2(np.maximum(x, 1))).astype(np.uint8).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])


def grades(texts: DataFrame, words: int) -> np.ndarray:
    """A grade of frequency for each of the 2^TALLY counters, over all rows (text)."""
    summed = texts.select("text").mapInArrow(partial(_tally, words=words), "slice int, counts binary").repartition("slice").mapInArrow(_graded, "slice int, counts binary")
    return np.frombuffer(b"".join(r.counts for r in sorted(summed.collect())) or bytes(1 << TALLY), np.uint8)


def set_id(x: np.ndarray) -> int:
    """A set's identity: a 64-bit hash of its content, signed."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(x + _STEP).sum(dtype=np.uint64) + U(len(x))], dtype=np.uint64)).view(np.int64)[0])


def _scan(batches: Iterator[pa.RecordBatch], words: int, num: int, den: int, level) -> Iterator[pa.RecordBatch]:
    band, each = Banding(num, den, level.value), max(2, BITS * (den - num) // den)
    for batch in batches:
        sizes, ids, sigs, small, lengths, bits, seen = [], [], [], [], [], [], set()
        nameless = batch.column(0).is_null().to_pylist()
        for i, x in shingle_sets(batch.column(1), words):
            own = set_id(x) if len(x) and not nameless[i] else None
            sizes.append(len(x))
            ids.append(own)
            if own is None or own in seen:  # copies in a batch list nothing: their buckets are the same
                lengths.append(0)
                bits.append(None)
                continue
            seen.add(own)
            with np.errstate(over="ignore"):
                found, near = band.signatures(x)
            sigs.append(found)
            small.append(2 * len(x) + near)
            lengths.append(len(sigs[-1]))
            bits.append(bitmap(x, each))
        flat = pa.array((np.concatenate(sigs) if sigs else np.empty(0, np.uint64)).view(np.int64))
        sized = pa.array((np.concatenate(small) if small else np.empty(0, np.int64)).astype(np.int32))
        at = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(at, flat), pa.ListArray.from_arrays(at, sized), pa.array(bits, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sigs", "sizes", "bitmap"])


def _set_of(batches: Iterator[pa.RecordBatch], words: int, at: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [set_id(x) if len(x) else None for _, x in shingle_sets(batch.column(at), words)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, name])


def with_set(docs: DataFrame, name: str, text_col: str = "text", words: int = 3) -> DataFrame:
    """All rows and columns of docs, and as the last the name of the text's set; null for a text without words."""
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return docs.mapInArrow(partial(_set_of, words=words, at=docs.columns.index(text_col), name=name), schema)


def _partnered(bucket: np.ndarray, size: np.ndarray, num: int, den: int) -> np.ndarray:
    """Of rows in the order of bucket, then size (twice the set's, plus 1 where it may be the smaller), those with a partner of a fitting size."""
    n, small = size >> 1, (size & 1).astype(bool)
    span = int(n.max()) * den // num + 2
    place = bucket * span + n
    larger = np.searchsorted(place, bucket * span + n * den // num, side="right") - np.searchsorted(place, place) > 1
    those = place[small]
    smaller = np.searchsorted(those, place, side="right") - np.searchsorted(those, bucket * span - (-n * num // den)) > small
    return (small & larger) | smaller


def _merged(sig: np.ndarray, ident: np.ndarray, size: np.ndarray, num: int, den: int) -> pa.RecordBatch:
    """(sig, set_id, weight) of whole buckets, in their order: rows with a partner; buckets that hold the same sets are one, named by their content."""
    bucket = np.cumsum(np.concatenate([[False], sig[1:] != sig[:-1]]))
    order = np.lexsort((size, bucket))
    keep = order[_partnered(bucket, size[order], num, den)]
    bucket, ident = bucket[keep], ident[keep]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    sizes = np.diff(np.append(starts, len(bucket)))
    with np.errstate(over="ignore"):
        content = mix(np.add.reduceat(mix(ident.view(np.uint64) * _STEP + U(1)), starts) + sizes.astype(np.uint64)) if len(starts) else np.empty(0, np.uint64)
    name, first, weight = np.unique(content, return_index=True, return_counts=True)
    starts, sizes = starts[first], sizes[first]
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return _row_batch(np.repeat(name, sizes).view(np.int64), ident[at], np.repeat(weight, sizes))


def _shared(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows (sig, set_id, size) in that order, the buckets by content (see `_merged`). The last bucket is held back between batches;
    one of more than HOLD rows goes on as it is, under its own name (a row of it that repeats only weighs more)."""
    sig, ident, size, large = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None
    for batch in chain(batches, [None]):
        if batch is not None:
            sig, ident, size = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((sig, ident, size)))
        new = np.ones(len(sig), dtype=bool)
        new[1:] = (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])
        sig, ident, size = sig[new], ident[new], size[new]
        out = 0 if large is None else int(np.searchsorted(sig, large, side="right"))
        if out < len(sig):
            large = None
            whole = len(sig) if batch is None else max(out, int(np.searchsorted(sig, sig[-1])))
            if whole > out:
                yield _merged(sig[out:whole], ident[out:whole], size[out:whole], num, den)
            if len(sig) - whole > HOLD:
                large = int(sig[-1])
                yield _row_batch(sig[whole:], ident[whole:])
                whole = len(sig)
        else:
            whole = out
        if out:
            yield _row_batch(sig[:out], ident[:out])
        sig, ident, size = sig[whole:], ident[whole:], size[whole:]


def _row_batch(sig: np.ndarray, ident: np.ndarray, weight: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(ident), pa.array(np.ones(len(sig), np.int64) if weight is None else weight, pa.int64())], names=["sig", "set_id", "weight"])


def bitmap(x: np.ndarray, each: int = 6) -> bytes:
    """Hashed bitmap of a set, of `each` to 2 * `each` bits an element and a power of two of them."""
    bits = 1 << max(6, int(each * len(x) - 1).bit_length())
    out = np.zeros(bits, dtype=bool)
    out[(x & U(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, the longer ones folded to the length of the shortest."""
    size = min(map(len, bitmaps)) // 8
    return np.array([np.bitwise_or.reduce(np.frombuffer(x, np.uint64).reshape(-1, size), axis=0) for x in bitmaps])


def overlap(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most elements that one may share with each of the others: every bit that the other lacks stands for an element at least that isn't shared."""
    return np.minimum(n - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64))


def reaches(shared: np.ndarray, n: int, sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes with so many shared elements reach the threshold."""
    return shared * (num + den) >= num * (n + sizes)


def links(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether sorted sets reach the threshold, exactly."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * (num + den) >= num * (len(x) + len(y))


def _fetch(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(set_id, n, elements) of the texts."""
    for batch in batches:
        for lo in range(0, len(batch), GROUP):
            part = batch.slice(lo, GROUP)
            sets = [x for _, x in shingle_sets(part.column(1), words)]
            mine = [len(x) > 0 and set_id(x) == k for x, k in zip(sets, part.column(0).to_pylist(), strict=True)]  # an id may stand for several texts
            part, sets = part.filter(pa.array(mine, pa.bool_())), [x for x, own in zip(sets, mine, strict=True) if own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["set_id", "n", "elements"])


def _verify(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (hub, part, member, n, elements), a hub's own first: the pairs (hub, member) that link."""
    key, hub = None, np.empty(0, np.uint64)
    for batch in batches:
        hubs, parts, members, ns = (batch.column(i).to_pylist() for i in range(4))
        flat, at = batch.column(4).flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(ns)])
        found: list[tuple[int, int]] = []
        for i, k in enumerate(zip(hubs, parts, strict=True)):
            x = flat[at[i] : at[i + 1]]
            if k != key:
                key, hub = k, x.copy()
            elif members[i] != hubs[i] and links(hub, x, num, den):
                found.append((hubs[i], members[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def _compare(key: tuple, table: pa.Table, num: int, den: int, best: int) -> pa.Table:
    """Pairs of a block of a bucket with another block (or itself), of different components, that pass the bitmaps' bound.

    With best, for each set its `best` pairs by that bound, and of those the best for each two components; else all.
    """
    _, one, two = (k.as_py() for k in key)
    ids, labels, ns, side = (table.column(c).to_numpy() for c in ("set_id", "component", "n", "block"))
    rows = folded(table.column("bitmap").to_pylist())
    a_found, b_found, rank = [], [], []
    for i in np.flatnonzero(side == one):
        to = np.flatnonzero((labels != labels[i]) & ((ids > ids[i]) if one == two and not best else (side == two)))
        most = overlap(rows[i], ns[i], rows[to], ns[to])
        to, most = to[reaches(most, ns[i], ns[to], num, den)], most[reaches(most, ns[i], ns[to], num, den)]
        share = most / (ns[i] + ns[to])
        if best and len(to) > best:
            top = np.argpartition(-share, best - 1)[:best]
            to, share = to[top], share[top]
        a_found.append(np.full(len(to), i))
        b_found.append(to)
        rank.append(share)
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a_found, b_found))
    if best and len(a):
        order = np.argsort(-np.concatenate(rank), kind="stable")
        a, b = a[order], b[order]
        two_labels = np.stack([np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])], axis=1)
        first = np.unique(two_labels, axis=0, return_index=True)[1]
        a, b = a[first], b[first]
    a, b = ids[a.astype(np.int64)], ids[b.astype(np.int64)]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _hub_pairs(rest: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): each set b with those HUBS of its buckets' hubs with which it shares most buckets."""
    hubs = scratch.table(rest.groupBy("sig").agg(F.min("set_id").alias("hub")), "hubs")
    met = rest.join(hubs, "sig").where("set_id <> hub").groupBy("set_id", "hub").agg(F.sum("weight").alias("count"))
    best = Window.partitionBy("set_id").orderBy(F.desc("count"), "hub")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= HUBS).select(F.col("hub").alias("a"), F.col("set_id").alias("b"))


def _opened(listing: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """(sig, major, main, others) of the buckets that hold sets of several components: the component most of its sets are of, blocks of those sets and of the others.

    Each content once, and without those whose sets all have one other bucket as their largest: it holds all their pairs.
    """
    parts = listing.groupBy("sig", "component").agg(F.count("*").alias("size"), F.expr("bit_xor(xxhash64(set_id))").alias("content"))
    parts = parts.groupBy("sig").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.struct("size", "component")).alias("most"), F.expr("bit_xor(content)").alias("content")).where("parts > 1")
    parts = parts.groupBy("size", "content").agg(F.min("sig").alias("sig"), F.min("most").alias("most"))
    parts = scratch.table(parts, f"parts-{turn}")
    sized = scratch.table(listing.join(parts, "sig").select("sig", "set_id", "size"), f"sized-{turn}")
    largest = scratch.table(sized.groupBy("set_id").agg(F.max(F.struct("size", "sig"))["sig"].alias("largest")), f"largest-{turn}")
    spread = sized.join(largest, "set_id").groupBy("sig").agg(F.min("largest").alias("lo"), F.max("largest").alias("hi")).where("lo <> hi or lo = sig").select("sig")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    return scratch.table(parts.join(spread, "sig").select("sig", F.col("most.component").alias("major"), blocks(F.col("most.size")).alias("main"), blocks(F.col("size") - F.col("most.size")).alias("others")), f"opened-{turn}")


def _tile_pairs(rest: DataFrame, opened: DataFrame, sets: DataFrame, num: int, den: int, best: int) -> DataFrame:
    """Pairs (a, b) of sets of different components that share an open bucket and pass the bound, block by block; the largest component's blocks meet the others' only."""
    main, others = F.col("main"), F.col("others")
    spread = lambda n: F.pmod(F.xxhash64("set_id"), n).cast("int")
    members = rest.join(opened, "sig").withColumn("inner", F.col("component") == F.col("major"))
    members = members.withColumn("block", F.when(F.col("inner"), spread(main)).otherwise(main + spread(others)))
    other = F.explode(F.sequence(F.when(F.col("inner"), main).otherwise(F.lit(0)), main + others - 1))
    tiles = members.select("sig", "set_id", "component", "block", other.alias("other")).select("sig", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "set_id", "component", "block")
    tiles = tiles.join(sets.select("set_id", "n", "bitmap"), "set_id")
    return tiles.groupBy("sig", "one", "two").applyInArrow(lambda key, table: _compare(key, table, num, den, best), "a long, b long").distinct()


def _bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, n and bitmap of a, n and bitmap of b), the pairs that pass the bitmaps' bound."""
    for batch in batches:
        keep = []
        for n, one, m, two in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            pair = folded([one, two])
            keep.append(bool(reaches(overlap(pair[0], n, pair[1:], np.array([m])), n, m, num, den)[0]))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bounded_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may link; only bitmaps move."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bits_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return rows.mapInArrow(partial(_bounded, num=num, den=den), "a long, b long")


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _elements(pairs: DataFrame, first: DataFrame, texts: DataFrame, words: int, scratch: Scratch, turn: int) -> DataFrame:
    """(set_id, n, elements) of the sets of pairs, made again from the text of one document each."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    owners = scratch.table(first.join(wanted, "set_id", "left_semi").select("set_id", F.col("first").alias("doc_id")), f"owners-{turn}")
    return texts.join(_small(owners), "doc_id").select("set_id", "text").mapInArrow(partial(_fetch, words=words), "set_id long, n long, elements array<long>")


def _check_pairs(pairs: DataFrame, sets: DataFrame, scratch: Scratch, turn: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link. A hub a with many partners is dealt out in parts of about GROUP, each with the hub's set."""
    parts = scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), f"parts-of-hubs-{turn}")
    to = pairs.join(parts, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("set_id"), F.lit(1).alias("turn"))
    own = parts.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("set_id"), F.lit(0).alias("turn"))
    rows = own.union(to).join(sets, "set_id").select("hub", "part", F.col("set_id").alias("member"), "n", "elements", "turn")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "turn", "member")
    return rows.mapInArrow(partial(_verify, num=num, den=den), "a long, b long")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, num: int = 90, den: int = 100, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: groups of documents joined by links.

    Words are ``[^\x20\x09-\x0D]+`` with A-Z in lower case; a document's set holds its distinct runs of `words`
    words, or its whole sequence where it has fewer. Two link when den * intersection >= num * union. component_id is
    the smallest id that links reach, the own one included.

    A null or empty text, or one of white space, has n_shingles 0 and is its own component. Very long texts count whole. A pair of just the threshold
    links. A row with a null id is kept, links with nothing and has a null component. Repeated rows give a row each, in the same component. An empty table
    gives an empty one. Other columns are passed over.

    named adds set_id, the row's set as `with_set` names it, and group, which is equal just where sets are joined (both null without a set).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = spark.sparkContext.broadcast(grades(texts, words))
    scanned = scratch.table(texts.mapInArrow(partial(_scan, words=words, num=num, den=den, level=level), "doc_id long, n_shingles long, set_id long, sigs array<long>, sizes array<int>, bitmap binary"), "scan")
    listed = scanned.select("set_id", F.inline(F.arrays_zip("sigs", "sizes"))).select(F.col("sigs").alias("sig"), "set_id", F.col("sizes").alias("size"))
    listed = listed.repartition("sig").sortWithinPartitions("sig", "set_id")
    shared = listed.mapInArrow(partial(_shared, num=num, den=den), "sig long, set_id long, weight long").groupBy("sig", "set_id").agg(F.sum("weight").alias("weight"))
    rest = scratch.table(shared, "shared")

    met = scratch.table(rest.select("set_id").distinct(), "met")
    sets = scanned.where("bitmap is not null").join(_small(met), "set_id", "left_semi")
    sets = scratch.table(sets.select("set_id", F.col("n_shingles").alias("n"), "bitmap").dropDuplicates(["set_id"]), "sets")
    scanned = scratch.table(scanned.select("doc_id", "n_shingles", "set_id"), "sizes")
    scratch.drop("scan")
    first = scratch.table(scanned.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first")), "first")

    groups, opened = None, None
    for turn, how in enumerate(("hub", *("best",) * ROUNDS, "all")):
        pairs = _bounded_pairs(_hub_pairs(rest, scratch), sets, num, den) if opened is None else _tile_pairs(rest, opened, sets, num, den, BEST if how == "best" else 0)
        pairs = scratch.table(pairs, f"pairs-{turn}")
        found = scratch.table(_check_pairs(pairs, _elements(pairs, first, texts, words, scratch, turn), scratch, turn, num, den), f"edges-{turn}")
        edges = found if groups is None else found.union(groups.where("node <> component").select("node", "component"))
        groups = scratch.table(components(edges, scratch, f"cc-{turn}"), f"groups-{turn}")
        if how == "all":
            break
        # buckets that still hold sets of several components
        listing = rest.drop("component").join(groups.withColumnRenamed("node", "set_id"), "set_id", "left").select("sig", "set_id", F.coalesce("component", "set_id").alias("component"))
        listing = scratch.table(listing, f"named-{turn}")
        opened = _opened(listing, scratch, turn)
        if opened.isEmpty():
            break
        rest = listing.join(opened, "sig", "left_semi")

    # the smallest document of each component; a hot set or component meets one row of a written table, so its rows can be split
    joined = scratch.table(groups.withColumnRenamed("node", "set_id").join(first, "set_id"), "joined")
    least = scratch.table(joined.groupBy("component").agg(F.min("first").alias("least")), "least")
    joined = joined.join(least, "component").select("set_id", "component", "least")
    known = first.join(joined, "set_id", "left").select("set_id", F.coalesce("component", "set_id").alias("group"), F.coalesce("least", "first").alias("least"))
    known = scratch.table(known, "known")
    out = scanned.join(known, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), *(["set_id", "group"] if named else []))
    out = scratch.table(out, "out")
    scratch.drop(*(scratch.kept - {"out"}))
    return out
