"""Vector quantizers: half precision, 8 bits, product codes, and one bit a dimension.

A quantizer trains on a DataFrame (or is made from parameters), encodes rows of a numpy matrix to rows of bytes, decodes them,
and gives distances from queries to codes. Half and Byte encode the query too; Product looks distances up in a table of
each query; SignBit estimates them from sign bits of a rotated residual, with an error bound. All serialise to JSON.
"""

from __future__ import annotations

import json
from typing import ClassVar, Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.metrics import Metric, doubles, metric


class Quantizer(Protocol):
    kind: ClassVar[str]
    dim: int

    def encode(self, x: np.ndarray) -> np.ndarray: ...
    def decode(self, codes: np.ndarray) -> np.ndarray: ...
    def prepare(self, q: np.ndarray): ...  # what distances needs of the queries, made once for all codes
    def distances(self, q: np.ndarray, codes: np.ndarray, ready=None) -> np.ndarray: ...
    def code_size(self) -> int: ...


def compression(quantizer: Quantizer) -> float:
    """Bytes of 32-bit floats over bytes of a code."""
    return 4 * quantizer.dim / quantizer.code_size()


def by_metric(quantizer: Quantizer, q: np.ndarray, codes: np.ndarray, by: str | Metric, ready=None) -> np.ndarray:
    """Distances under any metric: the quantizer's own for (squared) Euclidean, else from decoded vectors. ready: what `prepare` has made of q."""
    m = metric(by)
    if m.name in ("l2", "euclidean"):
        d = quantizer.distances(q, codes, ready)
        return np.sqrt(d) if m.name == "euclidean" else d
    return m.exact(q[:, None, :], quantizer.decode(codes)[None])


class Half:
    """IEEE half precision, 2 bytes a dimension, little endian."""

    kind = "f16"

    def __init__(self, dim: int):
        self.dim = dim

    @classmethod
    def train(cls, vectors: DataFrame) -> "Half":
        return cls(_dim(vectors))

    def code_size(self) -> int:
        return 2 * self.dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(x.astype(np.float32).astype("<f2")).view(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes).view("<f2").astype(np.float64)

    def prepare(self, q: np.ndarray) -> np.ndarray:
        return self.decode(self.encode(q))

    def distances(self, q: np.ndarray, codes: np.ndarray, ready: np.ndarray | None = None) -> np.ndarray:
        return metric("l2").exact((self.prepare(q) if ready is None else ready)[:, None, :], self.decode(codes)[None])

    def to_json(self) -> dict:
        return {"kind": self.kind, "dim": self.dim}

    @classmethod
    def from_json(cls, x: dict) -> "Half":
        return cls(x["dim"])

    @staticmethod
    def rounded(x: Column) -> Column:
        """An element as half precision has it, as an expression (magnitudes up to 65504)."""
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)).cast("double") - 10)
        size = F.bround(F.abs(x) / step) * step
        return F.when(x == 0, x).when(x < 0, -size).otherwise(size)  # a rounded zero keeps its sign


class Byte:
    """One byte a dimension: (x - lo) / scale, rounded half to even and held to 0..255, one range for all dimensions."""

    kind = "int8"

    def __init__(self, dim: int, scale: float, offset: float):
        self.dim, self.scale, self.offset = dim, scale, offset

    @classmethod
    def train(cls, vectors: DataFrame) -> "Byte":
        r = vectors.agg(F.min(F.array_min(doubles("embedding"))).alias("lo"), F.max(F.array_max(doubles("embedding"))).alias("hi")).first()
        if r.lo is None:
            raise ValueError("no vectors to train on")
        return cls(_dim(vectors), (r.hi - r.lo) / 255 or 1.0, r.lo)

    def code_size(self) -> int:
        return self.dim

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.offset) / self.scale), 0, 255).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes * self.scale + self.offset

    def prepare(self, q: np.ndarray) -> np.ndarray:
        return self.encode(q).astype(np.float64)

    def distances(self, q: np.ndarray, codes: np.ndarray, ready: np.ndarray | None = None) -> np.ndarray:
        a, b = self.prepare(q) if ready is None else ready, codes.astype(np.float64)
        return np.maximum((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None], 0) * (self.scale * self.scale)  # whole numbers: exact

    def column(self, v: Column) -> Column:
        """The code as an array of whole numbers, as an expression."""
        return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround((x - self.offset) / self.scale))).cast("int"))

    def to_json(self) -> dict:
        return {"kind": self.kind, "dim": self.dim, "scale": self.scale, "offset": self.offset}

    @classmethod
    def from_json(cls, x: dict) -> "Byte":
        return cls(x["dim"], x["scale"], x["offset"])


class Product:
    """Product codes: the vector in `parts` equal parts, each the number of its nearest of at most 256 centres."""

    kind = "pq"

    def __init__(self, books: np.ndarray):
        self.books = np.asarray(books, dtype=np.float64)  # parts, centres, dimensions of a part
        self.dim = self.books.shape[0] * self.books.shape[2]

    @classmethod
    def train(cls, vectors: DataFrame, parts: int = 8, centres: int = 256, rounds: int = 10, sample: int = 50_000, seed: int = 1) -> "Product":
        """k-means of each part, over at most `sample` vectors (by a hash of the id), a part to a task."""
        dim = _dim(vectors)
        if not 1 <= centres <= 256:
            raise ValueError("a part has 1 to 256 centres")
        if parts < 1 or dim % parts:
            raise ValueError(f"{dim} dimensions don't divide into {parts} parts")
        width = dim // parts
        total = vectors.count()
        share = int(min(1.0, 1.1 * sample / total) * (1 << 30))
        drawn = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) <= share).orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(sample)
        cut = drawn.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), doubles("embedding").alias("e")).select("vec_id", "part", F.slice("e", F.col("part") * width + 1, width).alias("x"))

        def fit(key, table):
            import pyarrow as pa

            rows = table.sort_by("vec_id")
            x = np.array(rows.column("x").to_pylist())
            book = lloyd(x, centres, rounds, np.random.default_rng(seed + key[0].as_py()))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "book": pa.array([book.ravel().tolist()], pa.list_(pa.float64()))})

        found = cut.groupBy("part").applyInArrow(fit, "part int, book array<double>").collect()
        return cls(np.array([np.array(r.book).reshape(centres, width) for r in sorted(found, key=lambda r: r.part)]))

    def code_size(self) -> int:
        return len(self.books)

    def _parts(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.books), -1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.books)), dtype=np.uint8)
        for m, part in enumerate(np.moveaxis(self._parts(x), 1, 0)):
            out[:, m] = metric("l2").exact(part[:, None, :], self.books[m][None]).argmin(axis=1)  # the first of equals
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.books[m][codes[:, m]] for m in range(len(self.books))], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts to all centres: queries, parts, centres."""
        return np.stack([metric("l2").exact(part[:, None, :], self.books[m][None]) for m, part in enumerate(np.moveaxis(self._parts(q), 1, 0))], axis=1)

    prepare = tables

    def distances(self, q: np.ndarray, codes: np.ndarray, ready: np.ndarray | None = None) -> np.ndarray:
        table, out = self.tables(q) if ready is None else ready, np.zeros((len(q), len(codes)))
        for m in range(len(self.books)):
            out += table[:, m, :][:, codes[:, m]]
        return out

    def direct(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The same distances without tables: of each query's parts to the centres that the codes name, summed in the order of the parts."""
        parts, out = self._parts(q), np.zeros((len(q), len(codes)))
        for m in range(len(self.books)):
            out += metric("l2").exact(parts[:, m][:, None, :], self.books[m][codes[:, m]][None])
        return out

    def to_json(self) -> dict:
        return {"kind": self.kind, "books": self.books.tolist()}

    @classmethod
    def from_json(cls, x: dict) -> "Product":
        return cls(np.array(x["books"]))


class SignBit:
    """One bit a dimension of the rotated unit residual from a centre, with two floats: squared norm and a correction factor.

    Rotation is three rounds of random signs and a Walsh-Hadamard transform over `wide` dimensions, a power of two. The
    query's rotated residual is taken in 4 bits. The estimate's error stays within `bound` with high probability.
    """

    kind = "sign"
    #: Standard deviations of the estimate in its error bound.
    SPREAD = 1.9

    def __init__(self, centre: np.ndarray, seed: int = 7):
        self.centre, self.seed = np.asarray(centre, dtype=np.float64), seed
        self.dim = len(self.centre)
        self.wide = 1 << max(6, (self.dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, self.wide))

    @classmethod
    def train(cls, vectors: DataFrame, seed: int = 7) -> "SignBit":
        from nearfield.operators.measure import centroid

        return cls(np.array(centroid(vectors).first().centroid), seed)

    def code_size(self) -> int:
        return self.wide // 8 + 8

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        h = 1
        while h < self.wide:
            x = x.reshape(len(x), -1, 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), -1)
            h *= 2
        return x / np.sqrt(self.wide)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        x = np.pad(x, ((0, 0), (0, self.wide - x.shape[1])))
        for s in self.signs:
            x = self._hadamard(x * s)
        return x

    def unrotate(self, x: np.ndarray) -> np.ndarray:
        for s in self.signs[::-1]:
            x = self._hadamard(x) * s
        return x[:, : self.dim]

    def encode(self, x: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
        """Codes of the residuals from `centre`, or from the own one."""
        x = self.rotate(x - (self.centre if centre is None else centre))
        bits = np.packbits(x > 0, axis=1, bitorder="little")
        norm2, spread = (x * x).sum(axis=1), np.abs(x).sum(axis=1) / np.sqrt(self.wide)
        # x is a residual of length n; n / (sum |unit| / sqrt(wide)) is n * n / (sum |x| / sqrt(wide))
        factor = np.divide(norm2, spread, out=np.zeros_like(norm2), where=spread > 0)
        return np.concatenate([bits, np.stack([norm2, factor], axis=1).astype("<f4").view(np.uint8)], axis=1)

    def _open(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = self.wide // 8
        tail = np.ascontiguousarray(codes[:, cut:]).view("<f4").astype(np.float64)
        return np.unpackbits(codes[:, :cut], axis=1, bitorder="little").astype(np.float64), tail[:, 0], tail[:, 1]

    def _words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sign bits as 64-bit words, squared norms, correction factors)."""
        cut = self.wide // 8
        tail = np.ascontiguousarray(codes[:, cut:]).view("<f4").astype(np.float64)
        return np.ascontiguousarray(codes[:, :cut]).view("<u8"), tail[:, 0], tail[:, 1]

    def decode(self, codes: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
        bits, norm2, _ = self._open(codes)
        return self.unrotate((2 * bits - 1) / np.sqrt(self.wide) * np.sqrt(norm2)[:, None]) + (self.centre if centre is None else centre)

    def prepare(self, q: np.ndarray, centre: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(lengths, least elements, steps, sums, bit planes) of the queries' rotated unit residuals in 4 bits; a plane is a row of 64-bit words."""
        r = self.rotate(q - (self.centre if centre is None else centre))
        length = np.linalg.norm(r, axis=1)
        unit = np.divide(r, length[:, None], out=np.zeros_like(r), where=length[:, None] > 0)
        lo, hi = unit.min(axis=1), unit.max(axis=1)
        step = np.maximum((hi - lo) / 15, 1e-30)
        grid = np.clip(np.rint((unit - lo[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
        planes = np.stack([np.packbits(grid >> p & 1, axis=1, bitorder="little").view("<u8") for p in range(4)], axis=1)
        return length, lo, step, (grid * step[:, None] + lo[:, None]).sum(axis=1), planes

    def estimates(self, q: np.ndarray, codes: np.ndarray, centre: np.ndarray | None = None, ready=None) -> tuple[np.ndarray, np.ndarray]:
        """(estimated squared distances, bounds of their errors), queries by codes. Inner products are popcounts of the codes' words with the queries' planes."""
        words, norm2, factor = self._words(codes)
        length, lo, step, total, planes = self.prepare(q, centre) if ready is None else ready
        shared = np.zeros((len(length), len(codes)), dtype=np.int32)
        for w in range(words.shape[1]):
            for p in range(4):
                shared += np.bitwise_count(planes[:, p, w, None] & words[None, :, w]).astype(np.int32) << p
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        inner = (2 * (step[:, None] * shared + lo[:, None] * ones[None]) - total[:, None]) / np.sqrt(self.wide)
        about = norm2[None] + (length**2)[:, None] - 2 * length[:, None] * factor[None] * inner
        ip = np.divide(np.sqrt(norm2), factor, out=np.zeros_like(norm2), where=factor > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = 2 * length[:, None] * (factor * self.SPREAD * np.sqrt(np.maximum(1 - ip * ip, 0) / (self.wide - 1)))[None]
        return np.maximum(about, 0), np.where((ip <= 0)[None] & (norm2 > 0)[None], np.inf, bound)

    def floors(self, q: np.ndarray, codes: np.ndarray, centres: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
        """What the squared distances can't be below, queries by codes, whatever the rotation; `of` names the row of `centres` of each code.

        With n, L the lengths of a code's and a query's residual, b the signs' unit vector, and cos a, cos b the cosines of b with the
        two, the inner product is at most n L cos(a - b). Slack covers the roundings; where no number comes out nothing is known.
        """
        z = self.rotate(q)
        return self.floored(z, (z * z).sum(axis=1), *self.opened(codes, centres, of))

    def opened(self, codes: np.ndarray, centres: np.ndarray | None = None, of: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """What `floored` needs of codes: signs, their products with the centres, lengths, cosines and sines, the rotated centres and which of them a code has."""
        bits, norm2, factor = self._open(codes)
        signs = (2 * bits - 1) / np.sqrt(self.wide)
        c = self.rotate(self.centre[None] if centres is None else centres)
        of = np.zeros(len(codes), dtype=np.int64) if of is None else of
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            ip = np.divide(np.sqrt(norm2), factor, out=np.zeros_like(norm2), where=factor > 0)
            across = np.sqrt(np.maximum(1 - (ip * (1 - 1e-6)) ** 2, 0))
            tiny = norm2 < 1e-36  # these signs say nothing
            return signs, (c[of] * signs).sum(axis=1), norm2, np.where(tiny, 0, ip), np.where(tiny, 1, across), c, of

    def floored(self, z: np.ndarray, z2: np.ndarray, signs: np.ndarray, own: np.ndarray, norm2: np.ndarray, ip: np.ndarray, across: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The floors of rotated queries and their squared lengths."""
        with np.errstate(invalid="ignore", over="ignore"):
            c2 = (c * c).sum(axis=1)
            size2 = z2[:, None] + c2.max(initial=0)  # of the numbers that roundings go with
            near, back = np.unique(of, return_inverse=True)
            long2 = np.maximum(z2[:, None] - 2 * (z @ c[near].T) + c2[near], 0)[:, back]
            along = z @ signs.T
            along -= own
            most = along * along
            np.subtract(long2, most, out=most)
            np.maximum(most, 0, out=most)
            most += 1e-12 * size2
            np.sqrt(most, out=most)
            most *= 2 * np.sqrt(norm2) * across
            along *= 2 * np.sqrt(norm2) * ip
            long2 *= 1 - 6e-6
            long2 += norm2 * (1 - 6e-6)
            long2 -= most
            long2 -= along
            long2 -= 1e-12 * size2 + 1e-17
            return long2

    def distances(self, q: np.ndarray, codes: np.ndarray, ready=None) -> np.ndarray:
        return self.estimates(q, codes, ready=ready)[0]

    def to_json(self) -> dict:
        return {"kind": self.kind, "centre": self.centre.tolist(), "seed": self.seed}

    @classmethod
    def from_json(cls, x: dict) -> "SignBit":
        return cls(np.array(x["centre"]), x["seed"])


KINDS = {c.kind: c for c in (Half, Byte, Product, SignBit)}


def train(kind: str, vectors: DataFrame, **options) -> Quantizer:
    if kind not in KINDS:
        raise ValueError(f"unknown quantizer {kind!r}; known: {', '.join(sorted(KINDS))}")
    return KINDS[kind].train(vectors, **options)


def dumps(quantizer: Quantizer) -> str:
    return json.dumps(quantizer.to_json())


def save(spark: SparkSession, quantizer: Quantizer, path: str) -> None:
    """Write a quantizer to a file of any Hadoop file system; an existing file is an error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(dumps(quantizer).encode()))
    out.close()


def load(spark: SparkSession, path: str) -> Quantizer:
    """A quantizer from its file; a damaged file is an error."""
    try:
        return loads(spark.read.text(path, wholetext=True).first()[0])
    except (TypeError, KeyError, ValueError) as bad:
        raise ValueError(f"{path} holds no quantizer") from bad


def loads(text: str) -> Quantizer:
    x = json.loads(text)
    if x.get("kind") not in KINDS:
        raise ValueError("not a quantizer")
    return KINDS[x["kind"]].from_json(x)


def stats(quantizer: Quantizer) -> dict:
    return {"kind": quantizer.kind, "dim": quantizer.dim, "code_size": quantizer.code_size(), "compression": compression(quantizer)}


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds and Lloyd rounds; an empty cluster moves to a random row, and k beyond the rows repeats some."""
    seeds = [x[rng.integers(len(x))]]
    near = ((x - seeds[0]) ** 2).sum(axis=1)
    while len(seeds) < k:
        weight = near.sum()
        seeds.append(x[rng.choice(len(x), p=near / weight)] if weight > 0 else x[len(seeds) % len(x)])
        near = np.minimum(near, ((x - seeds[-1]) ** 2).sum(axis=1))
    centres = np.array(seeds)
    for _ in range(rounds):
        d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None]
        own = d.argmin(axis=1)
        n, sums = np.bincount(own, minlength=k), np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        for i in np.flatnonzero(n == 0):
            if len(x) >= k:
                centres[i] = x[rng.integers(len(x))]
    return centres


def encoded(vectors: DataFrame, quantizer: Quantizer) -> DataFrame:
    """vectors with a column code (binary) in place of embedding."""
    import pyarrow as pa

    from nearfield.operators.search import matrix

    text = dumps(quantizer)

    def work(batches):
        own = loads(text)
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            codes = own.encode(matrix(batch.column(at), own.dim)) if len(batch) else np.empty((0, 0), np.uint8)
            columns = list(batch.columns)
            columns[at] = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=[n if n != "embedding" else "code" for n in batch.schema.names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "embedding" else "code binary" for f in vectors.schema)
    return vectors.mapInArrow(work, schema)


def unpacked(column, quantizer: Quantizer) -> np.ndarray:
    """Codes of an Arrow binary column as rows of bytes."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint8).reshape(len(column), quantizer.code_size())


def _dim(vectors: DataFrame) -> int:
    r = vectors.agg(F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
    if r.a is None:
        raise ValueError("no vectors to train on")
    if r.a != r.b:
        raise ValueError("vectors differ in dimensions")
    return r.a
