"""Versioned stores of Parquet tables in any Hadoop file system.

A store is a folder: ``name/v=N`` tables and numbered manifests that say which version of each table belongs together, with
the metadata. A table may be kept in parts, ``name/v=N/part=K``, each with a version of its own, so that a change writes only the
parts it touches. A manifest is created, never replaced, so of two writers that publish the same number one fails. Readers
open the newest whole manifest. A snapshot copies only the versions that its target lacks, part by part, in tasks. What no kept
manifest names is deleted by `vacuum`.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.number, self.meta = 0, {}
        #: A table's version, or the version of each of its parts.
        self.tables: dict[str, int | dict[str, int]] = {}
        self.schemas: dict[str, dict] = {}

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._at(*parts))] if self.fs.exists(self._at(*parts)) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removeprefix("manifest-").removesuffix(".json")) for n in self._names() if n.startswith("manifest-") and n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{number}.json", wholetext=True).collect())
        try:
            x = json.loads(text)
            tables = {k: {p: int(n) for p, n in v.items()} if isinstance(v, dict) else int(v) for k, v in x["tables"].items()}
            return {"tables": tables, "meta": dict(x["meta"]), "schemas": dict(x["schemas"])}
        except (ValueError, KeyError, TypeError, AttributeError) as bad:
            raise ValueError(f"{self.path}/manifest-{number}.json is damaged") from bad

    def open(self, number: int | None = None) -> "Store":
        """Read the newest manifest, or a numbered one."""
        found = self._numbers()
        if not found or number is not None and number not in found:
            raise FileNotFoundError(f"no store at {self.path}")
        self.number = found[-1] if number is None else number
        for k, v in self._manifest(self.number).items():
            setattr(self, k, v)
        for piece in self.pieces():
            if not self.fs.exists(self._at(*piece)) or not self.fs.exists(self._at(*piece[:2], "_SUCCESS")):
                raise ValueError(f"{self.path}/{'/'.join(piece)} is missing or incomplete")
        return self

    def pieces(self, tables: dict | None = None) -> list[tuple[str, ...]]:
        """The folders of all tables, parts apart: (name, v=N) or (name, v=N, part=K)."""
        out: list[tuple[str, ...]] = []
        for name, v in (self.tables if tables is None else tables).items():
            out += [(name, f"v={n}", f"part={p}") for p, n in sorted(v.items(), key=lambda x: int(x[0]))] if isinstance(v, dict) else [(name, f"v={v}")]
        return out

    def _next(self, name: str) -> int:
        return max([0, *(int(n.removeprefix("v=")) for n in self._names(name) if n.startswith("v="))]) + 1

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version of a table; it belongs to the store from the next publish on."""
        version = self._next(name)
        df.write.mode("error").parquet(f"{self.path}/{name}/v={version}")
        self.tables[name], self.schemas[name] = version, json.loads(df.schema.json())
        return self.read(name)

    def write_parts(self, name: str, df: DataFrame, part: Column, touched: set[int] | None = None) -> DataFrame:
        """Write new versions of the parts `touched` of a table (of all, without it) from df, which holds all their rows and no others."""
        version = self._next(name)
        df.withColumn("part", part).write.mode("error").partitionBy("part").parquet(f"{self.path}/{name}/v={version}")
        made = {n.removeprefix("part=") for n in self._names(name, f"v={version}") if n.startswith("part=")}
        before = self.tables.get(name, {})
        kept = {k: v for k, v in before.items() if touched is not None and int(k) not in touched}
        self.tables[name], self.schemas[name] = kept | dict.fromkeys(sorted(made, key=int), version), json.loads(df.drop("part").schema.json())
        return self.read(name)

    def append(self, name: str, df: DataFrame, most: int = 64) -> DataFrame:
        """Write df as one more part of a table in parts; where it has `most` of them, all are written as one."""
        parts = self.tables[name]
        if len(parts) >= most:
            return self.write_parts(name, self.read(name).unionByName(df), F.lit(0))
        number = max([-1, *map(int, parts)]) + 1
        return self.write_parts(name, df, F.lit(number), {number})

    def discard(self, *names: str) -> None:
        """Delete tables that aren't published."""
        for name in names:
            self.fs.delete(self._at(name), True)
            self.tables.pop(name, None)
            self.schemas.pop(name, None)

    def read(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A table, or of a table in parts some of them."""
        v, schema = self.tables[name], StructType.fromJson(self.schemas[name])
        if not isinstance(v, dict):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v={v}")
        paths = [f"{self.path}/{name}/v={n}/part={p}" for p, n in v.items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def publish(self, **meta) -> int:
        """Create the next manifest; fails if another writer has."""
        self.meta |= meta
        number = self.number + 1
        out = self.fs.create(self._at(f"manifest-{number}.json"), False)
        out.write(bytearray(json.dumps({"tables": self.tables, "meta": self.meta, "schemas": self.schemas}).encode()))
        out.close()
        self.number = number
        return number

    def snapshot(self, target: str) -> list[str]:
        """Publish this state at target as its next manifest; returns the tables and parts that had to be copied, each by a Spark job."""
        other, copied = Store(self.spark, target), []
        if other._numbers():
            other.open()
        there = set(other.pieces())
        for piece in self.pieces():
            if piece in there:
                continue
            rows = self.spark.read.schema(StructType.fromJson(self.schemas[piece[0]])).parquet("/".join([self.path, *piece]))
            rows.write.mode("overwrite").parquet("/".join([other.path, *piece]))
            if len(piece) == 3:  # a part's version is whole with its last copied part; the manifest comes after all
                other.fs.create(other._at(*piece[:2], "_SUCCESS"), True).close()
            copied.append("/".join((piece[0], *piece[2:])))
        other.tables, other.meta, other.schemas = json.loads(json.dumps(self.tables)), dict(self.meta), dict(self.schemas)
        other.publish()
        return copied

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what none of the newest `keep` manifests and not this state names: older manifests, versions, parts and drafts. Returns their paths."""
        numbers, gone = self._numbers(), []
        wanted = set(self.pieces())
        for n in numbers[max(0, len(numbers) - keep) :]:
            wanted |= set(self.pieces(self._manifest(n)["tables"]))
        paths = [(f"manifest-{n}.json",) for n in numbers[: max(0, len(numbers) - keep)]]
        for name in self._names():
            for v in self._names(name) if not name.endswith(".json") else ():
                if not v.startswith("v="):
                    continue
                inner = [x for x in self._names(name, v) if x.startswith("part=")]
                if (name, v) in wanted or any((name, v, x) in wanted for x in inner):
                    paths += [(name, v, x) for x in inner if (name, v) not in wanted and (name, v, x) not in wanted]
                else:
                    paths.append((name, v))
        for path in paths:
            self.fs.delete(self._at(*path), True)
            gone.append("/".join(path))
        return gone

    def pack(self) -> bytes:
        """The store's newest state as one blob, for stores small enough to hold in memory."""
        import io
        import os
        import tarfile
        import tempfile

        out = io.BytesIO()
        with tempfile.TemporaryDirectory() as folder, tarfile.open(fileobj=out, mode="w:gz") as tar:
            marks = {(*piece[:2], "_SUCCESS") for piece in self.pieces() if len(piece) == 3}
            for part in [(f"manifest-{self.number}.json",), *self.pieces(), *sorted(marks)]:
                to = os.path.join(folder, *part)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                self.fs.copyToLocalFile(False, self._at(*part), self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{to}"), True)
            tar.add(folder, ".")
        return out.getvalue()

    @classmethod
    def unpack(cls, spark: SparkSession, blob: bytes, path: str) -> "Store":
        """A blob's store, at a new path."""
        import io
        import os
        import tarfile
        import tempfile

        own = cls(spark, path)
        try:
            with tempfile.TemporaryDirectory() as folder, tarfile.open(fileobj=io.BytesIO(blob), mode="r:gz") as tar:
                tar.extractall(folder, filter="data")
                for part in os.listdir(folder):
                    own.fs.copyFromLocalFile(False, False, spark._jvm.org.apache.hadoop.fs.Path(f"file://{folder}/{part}"), own._at(part))
        except (tarfile.TarError, EOFError, OSError) as bad:
            raise ValueError("not a packed store") from bad
        return own.open()


class Packed:
    """To and from one blob, for indexes over a store that are small enough to hold in memory."""

    store: Store

    def to_bytes(self) -> bytes:
        return self.store.pack()

    @classmethod
    def from_bytes(cls, spark: SparkSession, blob: bytes, path: str):
        """A blob's index, kept at a new path."""
        Store.unpack(spark, blob, path)
        return cls.open(spark, path)  # type: ignore[attr-defined]
