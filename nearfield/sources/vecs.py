"""The fvecs, ivecs and bvecs file formats as Spark data sources.

A record is a little-endian 32-bit dimension and that many elements: 32-bit floats, 32-bit whole numbers, or bytes. Files may
mix dimensions. A file that ends within a record is an error, a partial header included. Readers go through Spark's own file
reader (any Hadoop store); records are numbered by their file's order and place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file's beginning that the driver reads itself.
PREFIX = 16 << 20
_TYPES = {"fvecs": ("<f4", "float", pa.float32()), "ivecs": ("<i4", "int", pa.int32()), "bvecs": ("u1", "smallint", pa.int16())}


def _kind(kind: str):
    if kind not in _TYPES:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(_TYPES)}")
    return _TYPES[kind]


def parse(data: bytes, kind: str, first: int | None = None) -> list[np.ndarray]:
    """The vectors of a file's bytes, or the first so many."""
    dtype, _, _ = _kind(kind)
    width, out, at = np.dtype(dtype).itemsize, [], 0
    while at < len(data) and (first is None or len(out) < first):
        if at + 4 > len(data):
            raise ValueError(f"{len(data) - at} bytes follow the last record")
        dim = int.from_bytes(data[at : at + 4], "little")
        end = at + 4 + dim * width
        if end > len(data):
            raise ValueError(f"the file ends within a record of {dim} dimensions")
        out.append(np.frombuffer(data, dtype, dim, at + 4))
        at = end
    return out


def dump(vectors, kind: str) -> bytes:
    dtype, _, _ = _kind(kind)
    return b"".join(len(v).to_bytes(4, "little") + np.asarray(v).astype(dtype).tobytes() for v in vectors)


def read(spark: SparkSession, path: str, kind: str, first: int | None = None, scaled: bool = False) -> DataFrame:
    """(vec_id, embedding) of a file, or of the files below a folder. scaled: bytes over 255, as floats. first: so many records of each file."""
    _, sql, arrow = _kind(kind)
    if scaled and kind != "bvecs":
        raise ValueError("only bytes are scaled")
    files = spark.read.format("binaryFile").load(path)
    order = [r.path for r in files.select("path").orderBy("path").collect()]  # names of files
    place = spark.createDataFrame([(p, i) for i, p in enumerate(order)], "path string, file_no long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                vectors = parse(data, kind, first)
                for lo in range(0, len(vectors), 4096):
                    part = vectors[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([no] * len(part), pa.int64()), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array([v.astype(arrow.to_pandas_dtype()) for v in part], pa.list_(arrow))], names=["file_no", "place", "embedding"])

    rows = files.join(F.broadcast(place), "path").select("file_no", "content").mapInArrow(work, f"file_no long, place long, embedding array<{sql}>")
    if len(order) == 1:
        rows = rows.select(F.col("place").alias("vec_id"), "embedding")
    else:  # a file's records follow those of the files before it
        counts = {r.file_no: r.n for r in rows.groupBy("file_no").agg(F.count("*").alias("n")).collect()}
        start, starts = 0, []
        for i in range(len(order)):
            starts.append((i, start))
            start += counts.get(i, 0)
        rows = rows.join(F.broadcast(spark.createDataFrame(starts, "file_no long, start long")), "file_no").select((F.col("start") + F.col("place")).alias("vec_id"), "embedding")
    if scaled:
        rows = rows.select("vec_id", F.transform("embedding", lambda x: (x / 255.0).cast("float")).alias("embedding"))
    return rows


def read_blocks(spark: SparkSession, path: str, kind: str, dim: int, first: int | None = None) -> DataFrame:
    """(vec_id, embedding) of files whose records all have `dim` dimensions, read in blocks: a file of any size is dealt out among tasks.

    first: so many records of all, in the files' order. A file that doesn't divide into such records, and a record of another dimension, are errors.
    """
    dtype, sql, _ = _kind(kind)
    record = 4 + dim * np.dtype(dtype).itemsize
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((x.getPath().toString(), x.getLen()) for x in fs.listStatus(at) if not x.getPath().getName().startswith((".", "_")))
    out, start = None, 0
    for name, size in files:
        if size % record:
            raise ValueError(f"{name} doesn't hold whole records of {dim} dimensions")
        want = size // record if first is None else min(size // record, first - start)
        if want <= 0:
            continue

        def opened(found: tuple[bytes, int], start: int = start) -> tuple[int, list]:
            data, place = found
            if int.from_bytes(data[:4], "little") != dim:
                raise ValueError(f"record {start + place} has {int.from_bytes(data[:4], 'little')} dimensions, not {dim}")
            return start + place, np.frombuffer(data, dtype, dim, 4).tolist()

        if want * record <= PREFIX and want < size // record:  # a short prefix isn't worth a pass over the file
            stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(name))
            data = bytes(stream.readNBytes(want * record))
            stream.close()
            rows = spark.sparkContext.parallelize([(data[i * record : (i + 1) * record], i) for i in range(want)])
        else:
            rows = spark.sparkContext.binaryRecords(name, record).zipWithIndex()
            rows = rows if want == size // record else rows.filter(lambda x, want=want: x[1] < want)
        found = spark.createDataFrame(rows.map(opened), f"vec_id long, embedding array<{sql}>")
        out, start = found if out is None else out.union(found), start + want
    return spark.createDataFrame([], f"vec_id long, embedding array<{sql}>") if out is None else out


def write(vectors: DataFrame, path: str, kind: str, files: int = 1) -> None:
    """Write vectors in the order of their ids to `files` files below the folder path, ranges of ids apart; an existing folder is an error."""
    _kind(kind)
    import pyarrow.fs
    from pyspark import TaskContext

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(path)
        name, n, out = f"{base}/part-{TaskContext.get().partitionId():05d}.{kind}", 0, None
        draft = f"{base}/.draft-{TaskContext.get().taskAttemptId()}"
        for batch in batches:
            if out is None and len(batch):
                out = store.open_output_stream(draft)
            if len(batch):
                out.write(dump(batch.column(1).to_pylist(), kind))
                n += len(batch)
        if out is not None:
            out.close()
            store.move(draft, name)  # a repeated attempt replaces an equal file
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    fs = vectors.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    store = fs.getFileSystem(vectors.sparkSession._jsc.hadoopConfiguration())
    if store.exists(fs):
        raise FileExistsError(path)
    store.mkdirs(fs)
    rows = vectors.select("vec_id", "embedding").repartitionByRange(max(1, files), "vec_id").sortWithinPartitions("vec_id")
    rows.mapInArrow(work, "n long").agg(F.sum("n")).collect()
