"""Benchmark files in HDF5: two-dimensional datasets (train, test, neighbors, distances) as rows.

Needs h5py, which isn't a requirement of the library: without it every function here is an error. Tasks open the file themselves, through
the file system of its address, and each reads its own range of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task reads at once.
ROWS = 4096


@contextmanager
def _opened(path: str):
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 files needs h5py") from missing
    import pyarrow.fs

    store, name = pyarrow.fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as raw, h5py.File(raw, "r") as file:
        yield file


def _rows(batches: Iterator[pa.RecordBatch], path: str, dataset: str, total: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    with _opened(path) as file:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                lo = part * ROWS
                rows = file[dataset][lo : min(lo + ROWS, total)]
                yield pa.RecordBatch.from_arrays([pa.array(range(lo, lo + len(rows)), pa.int64()), pa.array(list(rows), pa.list_(kind))], names=["vec_id", "embedding"])


def read(spark: SparkSession, path: str, dataset: str = "train") -> DataFrame:
    """(vec_id, embedding) of a dataset; ids are places. path: an address such as file:///data/x.hdf5. A dataset that isn't there, or isn't a matrix, is an error."""
    with _opened(path) as file:
        if dataset not in file:
            raise ValueError(f"{path} has no dataset {dataset!r}")
        shape, whole = file[dataset].shape, file[dataset].dtype.kind in "iu"
    if len(shape) != 2:
        raise ValueError(f"{dataset} isn't a matrix")
    kind, name = (pa.int64(), "bigint") if whole else (pa.float32(), "float")
    parts = spark.range(-(-shape[0] // ROWS)).repartition(max(1, min(1024, -(-shape[0] // ROWS))))
    return parts.mapInArrow(partial(_rows, path=path, dataset=dataset, total=shape[0], kind=kind), f"vec_id long, embedding array<{name}>")
