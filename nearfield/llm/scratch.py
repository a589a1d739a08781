"""Intermediate tables in the folder that all executors share.

Long plans are cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and not a re-computation. The folder is read from the session; where it is unset a local one is set, if all
executors are this process (tests), and else that is an error.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, without a trailing slash."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of rows that go to a Python worker at once; texts and what is made of them take several times that in each worker.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH bytes, from now on (plans run later); a smaller bound of the session's own stays."""
    now = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < now <= BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


class Scratch:
    """Tables of one operator call. Those that the result still reads stay until the driver's Python ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/nearfield-{what}-{uuid.uuid4().hex}", set()
        small_batches(spark)
        _pinned.append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return what was written."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.kept.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")
            self.kept.discard(name)

    def close(self) -> None:
        """Delete all tables of this call."""
        delete(self.spark, self.root)
        self.kept.clear()


_pinned: list[Scratch] = []


@atexit.register
def _clean() -> None:
    for x in _pinned:
        try:
            if x.kept and x.spark._jsc is not None:
                x.close()
        except Exception:  # the JVM is gone already; the shared folder's own cleaning takes over
            return
