"""Structured Streaming into the mutable indexes: each micro-batch is one version of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def feed(stream: DataFrame, index, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Apply a stream of (op, vec_id, embedding[, labels]) to a LayeredIndex or PostingIndex: op `add` appends, `delete` deletes by vec_id,
    deletes of a batch first.

    The number of the last batch applied is kept with the index, so a batch that is replayed after a failure changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        if number <= index.store.meta.get("batch", -1):
            return
        gone = batch.where("op = 'delete' and vec_id is not null").select("vec_id")
        new = batch.where("op = 'add'").select(*(c for c in ("embedding", "labels") if c in batch.columns))
        index.delete(gone, publish=False)  # of rows that were there before; a repeat changes nothing
        if not new.isEmpty():
            (index.add if hasattr(index, "add") else index.insert)(new, publish=False)
        index.store.publish(batch=number)

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
