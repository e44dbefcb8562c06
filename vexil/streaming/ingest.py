"""Structured Streaming into a store: every micro-batch is one logged add, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vexil.sources.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start adding a stream's rows (vector, metadata) to a store.

    A batch that is repeated after a failure is known by its number, which the log keeps with the
    checkpoint folder's name, and isn't added again. Empty batches leave no entry.
    """

    def add(df: DataFrame, batch: int) -> None:
        rows = df.persist()
        if not rows.isEmpty():
            store.add(rows, checkpoint, batch)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
