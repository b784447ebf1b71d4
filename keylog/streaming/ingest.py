"""Structured Streaming into a store: one committed run per micro-batch, replays skipped by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from keylog.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, order: str, name: str = "ingest") -> DataStreamWriter:
    """A writer that commits each micro-batch of (key, value, is_delete, order) to the store.

    Within a batch the last row of a key by ``order`` wins, across batches the later batch.
    The batch id goes into the manifest in the same commit, so a batch that Spark
    runs again after a failure changes nothing.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        store.put_df(batch, order=order, batch_id=f"{name}:{batch_id}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
