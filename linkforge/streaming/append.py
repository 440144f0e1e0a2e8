"""New target records as a stream: their keys are appended to a Parquet table in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from linkforge.functions.text import preprocess
from linkforge.operators.sparse import keys


def append_keys(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start appending the blocking keys of a record stream to ``path``; runs until the input at hand is done.

    Weights depend on all targets, so they are computed from the table when it is read. Each batch
    overwrites the folder of its own number, so a batch that is repeated after a failure is stored once.
    """
    def store(batch: DataFrame, number: int) -> None:
        keys(preprocess(batch)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
