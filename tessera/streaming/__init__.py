"""Continuous ingestion: an extension, the statement language has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import mutate
from ..storage import Table


def ingest(stream: DataFrame, table: Table, checkpoint: str, interval: str = "1 second", name: str | None = None) -> DataStreamWriter:
    """A writer that commits each micro-batch of ``(row, cf, value[, cq, ts, flag])`` as one segment.

    A batch is committed whole or not at all, and once: the manifest keeps the number
    of the last one under the stream's ``name`` (its checkpoint folder by default), so
    a batch that comes again after a failure is left out.
    """

    def commit(batch: DataFrame, number: int) -> None:
        table.append(mutate.checked(batch, table.schema), stamp=True, batch=(name or checkpoint, number))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(commit)
