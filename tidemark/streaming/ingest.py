"""Streams of changes: into a table by micro-batches, or as a running newest-wins state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.table import VersionedTable
from tidemark.schema import PUT


def ingest(stream: DataFrame, table: VersionedTable, checkpoint: str, index: str = "idx", **trigger) -> StreamingQuery:
    """Each micro-batch of (idx, key, op, value) is one atomic batch of the table.

    A batch that is run again after a failure is written again with newer
    numbers; as the same operations in the same order, it leaves the same state.
    """

    def apply(batch: DataFrame, _: int) -> None:
        table.write_frame(batch.select(F.col(index).alias("idx"), "key", "op", "value"))

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_state(stream: DataFrame) -> DataFrame:
    """(key, seq, op, value, live) of the newest row of each key so far, for update mode."""
    newest = F.max_by(F.struct("op", "value"), "seq")
    return stream.groupBy("key").agg(F.max("seq").alias("seq"), newest.alias("n")).select("key", "seq", "n.op", "n.value", (F.col("n.op") == PUT).alias("live"))
