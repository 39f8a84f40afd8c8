"""Starting a query and waiting for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def start(writer: DataStreamWriter, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start with a checkpoint; by default take all that is there and stop, else run every `every`."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def per_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.outputMode(mode).foreachBatch(action)


def append_to(stream: DataFrame, path: str) -> DataStreamWriter:
    """Append-only parquet table; the sink's own log makes a replayed batch harmless."""
    return stream.writeStream.outputMode("append").format("parquet").option("compression", "zstd").option("path", path)
