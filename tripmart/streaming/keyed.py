"""SCD 1 and SCD 2 tables kept up to date by a stream, on plain parquet.

A micro-batch is one partition of a table of changes, written by overwrite, so that a replayed batch replaces itself and a
batch costs what arrived, not what is stored. Current rows and versions are ordinary queries over that table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tripmart.operators.history import history
from tripmart.operators.latest import latest
from tripmart.sources.files import read_table
from tripmart.streaming.runs import per_batch

BATCH = "batch"


def _append(batch: DataFrame, target: str, number: int) -> None:
    batch.write.mode("overwrite").parquet(f"{target}/{BATCH}={number}")


def changes(spark: SparkSession, target: str) -> DataFrame | None:
    """All changes taken so far; a stream has one schema, so one footer tells it. None before the first batch."""
    found = read_table(spark, target, merge=False)
    return None if found is None else found.drop(BATCH)


def upsert_stream(stream: DataFrame, target: str, keys: str | Sequence[str], sequence: str | Sequence[str]) -> DataStreamWriter:
    """Keep the newest row per key of each batch of `stream` at `target`; stale rows lose whenever they arrive."""
    return per_batch(stream, lambda batch, number: _append(latest(batch, keys, sequence), target, number))


def read_upserted(spark: SparkSession, target: str, keys: str | Sequence[str], sequence: str | Sequence[str]) -> DataFrame | None:
    """Current rows: the newest per key. Tasks keep one row per key before the shuffle.

    One batch alone holds one row per key already, so nothing is shuffled to read it.
    """
    found = changes(spark, target)
    if found is None or _batches(spark, target, 2) < 2:
        return found
    return latest(found, keys, sequence)


def _batches(spark: SparkSession, target: str, most: int) -> int:
    """How many batches with rows there are, up to `most`; no column is read."""
    return read_table(spark, target, merge=False).select(BATCH).distinct().limit(most).count()


def history_stream(stream: DataFrame, target: str) -> DataStreamWriter:
    """Keep the whole change log of `stream` at `target`: a late row may split or join versions of any age."""
    return per_batch(stream, lambda batch, number: _append(batch, target, number))


def read_history(spark: SparkSession, target: str, keys: str | Sequence[str], sequence: str,
                 tracked: Sequence[str]) -> DataFrame | None:
    """SCD 2 versions of all rows taken so far, by sequence, whatever batches they came in."""
    found = changes(spark, target)
    return None if found is None else history(found, keys, sequence, tracked)
