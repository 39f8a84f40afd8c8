"""Message offsets as intervals: what has landed, what is missing between, what came more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of a block. A task orders one block; only intervals at its borders are ordered per partition.
BLOCK = 1_000_000


def landed_intervals(df: DataFrame, keys: Sequence[str], offset: str, block: int = BLOCK) -> DataFrame:
    """`keys`, `first`, `last`, `messages`, `missing_after`: runs of consecutive offsets, and how many are lost behind each.

    `messages` above last - first + 1 means copies. `missing_after` is null behind the last run. Copies are counted
    before anything is ordered. Runs are found within blocks of offsets; those that touch a block's border are then
    joined over the blocks, so a partition with all messages is never ordered by one task. Null offsets are left out.
    """
    at = F.col(offset).cast("long")
    each = df.where(at.isNotNull()).groupBy(*keys, at.alias("_at")).agg(F.count("*").alias("_n")).withColumn(
        "_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at")
    runs = each.withColumn("_run", F.col("_at") - F.row_number().over(inside)).groupBy(*keys, "_block", "_run").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.sum("_n").alias("messages"))
    among = Window.partitionBy(*keys, "_block").orderBy("first")
    runs = runs.withColumn("_next", F.lead("first").over(among)).withColumn("_opens", F.row_number().over(among) == 1)
    border = F.col("_next").isNull() | F.col("_opens")
    # at most two rows a block: the first run of a block and the last one
    over = Window.partitionBy(*keys).orderBy("first")
    edges = runs.where(border).withColumn("_next", F.coalesce("_next", F.lead("first").over(over))).withColumn(
        "_starts", F.coalesce(F.col("first") != F.lag("last").over(over) + 1, F.lit(True)).cast("int")).withColumn(
        "_run", F.sum("_starts").over(over)).groupBy(*keys, "_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("messages").alias("messages"),
        F.max_by("_next", "first").alias("_next"))
    columns = [*keys, "first", "last", "messages", "_next"]
    return runs.where(~border).select(*columns).unionByName(edges.select(*columns)).select(
        *keys, "first", "last", "messages", (F.col("_next") - F.col("last") - 1).alias("missing_after"))


def repeated_offsets(df: DataFrame, keys: Sequence[str], offset: str) -> DataFrame:
    """`keys`, `offset`, `copies` of every offset that landed more than once."""
    return df.where(F.col(offset).isNotNull()).groupBy(*keys, F.col(offset).cast("long").alias("offset")).agg(
        F.count("*").alias("copies")).where("copies > 1")
