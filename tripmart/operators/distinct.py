"""Exact distinct counts that merge: one bitmap per group and block of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmart.operators.sizing import settled


def numbered(df: DataFrame, column: str) -> DataFrame:
    """`column`, `number`: distinct values that are not null, numbered from 1 without gaps.

    Values keep their place in the part that Spark dealt them to; sizes of the parts (one row each) give the rest. No
    task sees all values. Numbers hold for one call: keep the table as long as bitmaps are built on it.
    """
    values = settled(df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(
        "_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33).alias("_part")
    sizes = values.groupBy(part).agg(F.count("*").alias("_size"))
    ahead = sizes.withColumn("_ahead", F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).drop("_size")
    return values.withColumn("_part", part).join(ahead, "_part").select(
        column, (F.lit(1) + F.col("_ahead") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("number"))


def bitmaps(df: DataFrame, keys: Sequence[str], numbers: DataFrame, column: str) -> DataFrame:
    """`keys`, `block`, `bits`: who occurs in each group, 32,768 numbers a block (4 kB)."""
    met = df.join(numbers, column)
    return met.groupBy(*keys, F.bitmap_bucket_number("number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def count_distinct(maps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`keys`, `distinct`: bitmaps of any finer groups merged to these, and counted."""
    merged = maps.groupBy(*keys, "block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("_n"))
    return merged.groupBy(*keys).agg(F.sum("_n").alias("distinct"))
