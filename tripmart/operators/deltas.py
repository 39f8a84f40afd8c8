"""Sums and counts kept by deltas: a corrected row takes its old values out and puts the new ones in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.operators.latest import latest


def changed_rows(state: DataFrame | None, arriving: DataFrame, key: str, order: str, value_columns: Sequence[str]) -> DataFrame:
    """`_sign` 1 for rows that a batch puts in, -1 for rows of the state that they replace.

    The last row of a key in the batch counts, and only if it is not older than the state's (`order`).
    """
    newest = latest(arriving.select(key, order, *value_columns), key, order)
    if state is None:
        return newest.withColumn("_sign", F.lit(1))
    old = state.select(F.col(key).alias("_key"), F.struct(key, order, *value_columns).alias("_old"))
    met = newest.join(old, F.col(key).eqNullSafe(F.col("_key")), "left").where(
        F.col("_old").isNull() | (F.col(order) >= F.col(f"_old.{order}")))
    new = F.struct(key, order, *value_columns)
    both = F.when(F.col("_old").isNull(), F.array(F.struct(new.alias("row"), F.lit(1).alias("sign")))).otherwise(
        F.array(F.struct(new.alias("row"), F.lit(1).alias("sign")), F.struct(F.col("_old").alias("row"), F.lit(-1).alias("sign"))))
    return met.select(F.inline(both)).select("row.*", F.col("sign").alias("_sign"))


def merged_state(state: DataFrame | None, changes: DataFrame, key: str) -> DataFrame:
    """The current rows after a batch."""
    new = changes.where("_sign = 1").drop("_sign")
    if state is None:
        return new
    return state.join(new.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(new)


def merged_sums(stored: DataFrame | None, changes: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """`keys`, `rows`, and the sums: the stored mart plus what the changed rows add and take away.

    Only changed rows are read beside the mart. A group without rows goes; a sum over nulls alone is 0. Sums must be
    of exact types (whole numbers or decimals), else taking away leaves traces.
    """
    signed = changes.groupBy(*keys).agg(F.sum(F.col("_sign").cast("long")).alias("rows"), *[
        F.sum(F.coalesce(F.col(c), F.lit(0).cast(changes.schema[c].dataType)) * F.col("_sign")).alias(c) for c in sums])
    every = signed if stored is None else stored.unionByName(signed)
    return every.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(c).alias(c) for c in sums]).where("rows <> 0")
