"""One row per key: newest (SCD 1, snapshots) or first seen.

`row_number() = 1` plans a group limit on the map side, so each task sends at most one row per key to the
shuffle; a key that holds a third of all rows is reduced before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def total_order(df: DataFrame, keys: Sequence[str], sequence: Sequence[str],
                tiebreak: Sequence[str] | None = None) -> list[str]:
    """Sequence columns, then the tie-break; by default every other column, so that the choice is unique."""
    rest = [c for c in df.columns if c not in keys and c not in sequence] if tiebreak is None else tiebreak
    return [*sequence, *rest]


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def latest(df: DataFrame, keys: str | Sequence[str], sequence: str | Sequence[str],
           tiebreak: Sequence[str] | None = None) -> DataFrame:
    """SCD 1: the row with the highest sequence per key; a null sequence is lowest."""
    keys, sequence = _as_list(keys), _as_list(sequence)
    order = [F.col(f"`{c}`").desc_nulls_last() for c in total_order(df, keys, sequence, tiebreak)]
    return _one_per_key(df, keys, order)


def first_seen(df: DataFrame, keys: str | Sequence[str], sequence: str | Sequence[str],
               tiebreak: Sequence[str] | None = None) -> DataFrame:
    """The row with the lowest sequence per key; a null sequence is highest."""
    keys, sequence = _as_list(keys), _as_list(sequence)
    order = [F.col(f"`{c}`").asc_nulls_last() for c in total_order(df, keys, sequence, tiebreak)]
    return _one_per_key(df, keys, order)


def upsert(current: DataFrame | None, arriving: DataFrame, keys: str | Sequence[str],
           sequence: str | Sequence[str], tiebreak: Sequence[str] | None = None) -> DataFrame:
    """SCD 1 state after `arriving`: a stale row loses to what is stored, whatever order rows come in."""
    both = arriving if current is None else current.unionByName(arriving, allowMissingColumns=True)
    return latest(both, keys, sequence, tiebreak)
