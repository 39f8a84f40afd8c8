"""Checks that keep plans safe at scale: bounded broadcasts and splitting of hot keys."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.session import work_dir

# A dimension above this is joined by shuffle, where AQE splits skewed partitions.
BROADCAST_ROWS = 200_000

# A key with more rows than this is cut into ranges of its order before it is sorted.
ROWS_PER_CHUNK = 2_000_000

# Ranges per ROWS_PER_CHUNK rows: their borders come from a sample, so they are not of one size.
OVERSPLIT = 2


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when `df` has at most `max_rows` rows. The limit stops the count early."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its size is proven small, else `df` as it is (shuffle join)."""
    return F.broadcast(df) if fits(df, max_rows) else df


def settled(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared checkpoint folder, for small results used several times."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_dir(df.sparkSession, "checkpoint"))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once and kept as a compressed table in the shared folder, for large results used several times."""
    path = work_dir(df.sparkSession, "kept")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rows_per_chunk: int = ROWS_PER_CHUNK,
              collapse: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most `rows_per_chunk` rows (`_chunk` 0), and those of hot keys in chunks (None: no hot key).

    `_chunk` never decreases along `order` within a key. Hot rows are dealt by ranges of key and order whose borders come
    from a sample of these rows, so bursts and any orderable type are cut evenly; rows that are equal in `order` share a
    chunk. `collapse` may reduce such ties before. The dealt rows are written once, so the chunks stay as they are. Hot
    keys are found by one hash aggregate over the keys; there are at most rows / `rows_per_chunk` of them.
    """
    hot = settled(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_chunk))
    total = hot.agg(F.sum("_n")).first()[0]
    if total is None:
        return df.withColumn("_chunk", F.lit(0)), None
    names = small_side(hot.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]))
    same = reduce(and_, [df[k].eqNullSafe(names[f"_k{i}"]) for i, k in enumerate(keys)])
    ranges = -(-total * OVERSPLIT // rows_per_chunk)
    dealt = collapse(df.join(names, same, "left_semi")).repartitionByRange(ranges, *keys, *order)
    return (df.join(names, same, "left_anti").withColumn("_chunk", F.lit(0)),
            settled(dealt.withColumn("_chunk", F.spark_partition_id() + 1)))
