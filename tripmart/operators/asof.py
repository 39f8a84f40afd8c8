"""As-of join: each row meets the version of its key that was valid at the row's time.

Two plans, chosen by a checked size of the version table:

* small, with few versions per key: broadcast, equi key plus validity range; the rows are not shuffled at all;
* large: rows and versions are put in one ordered line per key and the last version seen is carried forward.
  That is one shuffle and one sort and never pairs the rows of a key with the versions of a key. The lines of hot
  keys are cut into ranges of about equal size; each starts with the version carried over from the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tripmart.operators.history import END, START
from tripmart.operators.latest import _as_list
from tripmart.operators.sizing import (
    BROADCAST_ROWS, ROWS_PER_CHUNK, in_chunks,
)

EARLIEST, NULL = "earliest", "null"

# A row is compared with every version of its key in the broadcast plan, so this bounds its work per row.
VERSIONS_PER_KEY = 500


def asof_join(rows: DataFrame, versions: DataFrame, keys: str | Sequence[str], at: str,
              columns: Sequence[str], start: str = START, end: str = END,
              before_first: str = EARLIEST, broadcast_rows: int = BROADCAST_ROWS,
              rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Left join: `rows` plus `columns` of the version with start <= at < end.

    `before_first` decides for rows older than the first version of their key: its earliest version, or null.
    A null `start` is from the beginning, a null `end` is open; a row without time meets no version. Times of
    different types are compared in their common type (a date is its midnight). Versions of one key must not overlap.
    Both plans give the same rows. The size check reads `versions` once, so pass a written table rather than a long
    computation; `broadcast_rows=0` skips the check and carries.
    """
    if before_first not in (EARLIEST, NULL):
        raise ValueError(f"before_first must be {EARLIEST!r} or {NULL!r}, got {before_first!r}")
    keys = _as_list(keys)
    bounds = [c for c in (start, end) if c not in columns]
    needed = versions.select(*keys, *columns, *bounds)
    kind = _common_type(rows.schema[at].dataType, needed.schema[start].dataType, needed.schema[end].dataType, rows)
    if broadcast_rows and _small(needed, keys, broadcast_rows):
        return _by_broadcast(rows, needed, keys, at, columns, start, end, before_first, kind)
    return _by_carrying(rows, needed, keys, at, columns, start, end, before_first, rows_per_chunk, kind)


def _common_type(at: DataType, start: DataType, end: DataType, df: DataFrame) -> DataType:
    """The type in which all three can be compared, by Spark's own widening rules."""
    values = [F.lit(None).cast(t) for t in (at, start, end)]
    return df.sparkSession.range(0).select(F.greatest(*values).alias("t")).schema["t"].dataType


def _small(versions: DataFrame, keys: Sequence[str], most: int) -> bool:
    """Few enough versions in all and per key, by one aggregate."""
    per_key = versions.groupBy(*keys).agg(F.count("*").alias("n"))
    total, largest = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return total <= most and largest <= VERSIONS_PER_KEY


def _by_broadcast(rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str,
                  columns: Sequence[str], start: str, end: str, before_first: str, kind: DataType) -> DataFrame:
    since = F.col(start).cast(kind)
    if before_first == EARLIEST:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first()))
        since = F.when(place > 1, since)
    sided = versions.select(*keys, *[F.col(c).alias(f"_v_{c}") for c in columns],
                            since.alias("_since"), F.col(end).cast(kind).alias("_until"))
    r, v = rows.alias("r"), F.broadcast(sided).alias("v")
    time = F.col(f"r.`{at}`").cast(kind)
    cond = (F.col("v._since").isNull() | (time >= F.col("v._since"))) & time.isNotNull() & (
        F.col("v._until").isNull() | (time < F.col("v._until")))
    for k in keys:
        cond = (F.col(f"r.`{k}`") == F.col(f"v.`{k}`")) & cond
    return r.join(v, cond, "left").select(
        *[F.col(f"r.`{c}`") for c in rows.columns], *[F.col(f"v.`_v_{c}`").alias(c) for c in columns])


def _by_carrying(rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str,
                 columns: Sequence[str], start: str, end: str, before_first: str,
                 rows_per_chunk: int, kind: DataType) -> DataFrame:
    """One line per key: side 0 is the earliest version (if wanted), 1 a version, 2 a row."""
    row, version = F.struct(*rows.columns), F.struct(*versions.columns)
    row_type = rows.select(row.alias("_row")).schema["_row"].dataType
    version_type = versions.select(version.alias("_version")).schema["_version"].dataType

    def line(df: DataFrame, time: Column, side: int, r: Column, v: Column) -> DataFrame:
        return df.select(*keys, time.cast(kind).alias("_at"), F.lit(side).alias("_side"),
                         r.alias("_row"), v.alias("_version"))

    no_row, no_version = F.lit(None).cast(row_type), F.lit(None).cast(version_type)
    versions = versions.dropna(subset=list(keys))  # as in any join, a null key meets nothing
    marks = line(versions, F.col(start), 1, no_row, version)
    if before_first == EARLIEST:
        oldest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(start).asc_nulls_first()))
        earliest = versions.withColumn("_place", oldest).where("_place = 1")
        marks = marks.unionByName(line(earliest, F.lit(None), 0, no_row, version))

    # Of equal times versions come first, so rows of one time can be cut anywhere: a number of each row does that.
    lines = line(rows, F.col(f"`{at}`"), 2, row, no_version).unionByName(marks).withColumn(
        "_cut", F.when(F.col("_side") == 2, F.rand(3)))
    order = [F.col("_at").asc_nulls_first(), F.col("_side"), F.col("_cut").asc_nulls_first()]
    lines, hot = in_chunks(lines, keys, order, rows_per_chunk)
    if hot is not None:
        lines = lines.unionByName(hot).unionByName(_carried_over(hot, keys))

    window = (Window.partitionBy(*keys, "_chunk")
              .orderBy(F.col("_at").asc_nulls_first(), "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = F.last("_version", ignorenulls=True).over(window)
    valid = F.col("_found").isNotNull() & F.col("_at").isNotNull() & (
        (F.col("_at") < F.col(f"_found.`{end}`").cast(kind)) | F.col(f"_found.`{end}`").isNull())
    return (
        lines
        .withColumn("_found", found)
        .where("_side = 2")
        .select("_row.*", *[F.when(valid, F.col(f"_found.`{c}`")).alias(c) for c in columns])
    )


def _carried_over(hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version before each chunk: a row per chunk of a hot key, at its beginning."""
    version = F.when(F.col("_version").isNotNull(), F.struct("_at", "_side", "_version"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (hot.groupBy(*keys, "_chunk").agg(F.max(version).alias("_newest"))
               .withColumn("_newest", F.last("_newest", ignorenulls=True).over(before))
               .where(F.col("_newest").isNotNull()))
    given = {"_at": F.lit(None), "_side": F.lit(0), "_row": F.lit(None), "_version": F.col("_newest._version"),
             "_cut": F.lit(None)}
    return carried.select(*[given.get(c, F.col(f"`{c}`")).cast(hot.schema[c].dataType).alias(c) for c in hot.columns])
