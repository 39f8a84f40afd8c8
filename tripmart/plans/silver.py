"""Silver: both ride feeds in one typed, pseudonymised table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.functions.columns import pseudonym
from tripmart.operators.joins import union_feeds
from tripmart.schemas import PII, RIDE, TIMESTAMPS
from tripmart.sources.messages import decode, parse, split_malformed

INGESTED_AT = "_ingested_at"


def conform(rides: DataFrame, ingested_at: Column | None = None, pepper: str = "",
            keep: Sequence[str] = ()) -> DataFrame:
    """Type the three timestamps, hash the seven personal columns; one map-only projection. `keep`: further columns.

    A timestamp text that cannot be read becomes null and the row stays (`unreadable_times` counts them).
    """
    def column(name: str) -> Column:
        if name in TIMESTAMPS:
            return F.col(name).try_cast("timestamp").alias(name)
        if name in PII:
            return pseudonym(F.col(name), pepper).alias(name)
        return F.col(name)

    if ingested_at is None:
        ingested_at = F.col(INGESTED_AT) if INGESTED_AT in rides.columns else F.lit(None).cast("timestamp")
    return rides.select(*[column(f.name) for f in RIDE.fields], ingested_at.cast("timestamp").alias(INGESTED_AT), *keep)


def unreadable_times(rides: DataFrame) -> DataFrame:
    """How many timestamp texts of raw rides cannot be read: `column_name`, `row_count`; one pass."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("timestamp").isNull()).alias(c) for c in TIMESTAMPS]
    return rides.agg(*bad).unpivot([], list(TIMESTAMPS), "column_name", "row_count")


def split_unidentified(rides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rides with an id, rides without): the latter cannot be facts and belong in quarantine."""
    return rides.where(F.col("ride_id").isNotNull()), rides.where(F.col("ride_id").isNull())


def from_messages(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ride rows, quarantined messages) of a live feed; the message time counts as ingestion time."""
    parsed = parse(decode(envelopes), RIDE)
    good, bad = split_malformed(parsed)
    return good.withColumn(INGESTED_AT, F.col("timestamp")), bad.select(*envelopes.columns, "records")


def unite(live: DataFrame, historical: DataFrame, pepper: str = "") -> DataFrame:
    """Silver rides of both feeds, batch or stream."""
    return union_feeds(conform(live, pepper=pepper), conform(historical, pepper=pepper))
