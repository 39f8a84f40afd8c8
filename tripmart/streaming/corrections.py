"""Rows that came behind the watermark, booked as corrections of the windows that a stream had already closed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MONEY = "decimal(28,2)"


def closed_until(query: StreamingQuery) -> datetime | None:
    """The watermark that a query has reached, in UTC without a zone: windows that end by then are closed."""
    marks = [p.eventTime.get("watermark") for p in query.recentProgress if p.eventTime]
    stamps = [datetime.strptime(m, "%Y-%m-%dT%H:%M:%S.%fZ") for m in marks if m]
    return max(stamps, default=None)


def hourly(rows: DataFrame, at: str, by: Sequence[str], value: str, until: datetime) -> DataFrame:
    """The batch report of hours that end by `until`. Rows without a time belong to no hour."""
    hour = F.date_trunc("hour", F.col(at))
    return (rows.select(hour.alias("hour_start"), *by, F.col(value).cast(MONEY).alias("_v")).where("hour_start IS NOT NULL")
            .withColumn("hour_end", F.col("hour_start") + F.expr("INTERVAL 1 HOUR"))
            .where(F.col("hour_end") <= F.lit(until.isoformat(" ")).cast("timestamp"))
            .groupBy("hour_start", "hour_end", *by).agg(F.count("*").alias("rides"), F.sum("_v").alias("amount")))


def late_rows(landed: DataFrame, booked: DataFrame, at: str, by: Sequence[str], value: str, until: datetime) -> DataFrame:
    """What `booked` (the stream's closed windows and earlier corrections) lacks of `landed`, per window.

    Counts and amounts of the landed rows minus the booked ones, for windows in which any are missing. Two aggregates over
    windows meet, never rows; each landed row is reduced where it lies. Booking the result and asking again gives nothing.
    """
    keys = ["hour_start", "hour_end", *by]
    true = hourly(landed, at, by, value, until).select(*keys, "rides", "amount")
    had = booked.select(*keys, (-F.col("rides")).alias("rides"), (-F.col("amount").cast(MONEY)).alias("amount"))
    missing = true.unionByName(had).groupBy(*keys).agg(F.sum("rides").alias("rides"), F.sum("amount").alias("amount"))
    return (missing.where("rides <> 0 OR amount <> 0")
            .select(*keys, "rides", F.col("amount").cast("double").alias("amount")))


def corrected(report: DataFrame, corrections: DataFrame, by: Sequence[str]) -> DataFrame:
    """The report with its corrections booked: one row per window."""
    both = report.unionByName(corrections).withColumn("amount", F.col("amount").cast(MONEY))
    return (both.groupBy("hour_start", "hour_end", *by)
            .agg(F.sum("rides").alias("rides"), F.sum("amount").cast("double").alias("amount")))
