"""Live and historical rides into silver, and the live hourly report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tripmart.operators.joins import union_feeds
from tripmart.plans.silver import INGESTED_AT, conform
from tripmart.schemas import RIDE
from tripmart.sources.messages import decode, parse
from tripmart.streaming.runs import append_to, per_batch

# Fixed value: a live booking is up to 23 hours old when it is sent.
LIVE_LATENESS = "24 hours"


def land_messages(feed: DataFrame, path: str) -> DataStreamWriter:
    """Bronze: the envelopes with their text, unchanged."""
    return append_to(decode(feed), path)


def unite_feeds(live: DataFrame | None, historical: DataFrame | None = None, dedup: bool = False,
                lateness: str = LIVE_LATENESS, pepper: str = "") -> DataFrame:
    """One stream of silver rows plus `_malformed` and, for those, the message or the row as text.

    A live message that cannot be parsed, and any ride without an id, is malformed: nothing can be keyed by it.
        Keyed tables behind silver hold one row per key anyway, so copies of a message do no harm there. With `dedup`
    exact copies in the live feed are dropped before silver, with state bounded by `lateness`; this also drops live
    rides booked longer than that before the newest one, so it is off by default. It acts before the union: old
    historical files are no late data.
    """
    feeds = []
    if live is not None:
        parsed = parse(decode(live).select("records", F.col("timestamp").alias(INGESTED_AT)), RIDE)
        if dedup:
            # only here is the source read twice: rows without an id have no copies to find
            booked = F.col("booking_timestamp").try_cast("timestamp")
            good = (parsed.where(F.col("ride_id").isNotNull())
                    .withColumn("_event_time", F.coalesce(booked, INGESTED_AT))
                    .withColumn("_copy", F.sha2("records", 256))
                    .withWatermark("_event_time", lateness).dropDuplicatesWithinWatermark(["ride_id", "_copy"]))
            feeds += [flagged(good, F.col("records"), pepper),
                      flagged(parsed.where(F.col("ride_id").isNull()), F.col("records"), pepper)]
        else:
            feeds.append(flagged(parsed, F.col("records"), pepper))
    if historical is not None:
        feeds.append(flagged(historical, F.to_json(F.struct(*[c for c in RIDE.fieldNames() if c in historical.columns])),
                             pepper))
    return union_feeds(*feeds)


def flagged(rides: DataFrame, text: Column, pepper: str = "") -> DataFrame:
    """Silver rows with `_malformed` for those without an id, whose `records` keep what came in; map-only."""
    bad = F.col("ride_id").isNull()
    marked = rides.withColumn("records", F.when(bad, text)).withColumn("_malformed", bad)
    return conform(marked, pepper=pepper, keep=("records", "_malformed"))


def write_silver(united: DataFrame, path: str) -> DataStreamWriter:
    """Silver and quarantine in one pass, each batch in its own folder, so that a replay replaces it."""
    return per_batch(united, lambda batch, number: write_batch(batch, path, number))


def write_batch(batch: DataFrame, path: str, number: int) -> None:
    batch.write.mode("overwrite").partitionBy("_malformed").parquet(f"{path}/batch={number}", compression="zstd")


def silver_stream(spark: SparkSession, path: str) -> DataFrame:
    """Silver rows as a stream. A replayed batch may show rows twice; the keyed tables behind it do not mind."""
    table = T.StructType([*conform_schema(spark).fields, T.StructField("feed", T.StringType()),
                          T.StructField("batch", T.IntegerType()), T.StructField("_malformed", T.StringType())])
    return spark.readStream.schema(table).parquet(path).where("_malformed = 'false'").drop("feed", "batch", "_malformed")


def conform_schema(spark: SparkSession) -> T.StructType:
    return conform(spark.createDataFrame([], RIDE)).schema


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    columns = [*RIDE.fieldNames(), INGESTED_AT]
    return spark.read.parquet(path).where("_malformed = 'false'").select(*columns)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("_malformed = 'true'").select("records", INGESTED_AT)


def hourly_live(rides: DataFrame, at: str, by: str | None = None, value: str | None = None,
                lateness: str = LIVE_LATENESS) -> DataFrame:
    """Rides per hour window; an hour is final once the watermark has passed its end."""
    groups = [F.window(at, "1 hour")] + ([F.col(by)] if by else [])
    sums = [F.sum(F.col(value).cast("decimal(18,2)")).cast("double").alias("amount")] if value else []
    counted = rides.withWatermark(at, lateness).groupBy(*groups).agg(F.count("*").alias("rides"), *sums)
    kept = ([by] if by else []) + ["rides"] + (["amount"] if value else [])
    return counted.select(F.col("window.start").alias("hour_start"), F.col("window.end").alias("hour_end"), *kept)
