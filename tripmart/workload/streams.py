"""Queries: the streaming jobs, run until all input is taken."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tripmart.schemas import ENVELOPE, REFERENCE, RIDE, SCD1_DIMS, SCD2_DIMS, STATIC_DIMS
from tripmart.session import work_dir
from tripmart.sources import files, messages
from tripmart.streaming import keyed, refresh, rides as live
from tripmart.streaming.runs import append_to, start
from tripmart.workload import inputs
from tripmart.workload.inputs import table
from tripmart.workload.registry import query
from tripmart.workload.sql import (
    FACT_CTE, METHODS, OPTION_COLUMNS, OPTIONS, PROVINCE_LOG, REASONS, RIDES, SILVER, STATUSES, newest, versions, with_,
)
from tripmart.workload.star import _EVENT_VERSIONS


def _events_in_files(spark, sf_dir, files: int):
    """The events as a folder of files, so that a stream takes several batches, in no order of time."""
    path = work_dir(spark, "stream_events")
    table(spark, sf_dir, "events").repartition(files, "event_id").write.parquet(path)
    return path


def _stream(spark, path, schema, per_trigger=None):
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_scd1(spark, sf_dir):
    """Newest event per user, kept by three batches out of order."""
    path, target = _events_in_files(spark, sf_dir, 3), work_dir(spark, "stream_scd1")
    events = _stream(spark, path, table(spark, sf_dir, "events").schema, 1)
    writer = keyed.upsert_stream(events, target, "user_id", "ts")
    start(writer, work_dir(spark, "stream_scd1_checkpoint")).awaitTermination()
    return keyed.read_upserted(spark, target, "user_id", "ts")


@query(with_(_EVENT_VERSIONS) + "SELECT * FROM v")
def stream_scd2(spark, sf_dir):
    """History of event types per user, kept by two batches out of order."""
    path, target = _events_in_files(spark, sf_dir, 2), work_dir(spark, "stream_scd2")
    events = _stream(spark, path, table(spark, sf_dir, "events").schema, 1)
    writer = keyed.history_stream(events, target)
    start(writer, work_dir(spark, "stream_scd2_checkpoint")).awaitTermination()
    return keyed.read_history(spark, target, "user_id", "ts", ["event_type"])


@query("""SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, event_type,
    count(*) AS rides, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events
    GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
      <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events)""")
def stream_hourly(spark, sf_dir):
    """Hours that the watermark, a day behind the newest event, has closed."""
    events = (_stream(spark, _events_in_files(spark, sf_dir, 2), table(spark, sf_dir, "events").schema)
              .withColumn("ts", F.col("ts").cast("timestamp")))
    out = work_dir(spark, "stream_hourly")
    writer = append_to(live.hourly_live(events, "ts", "event_type", "value"), out)
    start(writer, work_dir(spark, "stream_hourly_checkpoint")).awaitTermination()
    return spark.read.parquet(out)


#: Bytes of files of a feed that a micro-batch takes; they are deleted when it has been landed, so a feed and its landed copy never lie
#: on the disk whole at the same time.
FEED_BATCH = 256_000_000


def _land(spark, sf_dir, ours):
    """Messages of rides, and documents as malformed ones, landed by a stream."""
    sent, bronze = work_dir(spark, "live_sent"), work_dir(spark, "live_bronze")
    messages.to_messages(ours).unionByName(
        table(spark, sf_dir, "documents").select(
            *[(F.col("text").cast("binary") if f.name == "value" else F.lit(None).cast(f.dataType)).alias(f.name)
              for f in ENVELOPE.fields])).write.parquet(sent, compression="zstd")
    feed = messages.file_feed(spark, sent, max_bytes=FEED_BATCH, clean=True)
    start(live.land_messages(feed, bronze), work_dir(spark, "live_bronze_checkpoint")).awaitTermination()
    return bronze


@query(with_(RIDES) + """SELECT 'message' AS kind, count(*) AS n FROM rides
       UNION ALL SELECT 'text', count(*) FROM documents""")
def stream_bronze(spark, sf_dir):
    """Landed messages by kind."""
    landed = spark.read.parquet(_land(spark, sf_dir, inputs.rides(spark, sf_dir, inputs.BY_DRIVER)))
    kind = F.when(F.col("topic") == "rides", "message").otherwise("text")
    return landed.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query(with_(SILVER) + """SELECT * EXCLUDE (_ingested_at), NULL::VARCHAR AS text_hash FROM silver
       UNION ALL BY NAME SELECT sha256(text) AS text_hash FROM documents""")
def stream_silver(spark, sf_dir):
    """Live completed rides, historical cancelled ones and malformed messages through one silver stream."""
    historical, silver = work_dir(spark, "stream_historical"), work_dir(spark, "stream_silver")
    inputs.rides(spark, sf_dir).where("ride_status_id = 2").write.parquet(historical, compression="zstd")
    envelope = ENVELOPE
    completed = inputs.rides(spark, sf_dir).where("ride_status_id = 1")
    united = live.unite_feeds(_stream(spark, _land(spark, sf_dir, completed), envelope),
                              _stream(spark, historical, RIDE), dedup=False)
    start(live.write_silver(united, silver), work_dir(spark, "stream_silver_checkpoint")).awaitTermination()
    good = live.read_silver(spark, silver).drop("_ingested_at")
    bad = live.read_quarantine(spark, silver)
    return good.withColumn("text_hash", F.lit(None).cast("string")).unionByName(
        bad.select(F.sha2("records", 256).alias("text_hash")), allowMissingColumns=True)


_AT = [datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, tzinfo=timezone.utc)]
_STAMP = [f"TIMESTAMP '{at:%Y-%m-%d}'" for at in _AT]


def _reference_rows(spark, sf_dir, load: int):
    """The reference files of two days. On the second, provinces have other names, options and methods other values."""
    lines = table(spark, sf_dir, "lineitem").groupBy((F.lit(1) + F.col("l_partkey") % 6).cast("int").alias("ride_option_id")).agg(
        F.count("*").alias("_n"))
    orders = table(spark, sf_dir, "orders").groupBy((F.lit(1) + F.col("o_orderkey") % 5).cast("int").alias("payment_method_id")).agg(
        F.count("*").alias("_n"))
    options = inputs.ride_options(spark).join(lines, "ride_option_id")
    methods = spark.createDataFrame([(*m, True, None) for m in inputs.PAYMENT_METHODS], REFERENCE["map_payment_methods"]).join(
        orders, "payment_method_id")
    if load:
        options = options.withColumn("is_active", F.col("_n") % 2 == 0).withColumn("per_km", F.col("per_km") + F.col("_n"))
        methods = methods.withColumn("is_active", F.col("_n") % 2 == 0)
    name = F.max("province_name") if load else F.min("province_name")
    return {"map_provinces": inputs.provinces(spark, sf_dir).groupBy("province_id").agg(name.alias("province_name")),
            "map_payment_methods": methods, "map_ride_options": options,
            "map_ride_statuses": inputs.statuses(spark), "map_cancellation_reasons": inputs.reasons(spark)}


def _write_references(spark, sf_dir, load: int) -> str:
    """Each table as one JSON array, as the loader expects it; the largest has a row per province."""
    folder = work_dir(spark, "refresh_mapping")
    for name, rows in _reference_rows(spark, sf_dir, load).items():
        record = F.struct(*REFERENCE[name].fieldNames())
        rows.agg(F.to_json(F.collect_list(record)).alias("value")).write.text(f"{folder}/{name}.json")
    return folder


_METHOD_COLUMNS = REFERENCE["map_payment_methods"].fieldNames() + ["loaded_at"]
_VERSIONED = {
    "dim_ride_option": ("options", "ride_option_id", OPTION_COLUMNS, "1 + l_partkey % 6 AS k, count(*) AS n FROM lineitem"),
    "dim_payment_method": ("methods", "payment_method_id", _METHOD_COLUMNS, "1 + o_orderkey % 5 AS k, count(*) AS n FROM orders")}


def _two_loads(dim: str) -> str:
    rows, key, columns, counts = _VERSIONED[dim]
    shown = ", ".join({"loaded_at": "{at} AS loaded_at", "is_active": "{active} AS is_active", "per_km": "{rate} AS per_km",
                       "retired_at": "CAST(NULL AS VARCHAR) AS retired_at"}.get(c, c) for c in columns)
    first = shown.format(at=_STAMP[0], active="TRUE", rate="per_km")
    second = shown.format(at=_STAMP[1], active="n % 2 = 0", rate="per_km + n")
    changed = "TRUE" if "per_km" in columns else "n % 2 = 1"
    log = (f"{dim}_log AS (WITH c AS (SELECT {counts} GROUP BY 1) SELECT {first} FROM {rows} JOIN c ON k = {key} "
           f"UNION ALL SELECT {second} FROM {rows} JOIN c ON k = {key} WHERE {changed})")
    return log + "," + versions(dim, f"{dim}_log", [key], "loaded_at", SCD2_DIMS[dim][1], columns)


@query(with_(FACT_CTE, OPTIONS, METHODS, STATUSES, REASONS, PROVINCE_LOG, *map(_two_loads, _VERSIONED)) + f"""
    SELECT 'fact_rides' AS name, * FROM fact""" + "".join(f"""
    UNION ALL BY NAME SELECT '{name}' AS name, {', '.join(columns)}, booking_timestamp FROM (
      {newest('silver', columns[:1], ['booking_timestamp', *columns[1:]])})""" for name, columns in SCD1_DIMS.items()) + f"""
    UNION ALL BY NAME SELECT 'dim_province' AS name, province_id, max(province_name) AS province_name,
      CASE WHEN min(province_name) = max(province_name) THEN {_STAMP[0]} ELSE {_STAMP[1]} END AS loaded_at
      FROM province_log GROUP BY province_id
    UNION ALL BY NAME SELECT 'dim_ride_status' AS name, *, {_STAMP[0]} AS loaded_at FROM statuses
    UNION ALL BY NAME SELECT 'dim_cancellation_reason' AS name, *, {_STAMP[0]} AS loaded_at FROM reasons""" + "".join(f"""
    UNION ALL BY NAME SELECT '{name}' AS name, * FROM {name}""" for name in _VERSIONED))
def lakehouse_refresh(spark, sf_dir):
    """Completed rides as messages, cancelled ones as CSV files, reference files of two days, through all layers into gold.

    The second refresh takes only the changed reference rows. All rows of the fact and of the eight dimensions.
    """
    root, landing, sent = (work_dir(spark, f"refresh_{n}") for n in ("root", "landing", "sent"))
    raw = inputs.rides(spark, sf_dir)
    # A ride that repeats in both feeds must meet one load time, else the later feed would win.
    messages.to_messages(raw.where("ride_status_id = 1")).withColumn("timestamp", F.lit(_AT[0])).write.parquet(
        sent, compression="zstd")
    files.write_csv(raw.where("ride_status_id = 2"), landing, compression="gzip")
    for load, at in enumerate(_AT):
        mapping = _write_references(spark, sf_dir, load)
        refresh.refresh(spark, root, landing, mapping, at, messages.file_feed(spark, sent, max_bytes=FEED_BATCH, clean=True))
    out = None
    for name in ["fact_rides", *SCD1_DIMS, *STATIC_DIMS, *SCD2_DIMS]:
        rows = refresh.read_gold(spark, root, name).withColumn("name", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
