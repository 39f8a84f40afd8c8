"""Queries: bucketed tables of the catalog, points in areas, corrections of closed hours."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tripmart.operators.joins import Dim, star_join
from tripmart.plans import audits
from tripmart.plans.tables import save_bucketed, upsert_bucketed
from tripmart.session import work_dir
from tripmart.streaming import corrections, rides as live
from tripmart.streaming.runs import append_to, start
from tripmart.workload import inputs
from tripmart.workload.inputs import table
from tripmart.workload.registry import query
from tripmart.workload.sql import FACT_CTE, with_
from tripmart.workload.star import _NEWEST_LINES, LINE_KEYS
from tripmart.workload.streams import _events_in_files, _stream

BUCKETS = 16


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex[:12]}"


@query(_NEWEST_LINES)
def bucketed_upsert(spark, sf_dir):
    """Newest line items in a bucketed table, loaded in three parts: middle, newest, oldest."""
    lines = table(spark, sf_dir, "lineitem")
    newer, older = (F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz"),
                    F.col("l_shipdate") < F.lit("1994-01-01").cast("timestamp_ntz"))
    name = _name("lines")
    for part in (lines.where(~newer & ~older), lines.where(newer), lines.where(older)):
        out = upsert_bucketed(part, name, LINE_KEYS, "l_shipdate", BUCKETS, work_dir(spark, "bucketed_lines"))
    return out


@query(with_(FACT_CTE, """booker AS (SELECT booker_id, booker_name FROM silver
    QUALIFY row_number() OVER (PARTITION BY booker_id ORDER BY booking_timestamp DESC NULLS LAST, booker_name DESC NULLS LAST,
                               booker_email DESC NULLS LAST, booker_phone DESC NULLS LAST) = 1)""")
       + "SELECT ride_id, f.booker_id, total_fare, booker_name FROM fact f LEFT JOIN booker b ON f.booker_id = b.booker_id")
def bucketed_star(spark, sf_dir):
    """Rides with their bookers from a bucketed dimension, which stays in its buckets."""
    name = _name("dim_booker")
    save_bucketed(inputs.dim(spark, sf_dir, "dim_booker"), name, "booker_id", BUCKETS, work_dir(spark, "bucketed_booker"))
    fact = inputs.fact(spark, sf_dir).select("ride_id", "booker_id", "total_fare")
    return star_join(fact, [Dim(spark.table(name), "booker_id", "booker_id", ["booker_name"])]).select(
        "ride_id", "booker_id", "total_fare", "booker_name")


_AREAS = """areas AS (SELECT 'TH-' || (10 + s_suppkey % 81) AS province_id,
    min(13.0::DOUBLE + CAST(s_suppkey % 50 AS DOUBLE) / 10.0::DOUBLE) - CAST(max(s_nationkey) AS DOUBLE) / 16.0::DOUBLE AS min_lat,
    min(100.0::DOUBLE + CAST(s_suppkey % 7 AS DOUBLE) / 10.0::DOUBLE) - CAST(min(s_nationkey) AS DOUBLE) / 32.0::DOUBLE AS min_lon,
    max(13.0::DOUBLE + CAST(s_suppkey % 50 AS DOUBLE) / 10.0::DOUBLE) + CAST(min(s_nationkey) AS DOUBLE) / 64.0::DOUBLE AS max_lat,
    max(100.0::DOUBLE + CAST(s_suppkey % 7 AS DOUBLE) / 10.0::DOUBLE) + CAST(max(s_nationkey) AS DOUBLE) / 8.0::DOUBLE AS max_lon
    FROM supplier WHERE s_suppkey % 4 <> 1 GROUP BY 1)"""


@query(with_(FACT_CTE, _AREAS, """outsiders AS (SELECT ride_id, pickup_city_id, pickup_latitude, pickup_longitude FROM fact f
      LEFT JOIN areas a ON a.province_id = f.pickup_city_id
      WHERE NOT coalesce(pickup_latitude BETWEEN min_lat AND max_lat AND pickup_longitude BETWEEN min_lon AND max_lon, FALSE))""")
    + """SELECT ride_id, any_value(pickup_city_id) AS pickup_city_id, any_value(pickup_latitude) AS pickup_latitude,
      any_value(pickup_longitude) AS pickup_longitude, string_agg(province_id, ',' ORDER BY province_id) AS found_in
    FROM outsiders LEFT JOIN areas ON pickup_latitude BETWEEN min_lat AND max_lat AND pickup_longitude BETWEEN min_lon AND max_lon
    GROUP BY ride_id""")
def outside_area(spark, sf_dir):
    """Rides picked up outside their province, whose box is drawn around three quarters of its suppliers."""
    supp, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("double")
    lat, lon = F.lit(13.0) + (supp % 50) / 10.0, F.lit(100.0) + (supp % 7) / 10.0
    areas = (table(spark, sf_dir, "supplier").where(supp % 4 != 1)
             .groupBy(F.concat(F.lit("TH-"), (F.lit(10) + supp % 81).cast("string")).alias("province_id"))
             .agg((F.min(lat) - F.max(nation) / 16.0).alias("min_lat"), (F.min(lon) - F.min(nation) / 32.0).alias("min_lon"),
                  (F.max(lat) + F.min(nation) / 64.0).alias("max_lat"), (F.max(lon) + F.max(nation) / 8.0).alias("max_lon")))
    found = audits.outside_area(inputs.fact(spark, sf_dir), areas)
    names = F.when(F.size("found_in") > 0, F.concat_ws(",", "found_in"))
    return found.withColumn("found_in", names)


@query("""SELECT date_trunc('hour', ts) AS hour_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hour_end, event_type,
    count(*) AS rides, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM events
    GROUP BY 1, 2, 3 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR
      <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 24 HOUR FROM events)""")
def hourly_corrected(spark, sf_dir):
    """Hours closed by a stream of four batches in no order of time, with the rows that came too late booked behind."""
    schema = table(spark, sf_dir, "events").schema
    path, out = _events_in_files(spark, sf_dir, 4), work_dir(spark, "hourly_corrected")
    timed = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    writer = append_to(live.hourly_live(timed(_stream(spark, path, schema, 1)), "ts", "event_type", "value"), out)
    run = start(writer, work_dir(spark, "hourly_corrected_checkpoint"))
    run.awaitTermination()
    report = spark.read.parquet(out)
    late = corrections.late_rows(timed(spark.read.parquet(path)), report, "ts", ["event_type"], "value",
                                 corrections.closed_until(run))
    return corrections.corrected(report, late, ["event_type"])
