"""Queries: exact quantiles, mergeable distinct counts, marts by deltas, offset intervals, table comparison, fit of shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmart.operators.deltas import changed_rows, merged_state, merged_sums
from tripmart.operators.distinct import bitmaps, count_distinct, numbered
from tripmart.operators.offsets import landed_intervals, repeated_offsets
from tripmart.operators.quantiles import exact_quantiles
from tripmart.operators.reconcile import compare_tables
from tripmart.operators.sizing import kept, settled
from tripmart.plans import audits
from tripmart.workload import inputs
from tripmart.workload.inputs import table
from tripmart.workload.registry import query
from tripmart.workload.sql import FACT_CTE, with_

MEASURES, FRACTIONS = ["total_fare", "duration_minutes", "travel_distance_km"], [0.05, 0.5, 0.95]


@query(with_(FACT_CTE, "long AS (" + " UNION ALL ".join(
    f"SELECT ride_option_id, '{m}' AS measure, CAST({m} AS DOUBLE) AS v FROM fact WHERE ride_status_id = 1" for m in MEASURES) + ")")
    + " UNION ALL ".join(f"""SELECT ride_option_id, measure, CAST({f} AS DOUBLE) AS fraction, count(v) AS n,
        quantile_disc(v, {f}) AS value FROM long WHERE v IS NOT NULL GROUP BY 1, 2""" for f in FRACTIONS))
def service_quantiles(spark, sf_dir):
    """Fares, minutes and distances per ride option, exact at any size."""
    done = kept(inputs.fact(spark, sf_dir).where("ride_status_id = 1").select("ride_option_id", *MEASURES))
    return exact_quantiles(done, ["ride_option_id"], MEASURES, FRACTIONS)


@query(with_(FACT_CTE, "days AS (SELECT DISTINCT booking_date FROM fact)") + """
    SELECT 'day' AS span, booking_date AS last_day, count(DISTINCT booker_id) AS active_bookers FROM fact GROUP BY 2
    UNION ALL SELECT 'week', d.booking_date, count(DISTINCT booker_id) FROM days d JOIN fact f
      ON f.booking_date BETWEEN d.booking_date - 6 AND d.booking_date GROUP BY 2
    UNION ALL SELECT 'month', CAST(last_day(booking_date) AS DATE), count(DISTINCT booker_id) FROM fact GROUP BY 2""")
def active_bookers(spark, sf_dir):
    """Days, the seven days up to each day, and months, all from the same daily bitmaps."""
    fact = kept(inputs.fact(spark, sf_dir).select("booking_date", "booker_id"))
    daily = settled(bitmaps(fact, ["booking_date"], numbered(fact, "booker_id"), "booker_id"))
    days = daily.select(F.col("booking_date").alias("last_day")).distinct()
    weeks = daily.withColumn("last_day", F.explode(F.sequence("booking_date", F.date_add("booking_date", 6)))).join(
        days, "last_day", "left_semi")
    spans = {"day": daily.withColumn("last_day", F.col("booking_date")), "week": weeks,
             "month": daily.withColumn("last_day", F.last_day("booking_date"))}
    out = None
    for span, maps in spans.items():
        counted = count_distinct(maps, ["last_day"]).select(
            F.lit(span).alias("span"), "last_day", F.col("distinct").alias("active_bookers"))
        out = counted if out is None else out.unionByName(counted)
    return out


@query(with_(FACT_CTE, """final AS (SELECT *, CAST(total_fare AS DECIMAL(18,2))
      + CASE WHEN ride_option_id = 2 THEN CAST(5 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS fare,
      CASE WHEN payment_method_id = 3 THEN (booking_hour + 1) % 24 ELSE booking_hour END AS hour FROM fact)""") + """
    SELECT hour, ride_status_id, count(*) AS rides, CAST(sum(fare) AS DOUBLE) AS revenue FROM final GROUP BY 1, 2""")
def mart_by_deltas(spark, sf_dir):
    """Hourly revenue after three batches: all rides, corrected hours of some, corrected fares of some, a stale repeat."""
    fact = kept(inputs.fact(spark, sf_dir).select(
        "ride_id", F.lit(0).alias("version"), F.col("booking_hour").alias("hour"), "ride_status_id", "ride_option_id",
        "payment_method_id", F.col("total_fare").cast("decimal(18,2)").alias("fare")))
    moved = fact.where("payment_method_id = 3").withColumn("hour", (F.col("hour") + 1) % 24)
    dearer = lambda df: df.withColumn("fare", F.when(F.col("ride_option_id") == 2, F.col("fare") + 5).otherwise(
        F.col("fare")).cast("decimal(18,2)"))
    third = dearer(moved.unionByName(fact.where("payment_method_id <> 3"))).where("ride_option_id = 2")
    stale = fact.where("payment_method_id = 3")
    batches = [fact, moved.withColumn("version", F.lit(1)), third.withColumn("version", F.lit(2)).unionByName(stale)]
    columns, state, mart = ["hour", "ride_status_id", "ride_option_id", "payment_method_id", "fare"], None, None
    for batch in batches:
        changes = settled(changed_rows(state, batch, "ride_id", "version", columns))
        mart = settled(merged_sums(mart, changes, ["hour", "ride_status_id"], ["fare"]))
        state = settled(merged_state(state, changes, "ride_id"))
    return mart.select("hour", "ride_status_id", F.col("rows").alias("rides"), F.col("fare").cast("double").alias("revenue"))


_MESSAGES = """messages AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS part, event_id // 3 AS pos FROM events)"""


def _messages(spark, sf_dir):
    """Events as messages of four partitions per topic; numbers between are lost, some come again."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("part"),
        F.floor(F.col("event_id") / 3).alias("at"))


@query(with_(_MESSAGES, """each AS (SELECT topic, part, pos, count(*) AS n FROM messages WHERE pos IS NOT NULL GROUP BY ALL)""",
             """runs AS (SELECT *, pos - row_number() OVER (PARTITION BY topic, part ORDER BY pos) AS run FROM each)""",
             """islands AS (SELECT topic, part, min(pos) AS "first", max(pos) AS "last", CAST(sum(n) AS BIGINT) AS messages
                FROM runs GROUP BY topic, part, run)""") + """
    SELECT *, lead("first") OVER (PARTITION BY topic, part ORDER BY "first") - "last" - 1 AS missing_after FROM islands""")
def offset_intervals(spark, sf_dir):
    return landed_intervals(_messages(spark, sf_dir), ["topic", "part"], "at", block=1000)


@query(with_(_MESSAGES) + """SELECT topic, part, pos AS "offset", count(*) AS copies FROM messages WHERE pos IS NOT NULL
    GROUP BY ALL HAVING count(*) > 1""")
def offset_copies(spark, sf_dir):
    return repeated_offsets(_messages(spark, sf_dir), ["topic", "part"], "at")


_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]


@query("""SELECT l_orderkey, l_linenumber, CAST(row_number() OVER k AS INTEGER) AS copy,
      CASE WHEN l_orderkey % 97 = 1 THEN 'missing' ELSE 'changed' END AS kind
    FROM lineitem WHERE l_orderkey % 97 = 1 OR l_orderkey % 89 = 2 WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)
    UNION ALL SELECT -l_orderkey, l_linenumber, CAST(row_number() OVER k AS INTEGER), 'extra' FROM lineitem WHERE l_orderkey % 101 = 3
    WINDOW k AS (PARTITION BY l_orderkey, l_linenumber)""")
def table_comparison(spark, sf_dir):
    """Line items against a copy that has lost, changed and gained rows."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS)
    changed = F.when(F.col("l_orderkey") % 89 == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    other = lines.where("l_orderkey % 97 <> 1").withColumn("l_quantity", changed).unionByName(
        lines.where("l_orderkey % 101 = 3").withColumn("l_orderkey", -F.col("l_orderkey")))
    return compare_tables(lines, other, ["l_orderkey", "l_linenumber"], _LINE_COLUMNS).select(
        "l_orderkey", "l_linenumber", "copy", "kind")


@query(with_(FACT_CTE, """tests AS (
      SELECT date_trunc('month', booking_date) AS m, 'completed' AS share, ride_status_id = 1 AS hit, 0.8 AS expected FROM fact
      UNION ALL SELECT date_trunc('month', booking_date), 'same_province', pickup_city_id = dropoff_city_id, 0.7 FROM fact
      UNION ALL SELECT date_trunc('month', booking_date), 'tipped', tip_amount > 0, 0.2 FROM fact WHERE ride_status_id = 1)""",
             """counts AS (SELECT m, share, count(*) FILTER (hit IS NOT NULL) AS n, count(*) FILTER (hit) AS hits,
                CAST(any_value(expected) AS DOUBLE) AS p FROM tests GROUP BY 1, 2)""") + """
    SELECT CAST(m AS DATE) AS month, share, n, hits, p AS expected_share,
      round((hits - n * p) * (hits - n * p) / (n * p) + (hits - n * p) * (hits - n * p) / (n * (1 - p)), 6) AS chi_square,
      CAST(1 AS INTEGER) AS degrees FROM counts WHERE n > 0""")
def share_fit(spark, sf_dir):
    return audits.share_fit(inputs.fact(spark, sf_dir)).withColumn("chi_square", F.round("chi_square", 6))
