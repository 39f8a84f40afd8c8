"""Queries: upserts, histories, dimensions, the fact and their joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tripmart.functions.columns import calendar
from tripmart.operators.asof import asof_join
from tripmart.operators.history import history, rebuild_touched
from tripmart.operators.joins import Dim, star_join
from tripmart.operators.latest import first_seen, latest, upsert
from tripmart.plans import gold
from tripmart.workload import inputs
from tripmart.workload.inputs import table
from tripmart.workload.registry import query
from tripmart.workload.sql import (
    DIM_OPTION, DIM_PAYMENT, DIM_PROVINCE, FACT_CTE, REASONS, SILVER, STATUSES, newest, versions, with_,
)

LINE_KEYS = ["l_orderkey", "l_linenumber"]
_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
               "l_returnflag", "l_linestatus"]
_NEWEST_LINES = newest("lineitem", LINE_KEYS, _LINE_ORDER)


@query(_NEWEST_LINES)
def scd1_upsert(spark, sf_dir):
    return latest(table(spark, sf_dir, "lineitem"), LINE_KEYS, "l_shipdate")


@query(_NEWEST_LINES)
def scd1_two_batches(spark, sf_dir):
    """Newer rows first, older ones second: the stale batch must change nothing that is newer."""
    lines = table(spark, sf_dir, "lineitem")
    newer = F.col("l_shipdate") >= F.lit("1998-06-01").cast("timestamp_ntz")
    state = upsert(None, lines.where(newer), LINE_KEYS, "l_shipdate")
    return upsert(state, lines.where(~newer), LINE_KEYS, "l_shipdate")


@query(newest("events", ["user_id"], ["ts", "event_id"], direction="ASC"), "first_seen")
def first(spark, sf_dir):
    return first_seen(table(spark, sf_dir, "events"), "user_id", "ts")


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
_EVENT_VERSIONS = versions("v", "events", ["user_id"], "ts", ["event_type"], EVENT_COLUMNS, ["event_id"])


def _event_history(log):
    return history(log, "user_id", "ts", ["event_type"])


@query(with_(_EVENT_VERSIONS) + "SELECT * FROM v")
def scd2_history(spark, sf_dir):
    return _event_history(table(spark, sf_dir, "events"))


@query(with_(_EVENT_VERSIONS) + "SELECT * FROM v")
def scd2_late_arrivals(spark, sf_dir):
    """History of the second half of the month first; then the first half arrives late."""
    events = table(spark, sf_dir, "events")
    late = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    before = _event_history(events.where(~late))
    return rebuild_touched(before, events, events.where(late), "user_id", "ts", ["event_type"])


@query(with_(DIM_PROVINCE) + "SELECT * FROM dim_province")
def dim_static(spark, sf_dir):
    return gold.static_dim(inputs.provinces(spark, sf_dir), "dim_province")


def _person_sql(columns: list[str]) -> str:
    rest = ", ".join(columns)
    return with_(SILVER) + newest("silver", columns[:1], ["booking_timestamp", *columns[1:]],
                                  f"{rest}, booking_timestamp")


@query(_person_sql(["booker_id", "booker_name", "booker_email", "booker_phone"]))
def dim_booker(spark, sf_dir):
    return inputs.person_dim(spark, sf_dir, "dim_booker")


@query(_person_sql(["driver_id", "driver_name", "driver_phone", "driver_license"]))
def dim_driver(spark, sf_dir):
    return inputs.person_dim(spark, sf_dir, "dim_driver")


@query(_person_sql(["vehicle_id", "vehicle_license_plate"]))
def dim_vehicle(spark, sf_dir):
    return inputs.person_dim(spark, sf_dir, "dim_vehicle")


@query(with_(DIM_OPTION) + "SELECT * FROM dim_option")
def dim_ride_option(spark, sf_dir):
    return gold.versioned_dim(inputs.option_log(spark, sf_dir), "dim_ride_option")


@query(with_(DIM_PAYMENT) + "SELECT * FROM dim_payment")
def dim_payment_method(spark, sf_dir):
    return gold.versioned_dim(inputs.payment_log(spark, sf_dir), "dim_payment_method")


@query(with_(FACT_CTE) + "SELECT * FROM fact")
def fact_rides(spark, sf_dir):
    return inputs.fact(spark, sf_dir)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS booking_date, "
       "CAST(hour(o_orderdate) AS INTEGER) AS booking_hour FROM orders")
def fact_build(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                                 *calendar("o_orderdate"))


_ASOF_OPTION = """SELECT f.ride_id, f.ride_option_id, f.booking_timestamp, d.is_active, d.per_km
    FROM fact f ASOF LEFT JOIN dim_option d
    ON f.ride_option_id = d.ride_option_id AND f.booking_timestamp >= d.__START_AT"""


@query(with_(FACT_CTE, DIM_OPTION) + _ASOF_OPTION)
def asof_dim(spark, sf_dir):
    """Each ride with its option as valid at booking; the dimension is small, so the rides stay in place."""
    fact = inputs.fact(spark, sf_dir).select("ride_id", "ride_option_id", "booking_timestamp")
    dim = inputs.dim(spark, sf_dir, "dim_ride_option")
    return asof_join(fact, dim, "ride_option_id", "booking_timestamp", ["is_active", "per_km"], before_first="null")


_EVENT_ASOF = """SELECT e.event_id, e.user_id, e.ts, d.event_type AS version_type, d.__START_AT AS version_start
    FROM events e ASOF LEFT JOIN v d ON e.user_id = d.user_id AND e.ts >= d.__START_AT"""


@query(with_(_EVENT_VERSIONS) + _EVENT_ASOF)
def asof_history(spark, sf_dir):
    """Events against a history as large as themselves: carried forward, never paired."""
    events = table(spark, sf_dir, "events")
    dim = _event_history(events).select("user_id", F.col("event_type").alias("version_type"),
                                        F.col("__START_AT").alias("version_start"), "__START_AT", "__END_AT")
    return asof_join(events.select("event_id", "user_id", "ts"), dim, "user_id", "ts",
                     ["version_type", "version_start"], before_first="null", broadcast_rows=0)


_PURCHASES = versions("v", "(SELECT * FROM events WHERE event_type = 'purchase')", ["user_id"], "ts", ["value"],
                      ["event_id", "ts", "user_id", "value"], ["event_id"])


def _last_purchase(spark, sf_dir, before_first, **options):
    events = table(spark, sf_dir, "events")
    log = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    dim = history(log, "user_id", "ts", ["value"]).withColumnRenamed("value", "purchase_value")
    return asof_join(events.select("event_id", "user_id", "ts"), dim, "user_id", "ts", ["purchase_value"],
                     before_first=before_first, **options)


@query(with_(_PURCHASES) + """SELECT e.event_id, e.user_id, e.ts, d.value AS purchase_value
       FROM events e ASOF LEFT JOIN v d ON e.user_id = d.user_id AND e.ts >= d.__START_AT""")
def asof_before_first_null(spark, sf_dir):
    """Value of the user's last purchase; none before the first one."""
    return _last_purchase(spark, sf_dir, "null", broadcast_rows=0)


_EARLIEST = with_(_PURCHASES, "s AS (SELECT user_id, arg_min(value, ts) AS value FROM v_u GROUP BY user_id)") + """
    SELECT e.event_id, e.user_id, e.ts, coalesce(d.value, s.value) AS purchase_value
    FROM events e ASOF LEFT JOIN v d ON e.user_id = d.user_id AND e.ts >= d.__START_AT
    LEFT JOIN s ON e.user_id = s.user_id"""


@query(_EARLIEST)
def asof_before_first_earliest(spark, sf_dir):
    return _last_purchase(spark, sf_dir, "earliest", broadcast_rows=0)


@query(_EARLIEST)
def asof_earliest_broadcast(spark, sf_dir):
    return _last_purchase(spark, sf_dir, "earliest")


def _open_start(spark, sf_dir, **options):
    """Purchases as versions whose first one has no start: it is valid from the beginning, whatever the policy."""
    events = table(spark, sf_dir, "events")
    log = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    dim = history(log, "user_id", "ts", ["value"]).withColumnRenamed("value", "purchase_value")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("__START_AT").asc_nulls_first()))
    dim = dim.withColumn("_place", place).withColumn("__START_AT", F.when(F.col("_place") > 1, F.col("__START_AT")))
    return asof_join(events.select("event_id", "user_id", "ts"), dim, "user_id", "ts", ["purchase_value"], **options)


@query(_EARLIEST)
def asof_null_start(spark, sf_dir):
    return _open_start(spark, sf_dir, before_first="null")


@query(_EARLIEST)
def asof_null_start_carried(spark, sf_dir):
    return _open_start(spark, sf_dir, before_first="earliest", broadcast_rows=0)


_BY_DAY = with_(_PURCHASES) + """SELECT e.event_id, e.user_id, CAST(e.ts AS DATE) AS day, d.value AS purchase_value
    FROM events e ASOF LEFT JOIN v d ON e.user_id = d.user_id AND CAST(CAST(e.ts AS DATE) AS TIMESTAMP) >= d.__START_AT"""


def _by_day(spark, sf_dir, **options):
    """Days against versions with times: a day meets the version valid at its midnight."""
    events = table(spark, sf_dir, "events")
    log = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id", "value")
    dim = history(log, "user_id", "ts", ["value"]).withColumnRenamed("value", "purchase_value")
    days = events.select("event_id", "user_id", F.col("ts").cast("date").alias("day"))
    return asof_join(days, dim, "user_id", "day", ["purchase_value"], before_first="null", **options)


@query(_BY_DAY)
def asof_date_vs_timestamp(spark, sf_dir):
    return _by_day(spark, sf_dir)


@query(_BY_DAY)
def asof_date_vs_timestamp_carried(spark, sf_dir):
    return _by_day(spark, sf_dir, broadcast_rows=0)


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, o.o_custkey, c.c_nationkey, c.c_mktsegment, s.s_nationkey,
          cn.n_name AS customer_nation, sn.n_name AS supplier_nation
          FROM lineitem l LEFT JOIN orders o ON l_orderkey = o_orderkey LEFT JOIN customer c ON o_custkey = c_custkey
          LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey
          LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey""", "star_join")
def star(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    wide = star_join(t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"), [
        Dim(t("orders"), "l_orderkey", "o_orderkey", ["o_custkey"]),
        Dim(t("customer"), "o_custkey", "c_custkey", ["c_nationkey", "c_mktsegment"]),
        Dim(t("supplier"), "l_suppkey", "s_suppkey", ["s_nationkey"]),
        Dim(t("nation"), "c_nationkey", "n_nationkey", ["n_name"], "customer_"),
        Dim(t("nation"), "s_nationkey", "n_nationkey", ["n_name"], "supplier_"),
    ])
    return wide.drop("l_suppkey").withColumnsRenamed(
        {"customer_n_name": "customer_nation", "supplier_n_name": "supplier_nation"})


DIMS = ["dim_booker", "dim_driver", "dim_vehicle", "dim_province", "dim_ride_status", "dim_cancellation_reason",
        "dim_ride_option", "dim_payment_method"]


def _cte_person(name: str, columns: list[str]) -> str:
    return f"{name} AS ({newest('silver', columns[:1], ['booking_timestamp', *columns[1:]], ', '.join(columns))})"


@query(with_(FACT_CTE, DIM_OPTION, DIM_PAYMENT, DIM_PROVINCE, REASONS, STATUSES,
             _cte_person("bookers", ["booker_id", "booker_name", "booker_email", "booker_phone"]),
             _cte_person("drivers", ["driver_id", "driver_name", "driver_phone", "driver_license"]),
             _cte_person("vehicles", ["vehicle_id", "vehicle_license_plate"])) + """
    SELECT f.*, b.booker_name, w.driver_name, x.vehicle_license_plate, pp.province_name AS pickup_province_name,
           dp.province_name AS dropoff_province_name, s.ride_status, r.initiator, r.cancellation_reason,
           coalesce(o.ride_option_name, oe.ride_option_name) AS ride_option_name,
           coalesce(o.vehicle_class, oe.vehicle_class) AS vehicle_class,
           coalesce(p.payment_method, pe.payment_method) AS payment_method, coalesce(p.is_card, pe.is_card) AS is_card
    FROM fact f LEFT JOIN bookers b USING (booker_id) LEFT JOIN drivers w USING (driver_id)
    LEFT JOIN vehicles x USING (vehicle_id)
    LEFT JOIN dim_province pp ON f.pickup_city_id = pp.province_id
    LEFT JOIN dim_province dp ON f.dropoff_city_id = dp.province_id
    LEFT JOIN statuses s USING (ride_status_id) LEFT JOIN reasons r USING (cancellation_reason_id)
    ASOF LEFT JOIN dim_option o ON f.ride_option_id = o.ride_option_id AND f.booking_timestamp >= o.__START_AT
    ASOF LEFT JOIN dim_payment p ON f.payment_method_id = p.payment_method_id AND f.booking_timestamp >= p.__START_AT
    LEFT JOIN (SELECT * FROM dim_option QUALIFY row_number() OVER (PARTITION BY ride_option_id ORDER BY __START_AT) = 1)
      oe ON oe.ride_option_id = f.ride_option_id
    LEFT JOIN (SELECT * FROM dim_payment QUALIFY row_number()
      OVER (PARTITION BY payment_method_id ORDER BY __START_AT) = 1) pe ON pe.payment_method_id = f.payment_method_id
    """)
def ride_star(spark, sf_dir):
    return gold.ride_star(inputs.fact(spark, sf_dir), {d: inputs.dim(spark, sf_dir, d) for d in DIMS})
