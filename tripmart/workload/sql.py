"""SQL text shared by the checks: the derived ride tables as common table expressions."""

from tripmart.schemas import FACT, PII, RIDE, TIMESTAMPS
from tripmart.workload.inputs import CANCELLATION_REASONS, PAYMENT_METHODS, RIDE_OPTIONS, RIDE_STATUSES


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else repr(v) if isinstance(v, str) else str(v)


def values(name: str, rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(_value(v) for v in r) + ")" for r in rows)
    return f"{name} AS (SELECT * FROM (VALUES {body}) AS t({columns}))"


def newest(relation: str, keys: list[str], order: list[str], columns: str = "*", direction: str = "DESC NULLS LAST") -> str:
    by = ", ".join(f"{c} {direction}" for c in order)
    return (f"SELECT {columns} FROM {relation} "
            f"QUALIFY row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {by}) = 1")


_RATE = {i: "CASE opt " + " ".join(f"WHEN {r[0]} THEN CAST({r[i]} AS DOUBLE)" for r in RIDE_OPTIONS) + " END"
         for i in (4, 5, 6)}

RIDES = f"""
line_a AS (
  SELECT *, l_returnflag <> 'R' AS done,
    l_shipdate + to_hours(l_orderkey % 24) + to_minutes(CAST(l_linenumber * 7 AS BIGINT)) AS booked,
    CAST(1 + l_partkey % 6 AS INTEGER) AS opt,
    l_quantity * (CASE WHEN l_linenumber = 7 THEN 8.0::DOUBLE ELSE 2.0::DOUBLE END) AS km
  FROM lineitem),
line_b AS (
  SELECT *, CAST(ceil(km / (15.0::DOUBLE + l_tax * 1000.0::DOUBLE) * 60.0::DOUBLE) AS INTEGER) AS mins,
    CASE WHEN hour(booked) BETWEEN 7 AND 9 OR hour(booked) BETWEEN 17 AND 20 OR l_discount = 0.1::DOUBLE
         THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS surge
  FROM line_a),
line_c AS (
  SELECT *, {_RATE[4]} AS base, km * {_RATE[5]} AS dist, mins * {_RATE[6]} AS tim FROM line_b),
line_d AS (SELECT *, (base + dist + tim) * surge AS sub FROM line_c),
line_e AS (SELECT *, floor(sub * l_discount) AS tip FROM line_d),
rides AS (
  SELECT
    'R' || l_orderkey || '-' || l_linenumber AS ride_id,
    'B' || l_partkey AS booker_id, 'D' || l_suppkey AS driver_id, 'V' || l_suppkey AS vehicle_id,
    CASE WHEN done THEN 1 ELSE 2 END AS ride_status_id,
    'TH-' || (10 + l_suppkey % 81) AS pickup_city_id,
    CASE WHEN l_linestatus = 'O' THEN 'TH-' || (10 + l_suppkey % 81) ELSE 'TH-' || (10 + l_partkey % 81) END
      AS dropoff_city_id,
    opt AS ride_option_id, CAST(1 + l_orderkey % 5 AS INTEGER) AS payment_method_id,
    strftime(booked, '%Y-%m-%dT%H:%M:%S') AS booking_timestamp,
    13.0::DOUBLE + CAST(l_suppkey % 50 AS DOUBLE) / 10.0::DOUBLE AS pickup_latitude,
    100.0::DOUBLE + CAST(l_suppkey % 7 AS DOUBLE) / 10.0::DOUBLE AS pickup_longitude,
    'No. ' || l_linenumber || ', Road ' || l_suppkey || ', "' || l_returnflag || '"' AS pickup_address,
    13.0::DOUBLE + CAST(l_suppkey % 50 AS DOUBLE) / 10.0::DOUBLE + km / 166.8::DOUBLE AS dropoff_latitude,
    100.0::DOUBLE + CAST(l_suppkey % 7 AS DOUBLE) / 10.0::DOUBLE
      + (CASE WHEN l_linenumber = 5 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS dropoff_longitude,
    'No. ' || l_linenumber || ', Road ' || l_partkey AS dropoff_address,
    'Booker ' || l_partkey || ' ' || l_linestatus AS booker_name,
    'b' || l_partkey || '@example.com' AS booker_email,
    '08' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS booker_phone,
    'Driver ' || l_suppkey AS driver_name,
    '09' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS driver_phone,
    lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS driver_license,
    'P' || l_suppkey || l_linestatus AS vehicle_license_plate,
    CAST(CASE WHEN done THEN (CASE WHEN l_linenumber = 3 AND l_tax = 0 THEN 2 ELSE 1 END)
         WHEN l_linenumber = 6 THEN 1 ELSE 2 + l_partkey % 6 END AS INTEGER) AS cancellation_reason_id,
    CASE WHEN done THEN km ELSE 0 END AS travel_distance_km,
    CASE WHEN done THEN mins ELSE 0 END AS duration_minutes,
    CAST(CASE WHEN done THEN 1 + l_suppkey % 10 WHEN l_discount = 0.1::DOUBLE THEN 1 ELSE 0 END AS INTEGER)
      AS passenger_count,
    CASE WHEN done THEN strftime(booked, '%Y-%m-%dT%H:%M:%S') END AS pickup_timestamp,
    CASE WHEN done THEN strftime(booked + to_minutes(CAST(mins + (CASE WHEN l_tax = 0.07::DOUBLE THEN 1 ELSE 0 END)
      AS BIGINT)), '%Y-%m-%dT%H:%M:%S') END AS dropoff_timestamp,
    CASE WHEN done THEN CAST(35 + l_suppkey % 17 AS DOUBLE) / 10.0::DOUBLE END AS driver_rating,
    CAST(CASE WHEN done AND l_tax <> 0.05::DOUBLE THEN 1 + l_partkey % 5 END AS INTEGER) AS rating,
    CASE WHEN done THEN base ELSE 0 END AS base_fare, CASE WHEN done THEN dist ELSE 0 END AS distance_fare,
    CASE WHEN done THEN tim ELSE 0 END AS time_fare, CASE WHEN done THEN surge ELSE 1 END AS surge_multiplier,
    CASE WHEN done THEN sub ELSE 0 END AS subtotal, CASE WHEN done THEN tip ELSE 0 END AS tip_amount,
    CASE WHEN done THEN sub + tip + (CASE WHEN l_tax = 0.08::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ELSE 0 END
      AS total_fare
  FROM line_e)"""

SILVER = RIDES + """,
silver AS (SELECT """ + ", ".join(
    f"TRY_CAST({c} AS TIMESTAMP) AS {c}" if c in TIMESTAMPS else f"sha256({c}) AS {c}" if c in PII else c
    for c in RIDE.fieldNames()) + """, CAST(NULL AS TIMESTAMP) AS _ingested_at FROM rides)"""

_FACT_ORDER = ["booking_timestamp"] + [c for c in FACT if c not in ("ride_id", "booking_timestamp")]

FACT_CTE = SILVER + f""",
fact AS (
  SELECT {', '.join(FACT)}, CAST(booking_timestamp AS DATE) AS booking_date,
         CAST(hour(booking_timestamp) AS INTEGER) AS booking_hour
  FROM ({newest('silver', ['ride_id'], _FACT_ORDER)}))"""

OPTIONS = values("options", RIDE_OPTIONS,
                 "ride_option_id, ride_option_name, vehicle_class, passenger_capacity, base_rate, per_km, per_minute")
METHODS = values("methods", PAYMENT_METHODS, "payment_method_id, payment_method, is_card, requires_auth")
STATUSES = values("statuses", RIDE_STATUSES, "ride_status_id, ride_status")
REASONS = values("reasons", CANCELLATION_REASONS, "cancellation_reason_id, initiator, cancellation_reason")


def versions(name: str, log: str, keys: list[str], seq: str, tracked: list[str], columns: list[str],
             tiebreak: list[str] = ()) -> str:
    """CTEs that end in `name`: the SCD 2 versions of relation `log`."""
    part = f"PARTITION BY {', '.join(keys)} ORDER BY {seq}"
    state = f"ROW({', '.join(tracked)})"
    last = ", ".join(f"arg_max(ROW({c}), {seq})[1] AS {c}" for c in columns if c not in keys and c != seq)
    seq_last = f"max({seq}) AS {seq}" if seq in columns else ""
    picked = ", ".join(x for x in (last, seq_last) if x)
    return f"""
{name}_u AS ({newest(log, [*keys, seq], list(tiebreak) or [seq])}),
{name}_f AS (SELECT *, CASE WHEN row_number() OVER ({part}) = 1
    OR lag({state}) OVER ({part}) IS DISTINCT FROM {state} THEN 1 ELSE 0 END AS opens FROM {name}_u),
{name}_n AS (SELECT *, sum(opens) OVER ({part} ROWS UNBOUNDED PRECEDING) AS vid FROM {name}_f),
{name}_g AS (SELECT {', '.join(keys)}, vid, min({seq}) AS start_at, {picked}
    FROM {name}_n GROUP BY {', '.join(keys)}, vid),
{name} AS (SELECT * EXCLUDE (vid, start_at), start_at AS __START_AT,
    lead(start_at) OVER (PARTITION BY {', '.join(keys)} ORDER BY start_at) AS __END_AT FROM {name}_g)"""


OPTION_LOG = OPTIONS + """,
option_log AS (
  SELECT o.ride_option_id, ride_option_name, vehicle_class, passenger_capacity, base_rate,
         per_km + n AS per_km, per_minute, is_active, CAST(NULL AS VARCHAR) AS retired_at, loaded_at
  FROM (SELECT CAST(1 + l_partkey % 6 AS INTEGER) AS oid, date_trunc('month', l_shipdate) AS loaded_at,
               count(*) FILTER (l_returnflag = 'A') >= count(*) FILTER (l_returnflag = 'R') AS is_active,
               count(*) AS n
        FROM lineitem GROUP BY ALL) m JOIN options o ON o.ride_option_id = m.oid)"""

OPTION_COLUMNS = ["ride_option_id", "ride_option_name", "vehicle_class", "passenger_capacity", "base_rate",
                  "per_km", "per_minute", "is_active", "retired_at", "loaded_at"]
DIM_OPTION = OPTION_LOG + "," + versions("dim_option", "option_log", ["ride_option_id"], "loaded_at",
                                         ["ride_option_name", "is_active", "retired_at"], OPTION_COLUMNS)

PAYMENT_LOG = METHODS + """,
payment_log AS (
  SELECT m.payment_method_id, payment_method, is_card, requires_auth, is_active,
         CAST(NULL AS VARCHAR) AS retired_at, loaded_at
  FROM (SELECT CAST(1 + o_orderkey % 5 AS INTEGER) AS pid, date_trunc('month', o_orderdate) AS loaded_at,
               count(*) FILTER (o_orderstatus = 'F') * 3 >= count(*) AS is_active
        FROM orders GROUP BY ALL) l JOIN methods m ON m.payment_method_id = l.pid)"""

PAYMENT_COLUMNS = ["payment_method_id", "payment_method", "is_card", "requires_auth", "is_active", "retired_at",
                   "loaded_at"]
DIM_PAYMENT = PAYMENT_LOG + "," + versions("dim_payment", "payment_log", ["payment_method_id"], "loaded_at",
                                           ["payment_method", "is_active", "retired_at"], PAYMENT_COLUMNS)

PROVINCE_LOG = """
province_log AS (
  SELECT 'TH-' || (10 + s_suppkey % 81) AS province_id, max(s_name) AS province_name,
         make_timestamp(CAST(s_nationkey AS BIGINT) * 86400 * 1000000) AS loaded_at
  FROM supplier GROUP BY 1, s_nationkey)"""
DIM_PROVINCE = PROVINCE_LOG + ",\ndim_province AS (" + newest(
    "province_log", ["province_id"], ["loaded_at", "province_name"]) + ")"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
