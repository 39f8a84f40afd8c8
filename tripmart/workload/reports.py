"""Queries: marts over the ride fact and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tripmart.functions.columns import band
from tripmart.operators.asof import asof_join
from tripmart.operators.sizing import kept
from tripmart.plans import audits, marts
from tripmart import rules
from tripmart.workload import inputs
from tripmart.workload.inputs import table
from tripmart.workload.registry import query
from tripmart.workload.sql import DIM_OPTION, DIM_PAYMENT, DIM_PROVINCE, FACT_CTE, OPTIONS, REASONS, RIDES, STATUSES, values, with_

DONE, GONE = "ride_status_id = 1", "ride_status_id = 2"


def _money(c: str, where: str = "") -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(18,2))){f' FILTER ({where})' if where else ''} AS DOUBLE)"


@query(with_(FACT_CTE, """per AS (SELECT booker_id, CAST(date_trunc('month', booking_date) AS DATE) AS month,
         count(*) AS rides, count(*) FILTER (ride_status_id = 1) AS completed,
         sum(CAST(total_fare AS DECIMAL(18,2))) AS revenue FROM fact GROUP BY 1, 2)""",
             """fst AS (SELECT *, min(month) OVER (PARTITION BY booker_id) AS first_month FROM per)""",
             """mon AS (SELECT month, CAST(sum(rides) AS BIGINT) AS rides,
         CAST(sum(completed) AS BIGINT) AS completed_rides, sum(revenue) AS rev, count(*) AS active_bookers,
         count(*) FILTER (first_month = month) AS new_bookers FROM fst GROUP BY month)""") + """
    SELECT month, rides, completed_rides, CAST(rev AS DOUBLE) AS revenue, active_bookers, new_bookers,
      rides - lag(rides) OVER (ORDER BY month) AS rides_change,
      CAST(rides - lag(rides) OVER (ORDER BY month) AS DOUBLE) / CAST(lag(rides) OVER (ORDER BY month) AS DOUBLE)
        AS rides_change_rate,
      CAST(sum(rev) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_revenue FROM mon""")
def growth_monthly(spark, sf_dir):
    return marts.growth_monthly(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE) + """SELECT booking_date, booking_hour, count(*) AS rides,
    count(*) FILTER (surge_multiplier > 1) AS surge_rides,
    CAST(count(*) FILTER (surge_multiplier > 1) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS surge_share
    FROM fact GROUP BY ALL""")
def hourly_demand(spark, sf_dir):
    return marts.hourly_demand(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE) + f"""SELECT booking_date, booking_hour, count(*) AS rides, {_money('total_fare')} AS revenue,
    CAST(bit_count(CAST(GROUPING(booking_date, booking_hour) AS INTEGER)) AS INTEGER) AS level
    FROM fact GROUP BY ROLLUP (booking_date, booking_hour)""")
def demand_rollup(spark, sf_dir):
    return marts.demand_rollup(inputs.fact(spark, sf_dir))


def _cancel_sql(by: str) -> str:
    return with_(FACT_CTE) + f"""SELECT {by}, count(*) AS rides, count(*) FILTER ({GONE}) AS cancelled_rides,
        CAST(count(*) FILTER ({GONE}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS cancel_rate FROM fact GROUP BY {by}"""


for _by in ("booking_hour", "pickup_city_id", "ride_option_id"):
    query(_cancel_sql(_by), f"cancel_rate_{_by}")(
        lambda spark, sf_dir, by=_by: marts.cancel_rate(inputs.fact(spark, sf_dir), [by]))


@query(with_(FACT_CTE, REASONS) + f"""SELECT initiator, cancellation_reason, count(*) AS rides,
    CAST(GROUPING(initiator, cancellation_reason) AS INTEGER) AS level
    FROM fact LEFT JOIN reasons USING (cancellation_reason_id) WHERE {GONE}
    GROUP BY CUBE (initiator, cancellation_reason)""")
def cancel_reasons(spark, sf_dir):
    return marts.cancel_reasons(inputs.fact(spark, sf_dir), inputs.reasons(spark))


@query(with_(FACT_CTE) + f"""SELECT ride_option_id, count(*) AS rides,
    CAST(sum(rating) AS DOUBLE) / CAST(count(rating) AS DOUBLE) AS mean_rating,
    CAST(sum(CAST(driver_rating AS DECIMAL(10,1))) AS DOUBLE) / CAST(count(driver_rating) AS DOUBLE)
      AS mean_driver_rating,
    CAST(quantile_disc(rating, 0.5) AS INTEGER) AS median_rating,
    {', '.join(f'count(*) FILTER (rating = {r}) AS rating_{r}' for r in range(1, 6))}
    FROM fact WHERE {DONE} GROUP BY 1""")
def service_quality(spark, sf_dir):
    return marts.service_quality(inputs.fact(spark, sf_dir), ["ride_option_id"])


@query(with_(FACT_CTE) + f"""SELECT driver_id, count(*) AS rated_rides,
    CAST(sum(rating) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_rating
    FROM fact WHERE {DONE} AND rating IS NOT NULL GROUP BY 1
    HAVING CAST(sum(rating) AS DOUBLE) / CAST(count(*) AS DOUBLE) < 3.0""")
def low_rated_drivers(spark, sf_dir):
    return marts.low_rated_drivers(inputs.fact(spark, sf_dir), below=3.0)


_PROVINCES = f"""prov AS (SELECT pickup_city_id, count(*) AS rides, {_money('total_fare')} AS revenue,
    {_money('total_fare', DONE)} / CAST(count(*) FILTER ({DONE}) AS DOUBLE) AS average_fare FROM fact GROUP BY 1),
  ranked AS (SELECT *, CAST(dense_rank() OVER (ORDER BY rides DESC) AS INTEGER) AS rides_rank,
    CAST(dense_rank() OVER (ORDER BY revenue DESC) AS INTEGER) AS revenue_rank FROM prov)"""


@query(with_(FACT_CTE, _PROVINCES) + "SELECT * FROM ranked")
def geo_rank(spark, sf_dir):
    return marts.province_rank(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE, _PROVINCES) + "SELECT * FROM ranked ORDER BY revenue DESC, pickup_city_id LIMIT 10")
def top_provinces(spark, sf_dir):
    return marts.top_provinces(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE) + f"""SELECT pickup_city_id, dropoff_city_id, count(*) AS rides,
    {_money('total_fare')} AS revenue, pickup_city_id <> dropoff_city_id AS crosses,
    CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY pickup_city_id) AS DOUBLE) AS share_of_pickup
    FROM fact GROUP BY pickup_city_id, dropoff_city_id""")
def od_matrix(spark, sf_dir):
    return marts.od_matrix(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE) + """SELECT pickup_city_id, count(*) AS rides,
    count(*) FILTER (pickup_city_id <> dropoff_city_id) AS cross_rides,
    CAST(count(*) FILTER (pickup_city_id <> dropoff_city_id) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS cross_share
    FROM fact GROUP BY 1""")
def cross_province_share(spark, sf_dir):
    return marts.cross_province_share(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE, DIM_OPTION, f"""j AS (SELECT f.*, o.ride_option_name, o.is_active
    FROM fact f ASOF LEFT JOIN dim_option o
    ON f.ride_option_id = o.ride_option_id AND f.booking_timestamp >= o.__START_AT WHERE f.{DONE})""",
             f"""g AS (SELECT ride_option_id, ride_option_name, is_active, count(*) AS rides,
    sum(CAST(total_fare AS DECIMAL(18,2))) AS rev, {_money('tip_amount')} AS tips, {_money('subtotal')} AS sub
    FROM j GROUP BY 1, 2, 3)""") + """SELECT ride_option_id, ride_option_name, is_active, rides,
    CAST(rev AS DOUBLE) AS revenue, tips, CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) AS revenue_share,
    tips / sub AS tip_rate FROM g""")
def option_revenue(spark, sf_dir):
    """Revenue per option and by whether the option was active when booked."""
    dim = inputs.dim(spark, sf_dir, "dim_ride_option")
    fact = inputs.fact(spark, sf_dir).select("ride_option_id", "booking_timestamp", "ride_status_id", "total_fare",
                                             "tip_amount", "subtotal")
    joined = asof_join(fact, dim, "ride_option_id", "booking_timestamp", ["ride_option_name", "is_active"],
                       before_first="null")
    return marts.option_revenue(joined, ["ride_option_id", "ride_option_name", "is_active"])


@query(with_(FACT_CTE) + "SELECT ride_option_id, " + ", ".join(
    f"count(*) FILTER (payment_method_id = {m}) AS method_{m}" for m in range(1, 6))
    + ", count(*) FILTER (coalesce(payment_method_id NOT IN (1, 2, 3, 4, 5), true)) AS method_other,"
      " count(*) AS rides FROM fact GROUP BY 1")
def payment_mix(spark, sf_dir):
    return marts.payment_mix(inputs.fact(spark, sf_dir))


@query(with_(FACT_CTE) + f"""SELECT ride_option_id, count(*) AS rides, {_money('base_fare')} AS base,
    {_money('distance_fare')} AS distance, {_money('time_fare')} AS time, {_money('tip_amount')} AS tips,
    {_money('total_fare')} AS total,
    CAST(sum(CAST(subtotal AS DECIMAL(18,2)) - CAST(base_fare AS DECIMAL(18,2)) - CAST(distance_fare AS DECIMAL(18,2))
      - CAST(time_fare AS DECIMAL(18,2))) AS DOUBLE) AS surge_uplift FROM fact WHERE {DONE} GROUP BY 1""")
def fare_breakdown(spark, sf_dir):
    return marts.fare_breakdown(inputs.fact(spark, sf_dir), ["ride_option_id"])


# --- audits ---

_TIERS = [name for name, _ in rules.DISTANCE_TIERS]
_RULE_ROWS = [(o, float(r), *w) for o, (r, w) in rules.OPTION_RULES.items()]


def _case(value: str, bands: list[tuple], pick) -> str:
    arms = " ".join(f"WHEN {value} <= {b[0]} THEN {pick(b)}" for b in bands[:-1])
    return f"CASE {arms} ELSE {pick(bands[-1])} END"


def _number(x: float) -> str:
    return f"{x}::DOUBLE"


_TIER = _case("travel_distance_km", [(u, n) for n, u in rules.DISTANCE_TIERS], lambda b: f"'{b[1]}'")
_SLOW = _case("travel_distance_km", rules.SPEED_TIERS, lambda b: _number(b[1])) + f" * {_number(rules.SPEED_NOISE[0])}"
_FAST = _case("travel_distance_km", rules.SPEED_TIERS, lambda b: _number(b[2])) + f" * {_number(rules.SPEED_NOISE[1])}"
_WEIGHT = "CASE tier " + " ".join(f"WHEN '{t}' THEN w_{t}" for t in _TIERS) + " END"
_RULES_CTE = values("option_rules", _RULE_ROWS, "oid, min_ratio, " + ", ".join(f"w_{t}" for t in _TIERS))
_R = _number(6371.0088)

_AUDIT = (FACT_CTE, OPTIONS, REASONS, _RULES_CTE, f"""checked AS (
    SELECT f.*, o.base_rate, o.per_km, o.per_minute, o.passenger_capacity, q.*, r.initiator, {_TIER} AS tier,
      2 * {_R} * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(dropoff_latitude - pickup_latitude) / 2), 2)
        + cos(radians(pickup_latitude)) * cos(radians(dropoff_latitude))
        * pow(sin(radians(dropoff_longitude - pickup_longitude) / 2), 2)))) * 1.5::DOUBLE AS road
    FROM fact f LEFT JOIN options o USING (ride_option_id) LEFT JOIN option_rules q ON f.ride_option_id = q.oid
    LEFT JOIN reasons r USING (cancellation_reason_id))""")

_RULES = {
    "fare_base": f"{DONE} AND abs(base_fare - base_rate) > 0.011",
    "fare_distance": f"{DONE} AND abs(distance_fare - round(travel_distance_km * per_km, 2)) > 0.011",
    "fare_time": f"{DONE} AND abs(time_fare - round(duration_minutes * per_minute, 2)) > 0.011",
    "fare_subtotal": f"{DONE} AND abs(subtotal - round((base_fare + distance_fare + time_fare) * surge_multiplier, 2))"
                     " > 0.011",
    "fare_total": f"{DONE} AND abs(total_fare - (subtotal + tip_amount)) > 0.011",
    "surge": f"{DONE} AND CASE WHEN hour(pickup_timestamp) BETWEEN 7 AND 9 OR hour(pickup_timestamp) BETWEEN 17 AND 20"
             " THEN NOT surge_multiplier BETWEEN 1.2 AND 1.5 ELSE surge_multiplier <> 1.0 END",
    "option_not_suitable": f"{DONE} AND {_WEIGHT} <= 0",
    "speed": f"{DONE} AND NOT duration_minutes BETWEEN ceil(travel_distance_km / ({_FAST}) * 60)"
             f" AND ceil(travel_distance_km / ({_SLOW}) * 60)",
    "passengers": f"{DONE} AND NOT passenger_count BETWEEN greatest(1, ceil(passenger_capacity * min_ratio))"
                  " AND passenger_capacity",
    "cancelled_but_filled": f"{GONE} AND (travel_distance_km <> 0 OR duration_minutes <> 0 OR passenger_count <> 0 OR"
                            " base_fare <> 0 OR distance_fare <> 0 OR time_fare <> 0 OR subtotal <> 0 OR tip_amount <> 0"
                            " OR total_fare <> 0 OR pickup_timestamp IS NOT NULL OR dropoff_timestamp IS NOT NULL OR"
                            " driver_rating IS NOT NULL OR rating IS NOT NULL OR surge_multiplier <> 1)",
    "cancelled_without_reason": f"{GONE} AND initiator IS NULL",
    "completed_but_missing": f"{DONE} AND (pickup_timestamp IS NULL OR dropoff_timestamp IS NULL OR"
                             " driver_rating IS NULL OR rating IS NULL)",
    "completed_with_reason": f"{DONE} AND cancellation_reason_id <> 1",
    "dropoff_time": f"{DONE} AND date_diff('minute', pickup_timestamp, dropoff_timestamp) <> duration_minutes",
    "driver_rating": f"{DONE} AND NOT driver_rating BETWEEN 3.5 AND 5.0",
    "ride_rating": f"{DONE} AND NOT rating BETWEEN greatest(1, floor(driver_rating - 1.5))"
                   " AND least(5, floor(driver_rating + 1.5))",
    "tip_rate": f"{DONE} AND tip_amount <> 0 AND NOT tip_amount BETWEEN subtotal * 0.05::DOUBLE - 0.5"
                " AND subtotal * 0.2::DOUBLE + 0.5",
    "road_distance": f"{DONE} AND abs(travel_distance_km - road) > travel_distance_km * 0.01::DOUBLE",
}
_GROUP_RULES = {
    "fare": [r for r in _RULES if r.startswith("fare_")], "surge": ["surge"],
    "suitability": ["option_not_suitable"], "speed": ["speed"], "passengers": ["passengers"],
    "status": ["cancelled_but_filled", "cancelled_without_reason", "completed_but_missing", "completed_with_reason",
               "dropoff_time"],
    "ratings": ["driver_rating", "ride_rating", "tip_rate"], "road": ["road_distance"],
}


def _broken_sql(names) -> str:
    return " UNION ALL ".join(f"SELECT ride_id, '{r}' AS rule_id FROM checked WHERE {_RULES[r]}" for r in names)


def _broken(spark, sf_dir, groups=audits.GROUPS):
    return audits.audit_rides(inputs.fact(spark, sf_dir), inputs.ride_options(spark), inputs.reasons(spark), groups)


for _group, _names in _GROUP_RULES.items():
    query(with_(*_AUDIT) + _broken_sql(_names), f"audit_{_group}")(
        lambda spark, sf_dir, group=_group: _broken(spark, sf_dir, [group]))


_CHOSEN = ", ".join(f"coalesce(o.{c}, e.{c}) AS {c}" for c in ("base_rate", "per_km", "per_minute", "passenger_capacity"))
_AUDIT_VERSIONS = (FACT_CTE, DIM_OPTION, _RULES_CTE, f"""checked AS (
    SELECT f.*, {_CHOSEN}, q.*, {_TIER} AS tier
    FROM fact f ASOF LEFT JOIN dim_option o ON f.ride_option_id = o.ride_option_id AND f.booking_timestamp >= o.__START_AT
    LEFT JOIN (SELECT * FROM dim_option QUALIFY row_number() OVER (PARTITION BY ride_option_id ORDER BY __START_AT) = 1) e
      ON e.ride_option_id = f.ride_option_id
    LEFT JOIN option_rules q ON f.ride_option_id = q.oid)""")


@query(with_(*_AUDIT_VERSIONS) + _broken_sql([*_GROUP_RULES["fare"], "option_not_suitable", "passengers"]))
def audit_versions(spark, sf_dir):
    """Fares, suitability and passengers by the option's version at booking; rates and activity change by month."""
    return audits.audit_rides(inputs.fact(spark, sf_dir), inputs.dim(spark, sf_dir, "dim_ride_option"),
                              groups=["fare", "suitability", "passengers"], at="booking_timestamp")


@query(with_(*_AUDIT) + f"SELECT rule_id, count(*) AS rows_broken FROM ({_broken_sql(_RULES)}) GROUP BY 1")
def audit_summary(spark, sf_dir):
    return audits.audit_summary(_broken(spark, sf_dir))


@query(with_(*_AUDIT) + f"SELECT ride_id, ride_option_id, tier AS distance_tier FROM checked "
       f"WHERE {_RULES['option_not_suitable']}")
def unsuitable_options(spark, sf_dir):
    """Suitability by anti join with the exploded weights of the active options."""
    weights = audits.weights_long(audits.with_option_rules(inputs.ride_options(spark)))
    found = audits.unsuitable_options(inputs.fact(spark, sf_dir), weights)
    return found.select("ride_id", "ride_option_id", "distance_tier")


@query(f"""SELECT l_orderkey, l_linenumber, l_quantity,
    {_case('l_quantity', [(u, n) for n, u in rules.DISTANCE_TIERS], lambda b: f"'{b[1]}'")} AS distance_tier,
    {_case('l_quantity * l_linenumber * 3', [(u, n) for n, u in rules.TRIP_CATEGORIES], lambda b: f"'{b[1]}'")}
      AS trip_category FROM lineitem""")
def band_distance(spark, sf_dir):
    quantity = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", band(quantity, rules.DISTANCE_TIERS).alias("distance_tier"),
        band(quantity * F.col("l_linenumber") * 3, rules.TRIP_CATEGORIES).alias("trip_category"))


@query("""SELECT * FROM (SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'not_on_land'
    WHEN c_acctbal < 0 THEN 'other_country' WHEN c_nationkey % 5 = 0 THEN 'other_province' END AS rule_id
    FROM customer) WHERE rule_id IS NOT NULL""")
def location_audit(spark, sf_dir):
    """Customers with an address map made from their columns: two segments lie at sea, debtors abroad."""
    at_sea = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    province = F.concat(F.lit("TH-"), (F.col("c_nationkey") + 10).cast("string"))
    named = F.when(F.col("c_nationkey") % 5 == 0, "TH-99").otherwise(province)
    address = F.map_concat(
        F.create_map(F.lit("country_code"), F.when(F.col("c_acctbal") < 0, "la").otherwise("th"),
                     F.lit(rules.PROVINCE_KEY), named),
        F.when(at_sea, F.create_map(F.lit("region"), F.col("c_name")))
        .otherwise(F.create_map(F.lit("road"), F.col("c_name"))))
    places = table(spark, sf_dir, "customer").select("c_custkey", address.alias("address"),
                                                     province.alias("province_id"))
    return audits.location_problems(places).select("c_custkey", "rule_id")


_POPULAR = "(" + ", ".join(f"'{p}'" for p in rules.POPULAR_PROVINCES) + ")"


@query(with_(FACT_CTE) + f"""SELECT pickup_city_id IN {_POPULAR} AS popular_pickup,
    dropoff_city_id IN {_POPULAR} AS popular_dropoff, pickup_city_id = dropoff_city_id AS same_province,
    count(*) AS rides, CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share
    FROM fact GROUP BY 1, 2, 3""")
def popular_provinces(spark, sf_dir):
    return audits.popular_shares(inputs.fact(spark, sf_dir))


#: The foreign keys of a ride: column, dimension, its key.
FOREIGN_KEYS = [
    ("booker_id", "dim_booker", "booker_id"), ("driver_id", "dim_driver", "driver_id"), ("vehicle_id", "dim_vehicle", "vehicle_id"),
    ("pickup_city_id", "dim_province", "province_id"), ("dropoff_city_id", "dim_province", "province_id"),
    ("ride_option_id", "dim_ride_option", "ride_option_id"), ("payment_method_id", "dim_payment_method", "payment_method_id"),
    ("ride_status_id", "dim_ride_status", "ride_status_id"),
    ("cancellation_reason_id", "dim_cancellation_reason", "cancellation_reason_id")]
_PERSONS = [f"dim_{p} AS (SELECT DISTINCT {p}_id FROM rides WHERE ride_status_id = 1 OR {p}_id LIKE '%1')" for p in ("booker", "driver", "vehicle")]


@query(with_(RIDES, DIM_PROVINCE, DIM_OPTION, DIM_PAYMENT, STATUSES, REASONS, *_PERSONS,
             "dim_ride_option AS (SELECT * FROM dim_option)", "dim_payment_method AS (SELECT * FROM dim_payment)",
             "dim_ride_status AS (SELECT * FROM statuses)", "dim_cancellation_reason AS (SELECT * FROM reasons)")
       + "SELECT 'duplicate_ride_id' AS rule_id, ride_id AS key_value, count(*) AS row_count FROM rides GROUP BY ride_id HAVING count(*) > 1"
       + "".join(f""" UNION ALL SELECT 'orphan_{child}', CAST({child} AS VARCHAR), count(*) FROM rides
    WHERE {child} NOT IN (SELECT {key} FROM {dim}) GROUP BY {child}""" for child, dim, key in FOREIGN_KEYS))
def ref_integrity(spark, sf_dir):
    """Raw rides: repeated ids, and every foreign key that its dimension lacks; the persons are those known from a part of the rides."""
    rides = kept(inputs.rides(spark, sf_dir).select("ride_id", *[child for child, _, _ in FOREIGN_KEYS]))

    def parent(dim: str, key: str):
        if dim not in ("dim_booker", "dim_driver", "dim_vehicle"):
            return inputs.dim(spark, sf_dir, dim)
        return rides.where((F.col("ride_status_id") == 1) | F.col(key).like("%1")).select(key).distinct()

    return audits.integrity(rides, [(child, parent(dim, key), key) for child, dim, key in FOREIGN_KEYS])
