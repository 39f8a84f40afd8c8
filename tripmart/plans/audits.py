"""Data-quality audits: rides that break the rules by which a ride is made.

All rules on single rides are checked in one pass: each ride yields the list of rules it breaks. The tables
that the rules look up (options, reasons) are broadcast after a size check; the rides are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripmart import rules
from tripmart.functions.columns import (
    active, band, band_value, great_circle_km, in_any_range, minutes_between,
)
from tripmart.operators.asof import asof_join
from tripmart.operators.joins import duplicate_keys, orphans
from tripmart.operators.grid import with_boxes
from tripmart.operators.sizing import small_side

FARE_TOLERANCE = 0.011
ROAD_TOLERANCE = 0.01


def completed() -> Column:
    return F.col("ride_status_id") == rules.COMPLETED


def cancelled() -> Column:
    return F.col("ride_status_id") == rules.CANCELLED


def _km() -> Column:
    return F.col("travel_distance_km")


def _minutes() -> Column:
    return F.col("duration_minutes")


def option_rules(spark: SparkSession) -> DataFrame:
    """Fixed rules per option: least passenger share and a weight per distance tier."""
    tiers = [name for name, _ in rules.DISTANCE_TIERS]
    rows = [(option, ratio, dict(zip(tiers, weights))) for option, (ratio, weights) in rules.OPTION_RULES.items()]
    return spark.createDataFrame(
        rows, "ride_option_id int, min_passengers_ratio double, distance_weights map<string,int>")


def with_option_rules(options: DataFrame, retired: bool = False) -> DataFrame:
    """Active options (or all) with their rules; an option without rules gets no weights and no least share."""
    return (
        (options if retired else options.where(active()))
        .join(F.broadcast(option_rules(options.sparkSession)), "ride_option_id", "left")
        .withColumn("min_passengers_ratio", F.coalesce("min_passengers_ratio", F.lit(0.0)))
        .withColumn("distance_weights", F.coalesce("distance_weights", F.create_map().cast("map<string,int>")))
    )


def weights_long(options_with_rules: DataFrame) -> DataFrame:
    """One row per option and distance tier."""
    return options_with_rules.select("ride_option_id", F.explode("distance_weights").alias("distance_tier", "weight"))


def distance_tier(distance: Column | None = None) -> Column:
    return band(_km() if distance is None else distance, rules.DISTANCE_TIERS)


def trip_category(distance: Column | None = None) -> Column:
    return band(_km() if distance is None else distance, rules.TRIP_CATEGORIES)


def _off(actual: Column, expected: Column) -> Column:
    return F.abs(actual - expected) > FARE_TOLERANCE


def _fare() -> dict[str, Column]:
    parts = F.col("base_fare") + F.col("distance_fare") + F.col("time_fare")
    return {
        "fare_base": completed() & _off(F.col("base_fare"), F.col("base_rate")),
        "fare_distance": completed() & _off(F.col("distance_fare"), F.round(_km() * F.col("per_km"), 2)),
        "fare_time": completed() & _off(F.col("time_fare"), F.round(_minutes() * F.col("per_minute"), 2)),
        "fare_subtotal": completed() & _off(F.col("subtotal"), F.round(parts * F.col("surge_multiplier"), 2)),
        "fare_total": completed() & _off(F.col("total_fare"), F.col("subtotal") + F.col("tip_amount")),
    }


def _surge() -> dict[str, Column]:
    surge, low_high = F.col("surge_multiplier"), rules.SURGE_RANGE
    rush = in_any_range(F.hour("pickup_timestamp"), rules.SURGE_HOURS)
    return {"surge": completed() & F.when(rush, ~surge.between(*low_high)).otherwise(surge != 1.0)}


def _suitability() -> dict[str, Column]:
    weight = F.coalesce(F.try_element_at("distance_weights", distance_tier()), F.lit(0))
    return {"option_not_suitable": completed() & _km().isNotNull() & (weight <= 0)}


def _speed() -> dict[str, Column]:
    low, high = rules.SPEED_NOISE
    slowest = band_value(_km(), rules.SPEED_TIERS, 1) * low
    fastest = band_value(_km(), rules.SPEED_TIERS, 2) * high
    return {"speed": completed() & ~_minutes().between(F.ceil(_km() / fastest * 60), F.ceil(_km() / slowest * 60))}


def _passengers() -> dict[str, Column]:
    least = F.greatest(F.lit(1), F.ceil(F.col("passenger_capacity") * F.col("min_passengers_ratio")))
    return {"passengers": completed() & ~F.col("passenger_count").between(least, F.col("passenger_capacity"))}


def _status() -> dict[str, Column]:
    zero = ["travel_distance_km", "duration_minutes", "passenger_count", "base_fare", "distance_fare",
            "time_fare", "subtotal", "tip_amount", "total_fare"]
    empty = ["pickup_timestamp", "dropoff_timestamp", "driver_rating", "rating"]
    filled, missing = F.lit(False), F.lit(False)
    for c in zero:
        filled = filled | ~F.col(c).eqNullSafe(F.lit(0))
        missing = missing | F.col(c).isNull()
    for c in empty:
        filled = filled | F.col(c).isNotNull()
        missing = missing | F.col(c).isNull()
    reason = F.col("cancellation_reason_id")
    ride_time = minutes_between(F.col("pickup_timestamp"), F.col("dropoff_timestamp"))
    return {
        "cancelled_but_filled": cancelled() & (filled | ~F.col("surge_multiplier").eqNullSafe(F.lit(1.0))),
        "cancelled_without_reason": cancelled() & F.col("initiator").isNull(),
        "completed_but_missing": completed() & missing,
        "completed_with_reason": completed() & (reason != rules.NOT_CANCELLED_REASON),
        "dropoff_time": completed() & (F.abs(ride_time - _minutes()) > 1e-6),
        "unknown_status": F.col("ride_status_id").isNull() | ~(completed() | cancelled()),
    }


def _ratings() -> dict[str, Column]:
    driver, rating = F.col("driver_rating"), F.col("rating")
    low = F.greatest(F.lit(1), F.floor(driver - rules.RATING_NOISE))
    high = F.least(F.lit(5), F.floor(driver + rules.RATING_NOISE))
    tip, subtotal, (tip_low, tip_high) = F.col("tip_amount"), F.col("subtotal"), rules.TIP_RATE_RANGE
    return {
        "driver_rating": completed() & ~driver.between(*rules.DRIVER_RATING_RANGE),
        "ride_rating": completed() & ~rating.between(low, high),
        "tip_rate": completed() & (tip != 0) & ~tip.between(subtotal * tip_low - 0.5, subtotal * tip_high + 0.5),
    }


def _road() -> dict[str, Column]:
    straight = great_circle_km(F.col("pickup_latitude"), F.col("pickup_longitude"),
                               F.col("dropoff_latitude"), F.col("dropoff_longitude"))
    expected = straight * rules.ROAD_DISTANCE_FACTOR
    return {"road_distance": completed() & (F.abs(_km() - expected) > _km() * ROAD_TOLERANCE)}


GROUPS: dict[str, Callable[[], dict[str, Column]]] = {
    "fare": _fare, "surge": _surge, "suitability": _suitability, "speed": _speed, "passengers": _passengers,
    "status": _status, "ratings": _ratings, "road": _road,
}
_NEED_OPTIONS = {"fare", "suitability", "passengers"}
_NEED_REASONS = {"status"}


def audit_rides(rides: DataFrame, options: DataFrame | None = None, reasons: DataFrame | None = None,
                groups: Iterable[str] = GROUPS, at: str | None = None) -> DataFrame:
    """(ride_id, rule_id) of every broken rule of the chosen groups, in one pass over the rides.

    `options` has one row per option, retired ones too: they were valid for old rides. With `at`, a time of the rides, it
    is the versioned dimension, and each ride is held against the option as it was then (or its first version). An
    unknown option breaks no fare rule; `integrity` reports it.
    """
    groups = list(groups)
    if _NEED_OPTIONS & set(groups):
        columns = ["base_rate", "per_km", "per_minute", "passenger_capacity", "min_passengers_ratio", "distance_weights"]
        wanted = with_option_rules(options, retired=True)
        if at:
            rides = asof_join(rides, wanted, "ride_option_id", at, columns)
        else:
            wanted = wanted.select(F.col("ride_option_id").alias("_option"), *columns)
            rides = rides.join(small_side(wanted), F.col("ride_option_id") == F.col("_option"), "left")
    if _NEED_REASONS & set(groups):
        wanted = reasons.select(F.col("cancellation_reason_id").alias("_reason"), "initiator")
        rides = rides.join(small_side(wanted), F.col("cancellation_reason_id") == F.col("_reason"), "left")
    checks = {rule: bad for g in groups for rule, bad in GROUPS[g]().items()}
    # Joined text rather than an array with a filter lambda: lambdas are evaluated outside generated code.
    broken = F.concat_ws(",", *[F.when(bad, F.lit(rule)) for rule, bad in checks.items()])
    return rides.select("ride_id", F.explode(F.split(broken, ",")).alias("rule_id")).where("rule_id <> ''")


def audit_summary(broken: DataFrame) -> DataFrame:
    return broken.groupBy("rule_id").agg(F.count("*").alias("rows_broken"))


def unsuitable_options(rides: DataFrame, weights: DataFrame) -> DataFrame:
    """Suitability as a join against the long weight table, for rules kept as data."""
    allowed = weights.where("weight > 0").select("ride_option_id", "distance_tier")
    return (rides.where(completed() & _km().isNotNull()).withColumn("distance_tier", distance_tier())
            .join(small_side(allowed), ["ride_option_id", "distance_tier"], "left_anti"))


def location_problems(locations: DataFrame, address: str = "address", province: str = "province_id") -> DataFrame:
    """Rows whose reverse-geocoded address map is not on land, not in the country or in another province."""
    addr = F.col(address)
    on_land = F.arrays_overlap(F.map_keys(addr), F.array(*[F.lit(k) for k in rules.LAND_ADDRESS_KEYS]))
    problem = (
        F.when(~F.coalesce(on_land, F.lit(False)), "not_on_land")
        .when(~F.try_element_at(addr, F.lit("country_code")).eqNullSafe(F.lit(rules.COUNTRY_CODE)), "other_country")
        .when(~F.try_element_at(addr, F.lit(rules.PROVINCE_KEY)).eqNullSafe(F.col(province)), "other_province")
    )
    return locations.withColumn("rule_id", problem).where(F.col("rule_id").isNotNull())


AREA = ("min_lat", "min_lon", "max_lat", "max_lon")


def outside_area(rides: DataFrame, areas: DataFrame) -> DataFrame:
    """Rides whose pickup lies outside the box of its own province, with the provinces whose boxes hold it.

    `areas` has one row per `province_id` with its box. The own box is met by the province; only rides outside it are looked
    up in the grid. A ride without a position, or of a province without a box, counts as outside.
    """
    own = areas.select(F.col("province_id").alias("_own"), *[F.col(c).alias(f"_{c}") for c in AREA])
    lat, lon = F.col("pickup_latitude"), F.col("pickup_longitude")
    inside = (lat >= F.col("_min_lat")) & (lat <= F.col("_max_lat")) & (lon >= F.col("_min_lon")) & (lon <= F.col("_max_lon"))
    outside = (rides.join(own, F.col("pickup_city_id") == F.col("_own"), "left").where(~F.coalesce(inside, F.lit(False)))
               .select("ride_id", "pickup_city_id", "pickup_latitude", "pickup_longitude"))
    return with_boxes(outside, "pickup_latitude", "pickup_longitude", areas, "province_id", AREA, found="found_in")


def popular_shares(rides: DataFrame) -> DataFrame:
    """Rides by popularity of pickup and dropoff province and by whether both are the same, with shares."""
    flag = lambda c: F.col(c).isin(rules.POPULAR_PROVINCES)
    counted = (
        rides.groupBy(flag("pickup_city_id").alias("popular_pickup"), flag("dropoff_city_id").alias("popular_dropoff"),
                      (F.col("pickup_city_id") == F.col("dropoff_city_id")).alias("same_province"))
        .agg(F.count("*").alias("rides"))
    )
    total = F.sum("rides").over(Window.partitionBy())
    return counted.withColumn("share", F.col("rides").cast("double") / total.cast("double"))


def integrity(fact: DataFrame, references: Iterable[tuple[str, DataFrame, str]],
              key: str = "ride_id") -> DataFrame:
    """Orphan foreign keys and duplicate keys as (rule_id, key value, rows)."""
    parts = []
    for child, parent, parent_key in references:
        # Counted per key first, so only distinct keys meet the dimension, however large or skewed the fact is.
        per_key = fact.groupBy(child).agg(F.count("*").alias("row_count"))
        parts.append(orphans(per_key, parent, child, parent_key).select(
            F.lit(f"orphan_{child}").alias("rule_id"), F.col(child).cast("string").alias("key_value"), "row_count"))
    doubled = duplicate_keys(fact.select(key), [key]).select(
        F.lit(f"duplicate_{key}").alias("rule_id"), F.col(key).cast("string").alias("key_value"), "row_count")
    out = doubled
    for part in parts:
        out = out.unionByName(part)
    return out


def share_fit(fact: DataFrame) -> DataFrame:
    """Per month: how far completed rides, rides within a province and tips are from their expected shares.

    `chi_square` has `degrees` of freedom; it comes from two counts per month and share, so months can be added up.
    """
    done = F.col("ride_status_id") == 1
    tests = {"completed": done, "same_province": F.col("pickup_city_id") == F.col("dropoff_city_id"),
             "tipped": F.when(done, F.col("tip_amount") > 0)}
    hits = [F.struct(F.lit(name).alias("share"), F.lit(rules.EXPECTED_SHARES[name]).alias("expected_share"), F.count(hit).alias("n"),
                     F.count_if(hit).alias("hits")) for name, hit in tests.items()]
    counted = fact.groupBy(F.trunc("booking_date", "month").alias("month")).agg(F.array(*hits).alias("_tests"))
    off = F.pow(F.col("hits") - F.col("n") * F.col("expected_share"), F.lit(2.0))
    return counted.select("month", F.inline("_tests")).where("n > 0").select(
        "month", "share", "n", "hits", "expected_share",
        (off / (F.col("n") * F.col("expected_share")) + off / (F.col("n") * (1 - F.col("expected_share")))).alias("chi_square"),
        F.lit(1).alias("degrees"))
