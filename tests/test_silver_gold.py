"""Conformance, star schema, marts and audits on small rides."""

import hashlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tripmart.functions.columns import band, great_circle_km
from tripmart.plans import audits, gold, marts, silver
from tripmart.rules import DISTANCE_TIERS, TRIP_CATEGORIES
from tripmart.schemas import FACT, RIDE
from tripmart.workload import inputs

CLEAN = {
    "ride_id": "R1", "booker_id": "B1", "driver_id": "D1", "vehicle_id": "V1", "ride_status_id": 1,
    "pickup_city_id": "TH-10", "dropoff_city_id": "TH-10", "ride_option_id": 1, "payment_method_id": 1,
    "booking_timestamp": "2026-01-05T08:30:00", "pickup_latitude": 13.75, "pickup_longitude": 100.5,
    "dropoff_latitude": 13.80995, "dropoff_longitude": 100.5, "booker_name": "Somchai", "driver_name": None,
    "cancellation_reason_id": 1, "travel_distance_km": 10.0, "duration_minutes": 16, "passenger_count": 2,
    "pickup_timestamp": "2026-01-05T08:30:00", "dropoff_timestamp": "2026-01-05T08:46:00", "driver_rating": 4.2,
    "rating": 4, "base_fare": 45.0, "distance_fare": 90.0, "time_fare": 40.0, "surge_multiplier": 1.2,
    "subtotal": 210.0, "tip_amount": 21.0, "total_fare": 231.0,
}
GONE = {
    "ride_status_id": 2, "cancellation_reason_id": 3, "travel_distance_km": 0.0, "duration_minutes": 0,
    "passenger_count": 0, "pickup_timestamp": None, "dropoff_timestamp": None, "driver_rating": None, "rating": None,
    "base_fare": 0.0, "distance_fare": 0.0, "time_fare": 0.0, "surge_multiplier": 1.0, "subtotal": 0.0,
    "tip_amount": 0.0, "total_fare": 0.0,
}


def make(spark, *changes):
    rows = [{f.name: None for f in RIDE.fields} | CLEAN | c for c in changes]
    return spark.createDataFrame(rows, RIDE)


def broken(spark, *changes):
    rides = silver.conform(make(spark, *changes))
    found = audits.audit_rides(rides, inputs.ride_options(spark), inputs.reasons(spark))
    return sorted(r.rule_id for r in found.collect())


def test_clean_rides_break_no_rule(spark):
    assert broken(spark, {}, GONE | {"ride_id": "R2"}) == []


@pytest.mark.parametrize("change,rules", [
    ({"base_fare": 46.0}, ["fare_base", "fare_subtotal"]),
    ({"distance_fare": 91.0}, ["fare_distance", "fare_subtotal"]),
    ({"time_fare": 41.0}, ["fare_subtotal", "fare_time"]),
    ({"subtotal": 209.0, "total_fare": 230.0}, ["fare_subtotal"]),
    ({"total_fare": 232.0}, ["fare_total"]),
    ({"total_fare": 231.01}, []),  # within the rounding tolerance
    ({"surge_multiplier": 1.0, "subtotal": 175.0, "total_fare": 196.0}, ["surge"]),
    ({"surge_multiplier": 1.6, "subtotal": 280.0, "total_fare": 301.0}, ["surge"]),
    ({"booking_timestamp": "2026-01-05T10:30:00", "pickup_timestamp": "2026-01-05T10:30:00",
      "dropoff_timestamp": "2026-01-05T10:46:00"}, ["surge"]),
    ({"ride_option_id": 6, "passenger_count": 6, "base_fare": 150.0, "distance_fare": 200.0, "time_fare": 80.0,
      "subtotal": 516.0, "tip_amount": 0.0, "total_fare": 516.0}, ["option_not_suitable"]),
    ({"duration_minutes": 30, "time_fare": 75.0, "subtotal": 252.0, "total_fare": 273.0,
      "dropoff_timestamp": "2026-01-05T09:00:00"}, ["speed"]),
    ({"passenger_count": 5}, ["passengers"]),
    ({"passenger_count": 0}, ["passengers"]),
    (GONE | {"tip_amount": 1.0}, ["cancelled_but_filled"]),
    (GONE | {"driver_rating": 4.0}, ["cancelled_but_filled"]),
    (GONE | {"cancellation_reason_id": 1}, ["cancelled_without_reason"]),
    ({"rating": None}, ["completed_but_missing"]),
    ({"cancellation_reason_id": 2}, ["completed_with_reason"]),
    ({"dropoff_timestamp": "2026-01-05T08:47:00"}, ["dropoff_time"]),
    ({"ride_status_id": 3}, ["unknown_status"]),
    ({"driver_rating": 5.1}, ["driver_rating"]),
    ({"rating": 1}, ["ride_rating"]),
    ({"tip_amount": 60.0, "total_fare": 270.0}, ["tip_rate"]),
    ({"dropoff_latitude": 13.9}, ["road_distance"]),
    ({"ride_option_id": 99}, ["option_not_suitable"]),
])
def test_each_rule_is_caught(spark, change, rules):
    assert broken(spark, change) == rules


def test_summary_integrity_and_shares(spark):
    fact = gold.fact_rides(silver.conform(make(spark, {}, {"ride_id": "R2", "pickup_city_id": "TH-99"})))
    found = audits.audit_rides(fact, inputs.ride_options(spark), inputs.reasons(spark), ["fare"])
    assert audits.audit_summary(found).count() == 0
    provinces = spark.createDataFrame([("TH-10",)], "province_id string")
    got = audits.integrity(fact.unionByName(fact.where("ride_id = 'R1'")),
                           [("pickup_city_id", provinces, "province_id")])
    assert sorted(map(tuple, got.collect())) == [("duplicate_ride_id", "R1", 2), ("orphan_pickup_city_id", "TH-99", 1)]
    shares = {(r.popular_pickup, r.same_province): r.share for r in audits.popular_shares(fact).collect()}
    assert shares == {(True, True): 0.5, (False, False): 0.5}


def test_option_rules_enrich_active_options_only(spark):
    options = inputs.ride_options(spark).withColumn(
        "is_active", F.when(F.col("ride_option_id") == 2, False).when(F.col("ride_option_id") > 2, True))
    extra = options.where("ride_option_id = 1").withColumn("ride_option_id", F.lit(7))
    got = audits.with_option_rules(options.unionByName(extra))
    by_id = {r.ride_option_id: r for r in got.collect()}
    assert set(by_id) == {1, 3, 4, 5, 6, 7}  # a missing flag counts as active
    assert by_id[7].distance_weights == {} and by_id[7].min_passengers_ratio == 0.0
    assert by_id[6].distance_weights["cross_country"] == 90
    long = audits.weights_long(got)
    assert long.count() == 25
    rides = silver.conform(make(spark, {}, {"ride_id": "R2", "ride_option_id": 6}))
    assert [r.ride_id for r in audits.unsuitable_options(rides, long).collect()] == ["R2"]


@pytest.mark.parametrize("address,problem", [
    ({"road": "Rama IV", "country_code": "th", "ISO3166-2-lvl4": "TH-10"}, None),
    ({"country": "Thailand", "country_code": "th", "ISO3166-2-lvl4": "TH-10"}, "not_on_land"),
    ({"road": "x", "country_code": "la", "ISO3166-2-lvl4": "TH-10"}, "other_country"),
    ({"road": "x", "country_code": "th", "ISO3166-2-lvl4": "TH-11"}, "other_province"),
    ({"road": "x"}, "other_country"),
    (None, "not_on_land"),
])
def test_locations(spark, address, problem):
    df = spark.createDataFrame([(address, "TH-10")], "address map<string,string>, province_id string")
    assert [r.rule_id for r in audits.location_problems(df).collect()] == ([problem] if problem else [])


def test_bands_take_the_first_match(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 5.1, 15.0, 80.0, 250.0, 251.0, 1e9, None)], "km double")
    tiers = [r[0] for r in df.select(band(F.col("km"), DISTANCE_TIERS)).collect()]
    assert tiers == ["city_short", "city_short", "city_medium", "city_medium", "suburban", "regional",
                     "cross_country", "cross_country", None]
    assert df.select(band(F.col("km"), TRIP_CATEGORIES)).first()[0] == "medium"


def test_distance_of_known_places(spark):
    # Bangkok to Chiang Mai is about 587 km as the crow flies.
    km = spark.range(1).select(great_circle_km(F.lit(13.7563), F.lit(100.5018), F.lit(18.7883), F.lit(98.9853)))
    assert abs(km.first()[0] - 583) < 5


def test_conform_types_and_hashes(spark):
    got = silver.conform(make(spark, {}, {"ride_id": "R2", "pickup_timestamp": "", "dropoff_timestamp": "nonsense"}))
    rows = {r.ride_id: r for r in got.collect()}
    assert rows["R1"].booker_name == hashlib.sha256(b"Somchai").hexdigest()
    assert rows["R1"].driver_name is None and rows["R1"].pickup_address is None
    assert rows["R2"].pickup_timestamp is None and rows["R2"].dropoff_timestamp is None
    assert dict(got.dtypes)["booking_timestamp"] == "timestamp"
    peppered = silver.conform(make(spark, {}), pepper="p").first()
    assert peppered.booker_name == hashlib.sha256(b"pSomchai").hexdigest()


def test_latest_value_wins_in_dimensions_and_fact(spark):
    rows = make(spark, {}, {"ride_id": "R2", "booker_name": "New", "booking_timestamp": "2026-02-01T00:00:00"},
                {"ride_id": "R1", "rating": 5})
    early, late = (datetime(2026, 3, d, tzinfo=timezone.utc) for d in (1, 2))
    got = silver.conform(rows, F.when(F.col("rating") == 5, F.lit(late)).otherwise(F.lit(early)))
    booker = gold.person_dim(got, "dim_booker").collect()
    assert [(r.booker_id, r.booker_name) for r in booker] == [("B1", hashlib.sha256(b"New").hexdigest())]
    fact = gold.fact_rides(got)
    assert fact.columns == [*FACT, "booking_date", "booking_hour"]
    assert {r.ride_id: r.rating for r in fact.collect()} == {"R1": 5, "R2": 4}
    assert gold.person_dim(got, "dim_driver").count() == gold.person_dim(got, "dim_vehicle").count() == 1


def test_fact_is_pruned_by_month(spark, tmp_path):
    rows = make(spark, {}, {"ride_id": "R2", "booking_timestamp": "2026-02-01T00:00:00"})
    gold.write_fact(gold.fact_rides(silver.conform(rows)), str(tmp_path / "fact"))
    df = spark.read.parquet(str(tmp_path / "fact")).where("booking_month = '2026-02'").select("ride_id")
    assert "PartitionFilters: [isnotnull(booking_month" in df._jdf.queryExecution().toString()
    assert [r.ride_id for r in df.collect()] == ["R2"]


def test_growth_counts_new_bookers_once(spark):
    rows = make(spark, {}, {"ride_id": "R2", "booking_timestamp": "2026-02-01T00:00:00"},
                {"ride_id": "R3", "booking_timestamp": "2026-02-02T00:00:00", "booker_id": "B2"},
                GONE | {"ride_id": "R4", "booking_timestamp": "2026-02-03T00:00:00"})
    got = marts.growth_monthly(gold.fact_rides(silver.conform(rows))).orderBy("month").collect()
    assert [(r.rides, r.completed_rides, r.active_bookers, r.new_bookers, r.rides_change, r.running_revenue)
            for r in got] == [(1, 1, 1, 1, None, 231.0), (3, 2, 2, 1, 2, 693.0)]
