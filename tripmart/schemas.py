"""Table schemas. The ride schema is declared once and shared by every feed."""

from pyspark.sql import types as T


def _schema(columns: str) -> T.StructType:
    """Schema from "name type, ..." for simple types; needs no session, unlike a DDL string."""
    schema = T.StructType()
    for column in columns.split(","):
        name, kind = column.split()
        schema.add(name, {"int": "integer", "bigint": "long"}.get(kind, kind))
    return schema


# Names, order and types of the ride record and of the tables around it.
RIDE = _schema("""
    ride_id string, booker_id string, driver_id string, vehicle_id string,
    ride_status_id int, pickup_city_id string, dropoff_city_id string,
    ride_option_id int, payment_method_id int, booking_timestamp string,
    pickup_latitude double, pickup_longitude double, pickup_address string,
    dropoff_latitude double, dropoff_longitude double, dropoff_address string,
    booker_name string, booker_email string, booker_phone string,
    driver_name string, driver_phone string, driver_license string,
    vehicle_license_plate string, cancellation_reason_id int,
    travel_distance_km double, duration_minutes int, passenger_count int,
    pickup_timestamp string, dropoff_timestamp string,
    driver_rating double, rating int,
    base_fare double, distance_fare double, time_fare double,
    surge_multiplier double, subtotal double, tip_amount double, total_fare double
""")

MANIFEST = T.StructType([
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_name", T.StringType(), False),
    T.StructField("file_size", T.LongType(), True),
    T.StructField("record_count", T.LongType(), False),
    T.StructField("loaded_at", T.TimestampType(), False),
])

# One message of the live feed, as the Kafka source delivers it.
ENVELOPE = _schema("""
    key binary, value binary, topic string, partition int, offset bigint,
    timestamp timestamp, timestampType int
""").add("headers", T.ArrayType(_schema("key string, value binary")))

# Reference tables before `loaded_at` is stamped; the key is the first column of each.
REFERENCE = {
    "map_provinces": _schema("province_id string, province_name string"),
    "map_payment_methods": _schema(
        "payment_method_id int, payment_method string, is_card boolean, requires_auth boolean,"
        " is_active boolean, retired_at string"),
    "map_ride_options": _schema(
        "ride_option_id int, ride_option_name string, vehicle_class string, passenger_capacity int,"
        " base_rate double, per_km double, per_minute double, is_active boolean, retired_at string"),
    "map_ride_statuses": _schema("ride_status_id int, ride_status string"),
    "map_cancellation_reasons": _schema(
        "cancellation_reason_id int, initiator string, cancellation_reason string"),
}


def reference_key(table: str) -> str:
    return REFERENCE[table].fieldNames()[0]


TIMESTAMPS = ["booking_timestamp", "pickup_timestamp", "dropoff_timestamp"]

PII = ["booker_name", "booker_email", "booker_phone", "driver_name", "driver_phone",
       "driver_license", "vehicle_license_plate"]

FACT_KEYS = ["ride_id", "booker_id", "driver_id", "vehicle_id", "pickup_city_id", "dropoff_city_id",
             "ride_option_id", "payment_method_id", "ride_status_id", "cancellation_reason_id"]

FACT_MEASURES = ["pickup_latitude", "pickup_longitude", "dropoff_latitude", "dropoff_longitude",
                 "travel_distance_km", "duration_minutes", "passenger_count", "base_fare",
                 "distance_fare", "time_fare", "surge_multiplier", "subtotal", "tip_amount",
                 "total_fare", "driver_rating", "rating"]

FACT = FACT_KEYS + TIMESTAMPS + FACT_MEASURES

# SCD 1 dimensions drawn from the rides, and SCD 2 dimensions drawn from reference tables.
SCD1_DIMS = {
    "dim_booker": ["booker_id", "booker_name", "booker_email", "booker_phone"],
    "dim_driver": ["driver_id", "driver_name", "driver_phone", "driver_license"],
    "dim_vehicle": ["vehicle_id", "vehicle_license_plate"],
}
STATIC_DIMS = {
    "dim_province": "map_provinces",
    "dim_ride_status": "map_ride_statuses",
    "dim_cancellation_reason": "map_cancellation_reasons",
}
SCD2_DIMS = {
    "dim_ride_option": ("map_ride_options", ["ride_option_name", "is_active", "retired_at"]),
    "dim_payment_method": ("map_payment_methods", ["payment_method", "is_active", "retired_at"]),
}
