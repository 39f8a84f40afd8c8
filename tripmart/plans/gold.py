"""Gold: eight dimensions and the ride fact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.functions.columns import calendar
from tripmart.operators.asof import asof_join
from tripmart.operators.changes import latest_snapshot
from tripmart.operators.history import history
from tripmart.operators.joins import Dim, star_join
from tripmart.operators.latest import latest
from tripmart.operators.sizing import small_side
from tripmart.plans.silver import INGESTED_AT
from tripmart.schemas import FACT, REFERENCE, SCD1_DIMS, SCD2_DIMS, STATIC_DIMS

SEQUENCE = ["booking_timestamp", INGESTED_AT]

#: Persons or vehicles whose labels are broadcast to the rides: a key and one hash each, about 100 MB in a task's memory.
LABEL_ROWS = 500_000


def person_dim(silver: DataFrame, name: str) -> DataFrame:
    """SCD 1 dimension of the rides: the values of each key's newest booking."""
    columns = SCD1_DIMS[name]
    return latest(silver.select(*columns, *SEQUENCE), columns[0], SEQUENCE).drop(INGESTED_AT)


def static_dim(log: DataFrame, name: str) -> DataFrame:
    """Reference dimension without history: the latest snapshot, one row per key."""
    return latest_snapshot(log, REFERENCE[STATIC_DIMS[name]].fieldNames()[0])


def versioned_dim(log: DataFrame, name: str) -> DataFrame:
    """SCD 2 reference dimension; `__START_AT` is the load time of the change."""
    table, tracked = SCD2_DIMS[name]
    columns = REFERENCE[table].fieldNames()
    return history(log.select(*columns, "loaded_at"), columns[0], "loaded_at", tracked)


def fact_rides(silver: DataFrame) -> DataFrame:
    """One row per ride with booking date and hour. Rows without a ride id are none (`silver.split_unidentified`).

    A corrected ride keeps its booking time, so load time decides between equal booking times.
    """
    newest = latest(silver.select(*FACT, INGESTED_AT).where(F.col("ride_id").isNotNull()), "ride_id", SEQUENCE)
    return newest.select(*FACT, *calendar())


def write_fact(fact: DataFrame, path: str) -> None:
    """The fact in one folder per booking month, so that reports read only the months they ask for.

    The rebalance hint lets AQE split a month that holds most rows and merge small ones.
    """
    (fact.withColumn("booking_month", F.date_format("booking_date", "yyyy-MM"))
     .hint("rebalance", F.col("booking_month"))
     .write.mode("overwrite").partitionBy("booking_month").parquet(path))


def ride_star(fact: DataFrame, dims: dict[str, DataFrame], before_first: str = "earliest") -> DataFrame:
    """The fact with the labels of all dimensions; options and payment methods as valid at booking time.

    Each dimension that is joined by shuffle moves the whole fact once more, and stored hashes pass Spark's threshold early.
    So persons and vehicles are broadcast up to LABEL_ROWS, which a bounded count proves.
    """
    persons = {name: small_side(dims[name], LABEL_ROWS) for name in SCD1_DIMS}
    wide = star_join(fact, [
        Dim(persons["dim_booker"], "booker_id", "booker_id", ["booker_name"]),
        Dim(persons["dim_driver"], "driver_id", "driver_id", ["driver_name"]),
        Dim(persons["dim_vehicle"], "vehicle_id", "vehicle_id", ["vehicle_license_plate"]),
        Dim(dims["dim_province"], "pickup_city_id", "province_id", ["province_name"], "pickup_"),
        Dim(dims["dim_province"], "dropoff_city_id", "province_id", ["province_name"], "dropoff_"),
        Dim(dims["dim_ride_status"], "ride_status_id", "ride_status_id", ["ride_status"]),
        Dim(dims["dim_cancellation_reason"], "cancellation_reason_id", "cancellation_reason_id",
            ["initiator", "cancellation_reason"]),
    ])
    wide = asof_join(wide, dims["dim_ride_option"], "ride_option_id", "booking_timestamp",
                     ["ride_option_name", "vehicle_class"], before_first=before_first)
    return asof_join(wide, dims["dim_payment_method"], "payment_method_id", "booking_timestamp",
                     ["payment_method", "is_card"], before_first=before_first)
