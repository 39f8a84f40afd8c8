"""Reporting marts over the ride fact: growth, cancellation, service quality, geography, revenue.

Each reads only the fact columns it needs and aggregates with map-side combine, so hot bookers, provinces or
options are reduced before the shuffle. Windows without partition run on aggregated rows only (months,
provinces, options), whose number does not grow with the data. Money is summed as decimal, so results do not
depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.functions.columns import sum_money
from tripmart.rules import CANCELLED, COMPLETED

PAYMENT_METHOD_IDS = [1, 2, 3, 4, 5]
RATINGS = [1, 2, 3, 4, 5]


def is_completed() -> Column:
    return F.col("ride_status_id") == COMPLETED


def is_cancelled() -> Column:
    return F.col("ride_status_id") == CANCELLED


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _rides() -> Column:
    return F.count("*").alias("rides")


def growth_monthly(fact: DataFrame) -> DataFrame:
    """Per month: rides, completed rides, revenue, active and new bookers, change to the month before, running revenue."""
    month = F.trunc("booking_date", "MM").alias("month")
    per_booker = (
        fact.groupBy("booker_id", month)
        .agg(_rides(), F.count_if(is_completed()).alias("completed"),
             F.sum(F.col("total_fare").cast("decimal(18,2)")).alias("revenue"))
        .withColumn("_first", F.min("month").over(Window.partitionBy("booker_id")))
    )
    monthly = per_booker.groupBy("month").agg(
        F.sum("rides").alias("rides"), F.sum("completed").alias("completed_rides"),
        F.sum("revenue").alias("_revenue"), F.count("booker_id").alias("active_bookers"),
        F.count_if(F.col("booker_id").isNotNull() & (F.col("_first") == F.col("month"))).alias("new_bookers"))
    order = Window.orderBy("month")
    before = F.lag("rides").over(order)
    return monthly.select(
        "month", "rides", "completed_rides", F.col("_revenue").cast("double").alias("revenue"),
        "active_bookers", "new_bookers", (F.col("rides") - before).alias("rides_change"),
        _share(F.col("rides") - before, before).alias("rides_change_rate"),
        F.sum("_revenue").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("double")
        .alias("running_revenue"))


def hourly_demand(fact: DataFrame) -> DataFrame:
    """Rides and surge share per booking date and hour."""
    surged = F.count_if(F.col("surge_multiplier") > 1.0)
    return fact.groupBy("booking_date", "booking_hour").agg(
        _rides(), surged.alias("surge_rides"), _share(surged, F.count("*")).alias("surge_share"))


def demand_rollup(fact: DataFrame) -> DataFrame:
    """Rides per date and hour with totals per date and overall; `level` counts the rolled-up columns."""
    return (fact.rollup("booking_date", "booking_hour")
            .agg(_rides(), sum_money("total_fare").alias("revenue"), F.grouping_id().alias("_g"))
            .withColumn("level", F.bit_count("_g").cast("int")).drop("_g"))


def cancel_rate(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rides, cancelled rides and their share per group, for example hour, province or option."""
    return fact.groupBy(*by).agg(
        _rides(), F.count_if(is_cancelled()).alias("cancelled_rides"),
        _share(F.count_if(is_cancelled()), F.count("*")).alias("cancel_rate"))


def cancel_reasons(fact: DataFrame, reasons: DataFrame) -> DataFrame:
    """Cancelled rides by initiator and reason, with all subtotals; `level` tells subtotals from missing labels.

    The rides are first counted per reason id, so only a handful of rows meets the labels and the cube.
    """
    per_id = fact.where(is_cancelled()).groupBy("cancellation_reason_id").agg(_rides())
    labelled = per_id.join(reasons, "cancellation_reason_id", "left")
    total = F.sum("rides")
    return (labelled.cube("initiator", "cancellation_reason")
            .agg(total.alias("rides"), F.grouping_id().cast("int").alias("level")))


def service_quality(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """Completed rides: mean ratings, median rating and one count per rating value."""
    counts = [F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in RATINGS]
    rated = F.count("rating")
    return (
        fact.where(is_completed()).groupBy(*by)
        .agg(_rides(), _share(F.sum("rating"), rated).alias("mean_rating"),
             _share(F.sum(F.col("driver_rating").cast("decimal(10,1)")), F.count("driver_rating"))
             .alias("mean_driver_rating"),
             F.percentile_approx("rating", 0.5).alias("median_rating"), *counts)
    )


def low_rated_drivers(fact: DataFrame, below: float = 3.0, min_rides: int = 1) -> DataFrame:
    """Drivers with at least `min_rides` rated rides and a mean rating below the bound."""
    return (
        fact.where(is_completed() & F.col("rating").isNotNull()).groupBy("driver_id")
        .agg(F.count("*").alias("rated_rides"), _share(F.sum("rating"), F.count("*")).alias("mean_rating"))
        .where((F.col("rated_rides") >= min_rides) & (F.col("mean_rating") < below))
    )


def province_rank(fact: DataFrame) -> DataFrame:
    """Pickup provinces by rides and revenue, with the average fare of completed rides."""
    revenue = sum_money("total_fare")
    by_province = fact.groupBy("pickup_city_id").agg(
        _rides(), revenue.alias("revenue"),
        _share(sum_money(F.when(is_completed(), F.col("total_fare"))), F.count_if(is_completed())).alias("average_fare"))
    return by_province.select(
        "*", F.dense_rank().over(Window.orderBy(F.desc("rides"))).alias("rides_rank"),
        F.dense_rank().over(Window.orderBy(F.desc("revenue"))).alias("revenue_rank"))


def top_provinces(fact: DataFrame, k: int = 10) -> DataFrame:
    """The `k` provinces with the highest revenue."""
    return province_rank(fact).orderBy(F.desc("revenue"), "pickup_city_id").limit(k)


def od_matrix(fact: DataFrame) -> DataFrame:
    """Rides per pickup and dropoff province with their share of all rides leaving the pickup province."""
    pairs = fact.groupBy("pickup_city_id", "dropoff_city_id").agg(
        _rides(), sum_money("total_fare").alias("revenue"))
    leaving = F.sum("rides").over(Window.partitionBy("pickup_city_id"))
    return pairs.select("*", (F.col("pickup_city_id") != F.col("dropoff_city_id")).alias("crosses"),
                        _share(F.col("rides"), leaving).alias("share_of_pickup"))


def cross_province_share(fact: DataFrame) -> DataFrame:
    """Share of rides that end in another province, per pickup province."""
    crosses = F.count_if(F.col("pickup_city_id") != F.col("dropoff_city_id"))
    return fact.groupBy("pickup_city_id").agg(
        _rides(), crosses.alias("cross_rides"), _share(crosses, F.count("*")).alias("cross_share"))


def option_revenue(fact: DataFrame, option: Sequence[str] = ("ride_option_id", "ride_option_name")) -> DataFrame:
    """Revenue per option version (labels as valid at booking), share of the total, tip rate."""
    per_option = fact.where(is_completed()).groupBy(*option).agg(
        _rides(), F.sum(F.col("total_fare").cast("decimal(18,2)")).alias("_revenue"),
        sum_money("tip_amount").alias("tips"), sum_money("subtotal").alias("_subtotal"))
    total = F.sum("_revenue").over(Window.partitionBy())
    return per_option.select(
        *option, "rides", F.col("_revenue").cast("double").alias("revenue"), "tips",
        _share(F.col("_revenue"), total).alias("revenue_share"),
        _share(F.col("tips"), F.col("_subtotal")).alias("tip_rate"))


def payment_mix(fact: DataFrame, by: str = "ride_option_id",
                methods: Sequence[int] = PAYMENT_METHOD_IDS) -> DataFrame:
    """Rides per option: one column per given payment method, `method_other` for any other or none, and `rides`."""
    paid = F.col("payment_method_id")
    known = F.coalesce(paid.isin(*methods), F.lit(False))
    return fact.groupBy(by).agg(*[F.count_if(paid == m).alias(f"method_{m}") for m in methods],
                                F.count_if(~known).alias("method_other"), _rides())


def fare_breakdown(fact: DataFrame, by: Sequence[str]) -> DataFrame:
    """What the fares are made of: base, distance, time, surge uplift, tips."""
    parts = {"base": "base_fare", "distance": "distance_fare", "time": "time_fare", "tips": "tip_amount",
             "total": "total_fare"}
    sums = [sum_money(c).alias(name) for name, c in parts.items()]
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    uplift = F.sum(dec("subtotal") - dec("base_fare") - dec("distance_fare") - dec("time_fare"))
    return fact.where(is_completed()).groupBy(*by).agg(_rides(), *sums, uplift.cast("double").alias("surge_uplift"))
