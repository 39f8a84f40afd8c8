"""Exact quantiles per group from histograms that merge: no group is sorted as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripmart.operators.sizing import settled

#: Buckets of a histogram, and rows of a bucket that a task may order to pick the value.
BUCKETS = 1024
ROWS_TO_ORDER = 1_000_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], fractions: Sequence[float],
                    buckets: int = BUCKETS, rows_to_order: int = ROWS_TO_ORDER) -> DataFrame:
    """`keys`, `measure`, `fraction`, `n`, `value`: for each group and column the smallest value with at least that share of
    the group's values at or below it. Values are doubles; nulls and NaN are left out, groups without values give no row.

    Each round counts the values of the interval in question in `buckets` equal parts (combined before the shuffle) and
    goes on with the part that holds the wanted rank, between its own smallest and largest value. So intervals shrink in
    every round, also for very uneven values. An interval of one value is the answer; one of at most `rows_to_order` rows is
    ordered. Rounds depend on the spread of the values, not on their number; two are usual.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("_v")) for c in columns]))
    values = df.select(*keys, pairs.alias("_p")).select(*keys, "_p.measure", "_p._v").where("_v IS NOT NULL AND NOT isnan(_v)")
    group = [*keys, "measure"]
    spans = values.groupBy(*group).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = spans.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn(
        "_rank", F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") - F.col("fraction") * F.col("n"))).cast("long"))
    open_ = settled(wanted.withColumn("_rows", F.col("n")))
    done = []
    while True:
        found = open_.where("_low = _high")
        done.append(found.select(*keys, "measure", "fraction", "n", F.col("_low").alias("value")))
        few = open_.where((F.col("_low") < F.col("_high")) & (F.col("_rows") <= rows_to_order))
        done.append(_ordered(values, few, keys))
        many = open_.where((F.col("_low") < F.col("_high")) & (F.col("_rows") > rows_to_order))
        if many.isEmpty():
            return reduce(DataFrame.unionByName, done)
        open_ = settled(_narrowed(values, many, keys, buckets))


def _inside(values: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values of the intervals, once per fraction asked for. Groups are met as a whole: null is a key like any other."""
    sides = intervals.select(*[F.col(c).alias(f"_i_{c}") for c in [*keys, "measure"]], "fraction", "n", "_rank", "_low", "_high")
    same = reduce(and_, [values[c].eqNullSafe(sides[f"_i_{c}"]) for c in [*keys, "measure"]])
    return values.join(sides, same & values["_v"].between(sides["_low"], sides["_high"]))


def _narrowed(values: DataFrame, intervals: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    # halves keep differences of very large values finite
    place = (F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    bucket = F.least(F.floor(place * buckets), F.lit(buckets - 1)).alias("_bucket")
    group = [*keys, "measure", "fraction"]
    counted = _inside(values, intervals, keys).groupBy(*group, "n", "_rank", bucket).agg(
        F.count("*").alias("_rows"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    upto = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_bucket"))
    return counted.withColumn("_upto", upto).where("_rank <= _upto AND _rank > _upto - _rows").select(
        *group, "n", (F.col("_rank") - (F.col("_upto") - F.col("_rows"))).alias("_rank"), "_rows", "_low", "_high")


def _ordered(values: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    along = Window.partitionBy(*keys, "measure", "fraction").orderBy("_v")
    return _inside(values, intervals, keys).withColumn("_at", F.row_number().over(along)).where("_at = _rank").select(
        *keys, "measure", "fraction", "n", F.col("_v").alias("value"))
