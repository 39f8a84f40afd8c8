"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.text import SPACE, column, free_names, words, written

#: About so many documents stand in one range of the order.
ROWS_PER_SLICE = 100_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Target of each source: shares of the total by weight, none above `most` times its size.

    `sizes` has `source`, `source_size` (one row per source). Weights go round the sources by code point, null
    last. Raising one common level until the targets fill the total gives what repeated resharing converges to:
    sources reach their cap in the order of cap over weight, so the capped ones are a prefix of that order and the
    level is (total - their caps) / (weight of the rest). Sums are of whole numbers, exact in any order.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("_i", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    # compares cap / weight by whole numbers: scaled to the product of all weights
    scale = 1
    for w in set(weights):
        scale *= w
    by_ratio = every.orderBy((F.col("_cap") * F.floor(F.lit(scale) / F.col("_w"))).asc(), F.col("_i").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double")
             / F.sum("_w").over(rest).cast("double"))
    leveled = ranked.withColumn("_level", level)
    fits = F.when(F.col("_cap").cast("double") >= F.col("_level") * F.col("_w"), F.col("_level"))
    lowest = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding,
                                                                       Window.unboundedFollowing))
    target = F.least(F.col("_cap").cast("double"), lowest * F.col("_w"))
    return leveled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """The one random number of a source in [0, 1): the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0001"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 17,
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """How often each document enters the mix: `doc_id`, `source`, `size`, `source_size`, `target`, `copies`.

    A document of a source is expected target / source_size times. Within its source, documents stand in the order
    of falling size; their expected copies are summed along it, one random offset is added, and a document is
    emitted once for every whole number that its own share of the sum crosses. So no document is taken more than
    `most` times, and a source misses its target by about one large document at most.

    Documents of equal size stand by doc_id, null last, then by text, however many they are. The place in the order
    needs no task that sees a whole source: the order is cut into ranges of about `rows_per_slice` rows anywhere, also
    within one size or id, and the counts per range and source give where each begins. Null text has size 0; null
    sources are one source; rows with equal ids are separate documents; no rows give no rows. A source without words
    has target 0.
    """
    base = written(docs.select("doc_id", "source", _text_hash(docs).alias("_text"),
                               F.size(words(docs["text"], SPACE)).cast("long").alias("size"),
                               F.monotonically_increasing_id().alias("_row")), "mix-sizes")
    targets = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)

    # the number of a row tells equal rows apart, so that no value is too frequent for one range
    order = [F.col("source"), F.col("size").desc(), F.col("doc_id").asc_nulls_last(), F.col("_text"), F.col("_row")]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-base.count() // rows_per_slice))
    # rows of a range are numbered one by one in the order, so those of one source in it have numbers without gaps
    ordered = written(base.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select(
        "doc_id", "source", "size", "_text", F.monotonically_increasing_id().alias("_at")), "mix-order")
    ordered = ordered.withColumn("_slice", F.shiftright("_at", 33))
    in_order = Window.partitionBy("source").orderBy("_slice")
    starts = ordered.groupBy("source", "_slice").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    targets = targets.withColumnRenamed("source", "_source")
    starts = starts.join(targets, F.expr("source <=> _source")).select(
        F.col("source").alias("_source"), F.col("_slice").alias("_part"), "_before", "_first", "source_size", "target")

    placed = ordered.join(starts, F.expr("source <=> _source AND _slice = _part")).select(
        "doc_id", "source", "size", "_text", "source_size", "target",
        (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_place"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    up_to = lambda place: F.floor(place * share + _offset(F.col("source"), seed))
    copies = F.least(up_to(F.col("_place")) - up_to(F.col("_place") - 1), F.lit(most))
    return placed.select("doc_id", "source", "_text", "size", "source_size", "target",
                         copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as `plan_mix` says, in a last column `copy` the number of the copy.

    Equal rows (same id, source and text) are told apart by a number among themselves, so each keeps its own plan.
    """
    copies, tie, text, size, copy = free_names(docs, "_copies", "_tie", "_text", "_size", "copy")
    plan = plan_mix(docs, **options)
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_text").alias("_hash")).agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias(copies))
    here = docs.withColumn(text, _text_hash(docs)).withColumn(
        tie, F.row_number().over(Window.partitionBy("doc_id", "source", text).orderBy(text)))
    out = here.join(plan, here["doc_id"].eqNullSafe(plan["_id"]) & here["source"].eqNullSafe(plan["_source"])
                    & (here[text] == plan["_hash"]))
    mine = F.element_at(F.col(copies), F.col(tie))
    return out.where(mine > 0).select(*[column(here, c) for c in docs.columns],
                                      F.explode(F.sequence(F.lit(1), mine)).alias(copy))


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))
