"""SCD 2: versions with `__START_AT` / `__END_AT` from a change log.

A version begins where a tracked column differs from the row before; a change in other columns only
replaces the values of the version it falls in. The result depends on the sequence column alone, never on
the order of arrival.

A key with very many rows is not sorted in one task: its log is cut into ranges of about equal size, each range
is reduced to runs of equal tracked values by itself, and only the first and last run of a range (two rows)
take part in the joining step per key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tripmart.operators.latest import _as_list, latest, total_order
from tripmart.operators.sizing import ROWS_PER_CHUNK, in_chunks, small_side

START, END = "__START_AT", "__END_AT"


def history(log: DataFrame, keys: str | Sequence[str], sequence: str, tracked: Sequence[str],
            tiebreak: Sequence[str] | None = None,
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """All versions of every key in `log`.

    Of several rows with the same key and sequence the last by `tiebreak` (default: all columns) counts.
    """
    keys = _as_list(keys)
    # Copies of one row may be the reason for a hot key; of ties each task keeps one before the shuffle.
    one_each = lambda rows: latest(rows, [*keys, sequence], [], total_order(log, keys, [sequence], tiebreak))
    rest, hot = in_chunks(log, keys, [F.col(sequence).asc_nulls_first()], rows_per_chunk, one_each)
    along = F.col(sequence).asc_nulls_first()
    whole = _runs(_drop_ties(rest, keys, sequence, tiebreak), Window.partitionBy(*keys).orderBy(along), sequence,
                  tracked).select(*log.columns, START, END)
    if hot is None:
        return whole
    runs = _runs(hot, Window.partitionBy(*keys, "_chunk").orderBy(along), sequence, tracked)
    middle = runs.where(~F.col("_first") & ~F.col("_last")).select(*log.columns, START, END)
    edges = runs.where(F.col("_first") | F.col("_last"))
    return whole.unionByName(middle).unionByName(_join_edges(edges, keys, tracked).select(*log.columns, START, END))


def _drop_ties(log: DataFrame, keys: Sequence[str], sequence: str,
               tiebreak: Sequence[str] | None) -> DataFrame:
    order = [F.col(f"`{c}`").asc_nulls_first() for c in total_order(log, keys, [sequence], tiebreak)]
    following = F.lead(F.struct(sequence)).over(Window.partitionBy(*keys).orderBy(*order))
    return (log.withColumn("_following", following)
            .where(~F.col("_following").eqNullSafe(F.struct(sequence))).drop("_following"))


def _state(tracked: Sequence[str]) -> Column:
    return F.struct(*tracked)


def _runs(rows: DataFrame, window: WindowSpec, sequence: str, tracked: Sequence[str]) -> DataFrame:
    """Last row of each run of equal tracked values, with the run's start and the next run's start.

    All expressions use one window, hence one shuffle and one sort.
    """
    state = _state(tracked)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows
        .withColumn("_before", F.lag(state).over(window))
        .withColumn("_after", F.lead(state).over(window))
        .withColumn("_next", F.lead(sequence).over(window))
        .withColumn("_opens", F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state))
        .withColumn("_opened", F.last(F.when(F.col("_opens"), F.struct(F.col(sequence).alias("at"),
                                                                      F.col("_before").isNull().alias("first"))),
                                      ignorenulls=True).over(running))
        .where(F.col("_after").isNull() | ~F.col("_after").eqNullSafe(state))
        .withColumn("_last", F.col("_after").isNull())
        .withColumn("_first", F.col("_opened.first"))
        .withColumn(START, F.col("_opened.at"))
        .withColumn(END, F.col("_next"))
        .drop("_before", "_after", "_next", "_opens", "_opened")
    )


def _join_edges(edges: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Join runs that go on across chunk borders and give each its end."""
    window = Window.partitionBy(*keys).orderBy("_chunk", F.col(START).asc_nulls_first())
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = _state(tracked)
    before = F.lag(state).over(window)
    return (
        edges
        .withColumn("_goes_on", F.col("_first") & before.isNotNull() & before.eqNullSafe(state))
        .withColumn("_continued", F.coalesce(F.lead("_goes_on").over(window), F.lit(False)))
        .withColumn("_opened", F.last(F.when(~F.col("_goes_on"), F.struct(F.col(START).alias("at"))),
                                      ignorenulls=True).over(running))
        .withColumn("_ends", F.coalesce(F.col(END), F.lead(START).over(window)))
        .where(~F.col("_continued"))
        .withColumn(START, F.col("_opened.at"))
        .withColumn(END, F.col("_ends"))
    )


def rebuild_touched(versions: DataFrame, log: DataFrame, arriving: DataFrame, keys: str | Sequence[str],
                    sequence: str, tracked: Sequence[str], **options) -> DataFrame:
    """SCD 2 state after `arriving`, which is already part of `log`.

    A late row can split or join old versions, so each touched key is computed again from its whole log;
    all other versions stay. Few touched keys are broadcast, so that the log is filtered where it lies.
    """
    keys = _as_list(keys)
    touched = small_side(arriving.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)]).distinct())

    def same(df: DataFrame) -> Column:  # null is a key like any other
        return reduce(and_, [df[k].eqNullSafe(touched[f"_t{i}"]) for i, k in enumerate(keys)])

    kept = versions.join(touched, same(versions), "left_anti")
    renewed = history(log.join(touched, same(log), "left_semi"), keys, sequence, tracked, **options)
    return kept.unionByName(renewed)
