"""Tables of the catalog in buckets of their key: joins and upserts leave the stored side where it lies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.latest import _as_list, latest


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def save_bucketed(df: DataFrame, name: str, keys: str | Sequence[str], buckets: int, path: str | None = None) -> None:
    """`df` as table `name`, one sorted file per bucket: rows are shuffled by the function that buckets use.

    Meant for tables with about one row per key (upserted facts, SCD 1 dimensions); a key with very many rows would fill one
    bucket, so such tables are better left without. `path` makes an external table outside the warehouse.
    """
    keys = _as_list(keys)
    writer = (df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("compression", "zstd")
              .bucketBy(buckets, *keys).sortBy(*keys))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def merged(stored: DataFrame, arriving: DataFrame, keys: str | Sequence[str], sequence: str | Sequence[str]) -> DataFrame:
    """SCD 1 rows of `stored` (one per key) after `arriving`: as `upsert`, but only the arriving rows are shuffled.

    Of two rows the one with the higher sequence stays, a null one is lowest; between equal ones the other columns decide,
    so the result does not depend on the order of loads. Rows with a null in a key meet nothing in a join and are upserted
    by themselves.
    """
    keys, sequence = _as_list(keys), _as_list(sequence)
    columns = stored.columns
    order = [*sequence, *[c for c in columns if c not in keys and c not in sequence]]
    without = reduce(or_, [F.col(f"`{k}`").isNull() for k in keys])
    new = latest(arriving.select(*columns).where(~without), keys, sequence, order[len(sequence):])
    old, fresh = stored.where(~without).alias("old"), new.alias("new")
    both = old.join(fresh, reduce(and_, [F.col(f"old.`{k}`") == F.col(f"new.`{k}`") for k in keys]), "full_outer")
    # Structs compare field by field with null lowest, as the descending order with nulls last does.
    rank = lambda side: F.struct(*[F.col(f"{side}.`{c}`") for c in order])
    there = lambda side: F.col(f"{side}.`{keys[0]}`").isNotNull()
    take_new = there("new") & (~there("old") | (rank("new") > rank("old")))
    known = both.select(*[F.when(take_new, F.col(f"new.`{c}`")).otherwise(F.col(f"old.`{c}`")).alias(c) for c in columns])
    keyless = latest(stored.where(without).unionByName(arriving.select(*columns).where(without)), keys, sequence,
                     order[len(sequence):])
    return known.unionByName(keyless)


def upsert_bucketed(arriving: DataFrame, name: str, keys: str | Sequence[str], sequence: str | Sequence[str], buckets: int,
                    path: str) -> DataFrame:
    """Upsert `arriving` into the table `name` and give the table back. The new state goes to `path`, a folder of its own.

    The new table gets the name after all its files are there; a run that died in between is taken up again. The old folder
    stays for readers that began with it.
    """
    spark = arriving.sparkSession
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(f"{name}_next"):
        spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
    stored = table_or_none(spark, name)
    state = latest(arriving, keys, sequence) if stored is None else merged(stored, arriving, keys, sequence)
    save_bucketed(state, f"{name}_next", keys, buckets, path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {name}_next RENAME TO {name}")
    return spark.table(name)
