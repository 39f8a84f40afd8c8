"""The whole lakehouse brought up to date: bronze, silver and gold under one root folder.

Each step takes only what is new since the last refresh (manifest, content hashes, stream checkpoints), and each
can be repeated, so a refresh that died is simply run again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.functions.columns import calendar
from tripmart.plans import bronze, gold
from tripmart.plans.silver import INGESTED_AT
from tripmart.schemas import FACT, SCD1_DIMS, SCD2_DIMS, STATIC_DIMS
from tripmart.sources.files import read_table
from tripmart.streaming import keyed
from tripmart.streaming.rides import land_messages, silver_stream, unite_feeds, write_batch, write_silver
from tripmart.streaming.runs import per_batch, start


LOAD = "load"


def refresh(spark: SparkSession, root: str, landing: str, mapping: str | None, loaded_at: datetime,
            live: DataFrame | None = None, json_lines: bool = False, pepper: str = "") -> None:
    """Load pending files, changed reference rows and new messages; carry them through to the gold tables.

    Each feed has a query and a checkpoint of its own, so feeds may come and go between refreshes. Messages are landed as
    they came, and silver reads the landed ones. Historical rows reach silver by their manifest: only loads that it names.
    """
    rides, manifest = f"{root}/bronze/historical_rides", f"{root}/bronze/historical_rides_manifest"
    bronze.load_historical(spark, landing, rides, manifest, loaded_at, json_lines=json_lines)
    if mapping:
        bronze.load_references(spark, mapping, f"{root}/bronze", loaded_at)

    silver = f"{root}/silver/rides"
    raw = f"{root}/bronze/live_messages"
    if live is not None:
        _run(land_messages(live, raw), root, "live_messages")
    if read_table(spark, raw) is not None:
        landed = spark.readStream.schema(spark.read.parquet(raw).schema).parquet(raw)
        _run(write_silver(unite_feeds(landed, pepper=pepper), f"{silver}/feed=live"), root, "silver_live")
    if read_table(spark, manifest) is not None:
        named = spark.readStream.schema(bronze.read_manifest(spark, manifest).schema).parquet(manifest)
        _run(per_batch(named, lambda loads, number: _named_loads(loads, rides, f"{silver}/feed=historical", number, pepper)),
             root, "silver_historical")
    if read_table(spark, silver) is not None:
        for name, columns in SCD1_DIMS.items():
            _keep(spark, root, name, columns)
        _keep(spark, root, "fact_rides", FACT)
    if mapping:
        for name, table in STATIC_DIMS.items():
            write_load(gold.static_dim(bronze.reference_log(spark, f"{root}/bronze", table), name), f"{root}/gold/{name}", loaded_at)
        for name, (table, _) in SCD2_DIMS.items():
            write_load(gold.versioned_dim(bronze.reference_log(spark, f"{root}/bronze", table), name), f"{root}/gold/{name}",
                       loaded_at)


def _named_loads(loads: DataFrame, rides: str, silver: str, number: int, pepper: str) -> None:
    """The rows of the loads that a batch of manifest rows names. Their folders are read, not the whole table."""
    spark = loads.sparkSession
    # one id per load
    folders = [f"{rides}/load_id={r.load_id}" for r in loads.select("load_id").distinct().collect()]
    if folders:
        rows = spark.read.option("basePath", rides).option("mergeSchema", True).parquet(*folders)
        write_batch(unite_feeds(None, rows, pepper=pepper), silver, number)


def write_load(df: DataFrame, path: str, loaded_at: datetime) -> None:
    """A dimension as a whole in the partition of its load; a repeated load replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/{LOAD}={loaded_at.strftime('%Y%m%d%H%M%S%f')[:-3]}")  # milliseconds: a long


def read_load(spark: SparkSession, path: str) -> DataFrame:
    """The newest load. The choice is one number, and the condition on it prunes the other loads."""
    loads = spark.read.parquet(path)
    newest = loads.agg(F.max(LOAD)).first()[0]
    return loads.where(F.col(LOAD) == newest).drop(LOAD)


def _run(writer, root: str, name: str) -> None:
    start(writer, f"{root}/checkpoints/{name}").awaitTermination()


def _keep(spark: SparkSession, root: str, name: str, columns: list[str]) -> None:
    wanted = list(dict.fromkeys([*columns, *gold.SEQUENCE]))
    rows = silver_stream(spark, f"{root}/silver/rides").select(*wanted)
    _run(keyed.upsert_stream(rows, f"{root}/gold/{name}", columns[0], gold.SEQUENCE), root, name)


def read_gold(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A gold table as reports use it."""
    if name in SCD1_DIMS or name == "fact_rides":
        key = FACT[0] if name == "fact_rides" else SCD1_DIMS[name][0]
        rows = keyed.read_upserted(spark, f"{root}/gold/{name}", key, gold.SEQUENCE)
        if name == "fact_rides":
            return rows.select(*FACT, *calendar())
        return rows.drop(INGESTED_AT)
    return read_load(spark, f"{root}/gold/{name}")
