"""Bronze: historical files with a manifest, and reference tables as change logs.

A load writes its data into its own `load_id=` folder by overwrite and its manifest rows last. Readers take
only loads that the manifest names, so a load that died halfway is invisible and its repetition is harmless.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.operators.changes import LOADED_AT, detect_changes, not_loaded
from tripmart.operators.joins import union_feeds
from tripmart.schemas import REFERENCE, RIDE, reference_key
from tripmart.sources.files import (
    FILE_COLUMNS, SOURCE_PATH, count_per_file, file_format, list_files, manifest_schema, read_files, read_reference,
    read_table,
)

IDENTITY = ["file_path", "file_size", "modified_at"]


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    """Committed loads; empty before the first one."""
    schema = manifest_schema().add("load_id", "string")
    found = read_table(spark, manifest, schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_historical(spark: SparkSession, table: str, manifest: str) -> DataFrame | None:
    """Rows of committed loads. The load list is one row per load, so Spark broadcasts it by its size."""
    rows = read_table(spark, table)
    if rows is None:
        return None
    return rows.join(read_manifest(spark, manifest).select("load_id").distinct(), "load_id", "left_semi")


def pending_files(spark: SparkSession, landing: str, manifest: str) -> DataFrame:
    """Files in the landing folder that are new, or replaced since they were loaded."""
    return not_loaded(list_files(spark, landing), read_manifest(spark, manifest), IDENTITY)


def load_historical(spark: SparkSession, landing: str, table: str, manifest: str, loaded_at: datetime,
                    files: DataFrame | None = None, json_lines: bool = False, schema=RIDE,
                    csv_multi_line: bool = True) -> str | None:
    """Load pending files (or the pending ones among `files`) and record them; the load id, or None.

    The input is scanned once: counts per file are taken from what was written. The load id names the set of
    files, so a repeated attempt overwrites the folder of the first. Quoted CSV values may hold line breaks;
    `csv_multi_line=False`, for files known to have none, lets large files be split.
    """
    pending = pending_files(spark, landing, manifest)
    if files is not None:
        pending = pending.join(files.select("file_path"), "file_path", "left_semi")
    # Paths only, one per new file: any file read needs them on the driver.
    chosen = sorted(pending.select(*FILE_COLUMNS).collect())
    if not chosen:
        return None
    load_id = _load_id(chosen)
    by_format = {"json": [], "csv": []}
    for row in chosen:
        by_format[file_format(row.file_name)].append(row.file_path)
    parts = [read_files(spark, paths, fmt, schema, multi_line=csv_multi_line if fmt == "csv" else not json_lines)
             for fmt, paths in by_format.items() if paths]
    target = f"{table}/load_id={load_id}"
    union_feeds(*parts).withColumn("_ingested_at", F.lit(loaded_at)).write.mode("overwrite").parquet(target, compression="zstd")

    counts = count_per_file(spark.read.parquet(target).select(SOURCE_PATH))
    entries = (
        spark.createDataFrame(chosen, "file_path string, file_name string, file_size long, modified_at timestamp")
        .join(counts, "file_path", "left")
        .select("file_path", "file_name", "file_size",
                F.coalesce("record_count", F.lit(0).cast("long")).alias("record_count"),
                F.lit(loaded_at).alias(LOADED_AT), "modified_at")
    )
    entries.coalesce(1).write.mode("overwrite").parquet(f"{manifest}/load_id={load_id}")
    return load_id


def _load_id(rows: list) -> str:
    text = "\n".join(f"{r.file_path}|{r.file_size}|{r.modified_at}" for r in rows)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def append_changes(spark: SparkSession, source: DataFrame, table: str, key: str, loaded_at: datetime) -> bool:
    """Append new and changed rows of `source` to the change log at `table`; False if there are none.

    The first load appends everything. The log is partitioned by load, so a repeated load replaces itself.
    """
    existing = read_table(spark, table)
    load = loaded_at.strftime("%Y%m%dT%H%M%S%f")
    changed = source
    if existing is not None:
        earlier = existing.where(F.col("load_id") != load).drop("load_id")
        changed = detect_changes(source, earlier, key)
    target = f"{table}/load_id={load}"
    changed.withColumn(LOADED_AT, F.lit(loaded_at)).write.mode("overwrite").parquet(target)
    return not spark.read.parquet(target).isEmpty()


def load_references(spark: SparkSession, folder: str, bronze: str, loaded_at: datetime) -> dict[str, bool]:
    """Load all five reference files `<folder>/<table>.json`; which of them had changes."""
    return {
        name: append_changes(spark, read_reference(spark, f"{folder}/{name}.json", schema),
                             f"{bronze}/{name}", reference_key(name), loaded_at)
        for name, schema in REFERENCE.items()
    }


def reference_log(spark: SparkSession, bronze: str, name: str) -> DataFrame:
    """All loaded versions of a reference table."""
    log = read_table(spark, f"{bronze}/{name}")
    if log is None:
        raise FileNotFoundError(f"{bronze}/{name} has not been loaded")
    return log.drop("load_id")
