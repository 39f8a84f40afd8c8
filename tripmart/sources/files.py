"""Ride files, reference files and file listings."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from datetime import date
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.columns import typed
from tripmart.operators.joins import union_feeds
from tripmart.schemas import MANIFEST, RIDE

# Fixed value: name of a historical export, with its first and last day.
HISTORICAL_NAME = r"^historical_(\d{8})_(\d{8})\.(csv|json)$"

FILE_COLUMNS = ["file_path", "file_name", "file_size", "modified_at"]
SOURCE_PATH = "_source_path"
#: Lines that a CSV header may span.
HEADER_LINES = 100
EXTRA = "_extra"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, merge: bool = True) -> DataFrame | None:
    """A parquet table, or None if there is none yet.

    Without a schema all files are asked for their columns, or, without `merge`, one of them for all.
    """
    try:
        return (spark.read.schema(schema) if schema else spark.read.option("mergeSchema", merge)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str] = ("csv", "json", "csv.gz", "json.gz")) -> DataFrame:
    """Files below `path` with one of the suffixes. The content column is pruned, so nothing is opened.

    Spark leaves out files of no bytes; they hold nothing to load.
    """
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"),
                F.col("_metadata.file_size").alias("file_size"),
                F.col("_metadata.file_modification_time").alias("modified_at"))
    )


def select_by_date(listing: DataFrame, first: date | str, last: date | str,
                   pattern: str = HISTORICAL_NAME) -> DataFrame:
    """Files whose name starts a period within [first, last]; other names are left out. In name order."""
    start = F.try_to_timestamp(F.regexp_extract("file_name", pattern, 1), F.lit("yyyyMMdd")).cast("date")
    return (listing.where(F.col("file_name").rlike(pattern) & start.between(F.lit(first), F.lit(last)))
            .orderBy("file_name"))


def badly_named(listing: DataFrame, pattern: str = HISTORICAL_NAME) -> DataFrame:
    return listing.where(~F.col("file_name").rlike(pattern))


def select_by_names(listing: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files found, names missing) for a table of `file_name`s."""
    wanted = names.select("file_name").distinct()
    return (listing.join(wanted, "file_name", "left_semi"), wanted.join(listing, "file_name", "left_anti"))


def file_format(name: str) -> str:
    """The format that the suffix of a file's name tells, whether it is compressed or not."""
    return name.removesuffix(".gz").rsplit(".", 1)[-1]


def read_files(spark: SparkSession, paths: Sequence[str], fmt: str,
               schema: T.StructType = RIDE, **options) -> DataFrame:
    """Files of one format as rows of `schema` plus the path each came from."""
    if fmt == "json":
        return read_json(spark, paths, schema, **options)
    if fmt == "csv":
        return read_csv(spark, paths, schema, **options)
    raise ValueError(f"Unsupported format: {fmt}")


def read_json(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RIDE,
              multi_line: bool = True) -> DataFrame:
    """JSON rows by field name. `multi_line` takes whole-file arrays; JSON lines also split within a file.

    Fields outside `schema` are kept as text in the map `_extra`; one pass over the input finds their names.
    """
    files = [readable(p) for p in paths]
    found = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(files).columns
    known = {n.lower() for n in schema.fieldNames()}
    more = [c for c in found if c.lower() not in known and c != "_corrupt_record"]
    wide = T.StructType([*schema.fields, *[T.StructField(c, T.StringType()) for c in more]])
    df = spark.read.schema(wide).option("multiLine", multi_line).json(files)
    return df.select(*schema.fieldNames(), _extra(more), F.col("_metadata.file_path").alias(SOURCE_PATH))


def _extra(names: Sequence[str]) -> Column:
    """Columns that no schema declares, by name; null if a row has none."""
    if not names:
        return F.lit(None).cast("map<string,string>").alias(EXTRA)
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    there = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return F.when(F.size(there) > 0, there).alias(EXTRA)


def readable(path: str) -> str:
    """The path of a listed file as readers take it: listings encode it, and readers see patterns in it."""
    return "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in unquote(path))


def read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType = RIDE,
             multi_line: bool = False) -> DataFrame:
    """CSV rows by header name, typed tolerantly (a value that does not fit becomes null).

    Files are grouped by header and each group is read once, with the header's names as its schema, so no row is read to
    infer one. A header may span lines within quotes; such files are read by the multi-line reader. A column
    of `schema` that a file lacks is null; columns outside `schema` are kept in the map `_extra`.
    """
    groups: dict[tuple[bool, tuple[str, ...]], list[str]] = {}
    for path, header in sorted(_headers(spark, paths).items()):
        key = multi_line or "\n" in header, tuple(next(csv.reader(io.StringIO(header, newline=""))))
        groups.setdefault(key, []).append(readable(path))
    parts = [_read_csv_group(spark, members, names, schema, lines) for (lines, names), members in groups.items()]
    if not parts:
        empty = T.StructType([*schema.fields, T.StructField(EXTRA, T.MapType(T.StringType(), T.StringType())),
                              T.StructField(SOURCE_PATH, T.StringType())])
        return spark.createDataFrame([], empty)
    return union_feeds(*parts)


def _read_csv_group(spark: SparkSession, paths: list[str], names: tuple[str, ...], schema: T.StructType,
                    multi_line: bool) -> DataFrame:
    """Files with one header. A name that is missing or there twice gets its place in the line."""
    low = [n.lower() for n in names]
    own = [n if n and low.count(n.lower()) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(names)]
    text = T.StructType([T.StructField(n, T.StringType()) for n in own])
    df = (spark.read.schema(text).option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", multi_line).csv(paths))
    return _with_extra(df, schema, F.col("_metadata.file_path"))


def _with_extra(df: DataFrame, schema: T.StructType, path: Column) -> DataFrame:
    known = {n.lower() for n in schema.fieldNames()}
    more = [c for c in df.columns if c.lower() not in known and c != SOURCE_PATH]
    return df.select(*typed(df, schema), _extra(more), path.alias(SOURCE_PATH))


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """The header of each file that has one: its first line that is not blank, and the next ones while a quote is open.

    One job for all files. A task keeps at most HEADER_LINES lines of a file, the driver gets the header alone.
    """
    lines = spark.read.text([readable(p) for p in paths]).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value",
        F.monotonically_increasing_id().alias("line")).where("start = 0 AND trim(value) <> ''")
    along = Window.partitionBy("path").orderBy("line")
    first = lines.withColumn("at", F.row_number().over(along)).where(F.col("at") <= HEADER_LINES)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    within = first.withColumn("open", F.sum(quotes).over(along) % 2).withColumn(
        "goes_on", F.coalesce(F.min("open").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    headers = within.where("goes_on = 1").groupBy("path").agg(F.array_join(parts, "\n").alias("header"))
    return {r["path"]: r["header"] for r in headers.collect()}


def count_per_file(df: DataFrame, path: str | Column = SOURCE_PATH) -> DataFrame:
    """Records per file in one pass over rows that carry their file's path."""
    col = F.col(path) if isinstance(path, str) else path
    return df.groupBy(col.alias("file_path")).agg(F.count("*").alias("record_count"))


def read_reference(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reference file (one JSON array) with its declared types, which inference would widen.

    A column that is not declared is kept as text, so that it is loaded from the day it appears.
    """
    found = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path).columns
    more = [T.StructField(c, T.StringType()) for c in found if c not in schema.fieldNames() and c != "_corrupt_record"]
    return spark.read.schema(T.StructType([*schema.fields, *more])).option("multiLine", True).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """CSV export: header, every field quoted, quotes doubled, UTF-8; a null is an empty field. `compression`: gzip or none."""
    (df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"')
     .option("nullValue", "").option("emptyValue", "").csv(path, compression=compression))


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """JSON export, one object per line, null fields kept. `compression`: gzip or none."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path, compression=compression)


def manifest_schema() -> T.StructType:
    """The manifest with the modification time that tells a replaced file of equal size."""
    return T.StructType([*MANIFEST.fields, T.StructField("modified_at", T.TimestampType())])
