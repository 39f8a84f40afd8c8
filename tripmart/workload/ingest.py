"""Queries: sources, sinks, typing, messages, change detection, loads."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tripmart.functions.columns import active, calendar, fingerprint, fingerprint_joined, pseudonym, typed
from tripmart.operators.changes import deleted_keys, detect_changes, latest_snapshot, not_loaded
from tripmart.operators.joins import union_feeds
from tripmart.plans import bronze, silver
from tripmart.schemas import RIDE
from tripmart.session import work_dir
from tripmart.sources import files, messages
from tripmart.workload.inputs import BY_DRIVER, rides, table
from tripmart.workload.registry import query
from tripmart.workload.sql import RIDES, SILVER, with_


def _utc(year: int, month: int, day: int) -> datetime:
    return datetime(year, month, day, tzinfo=timezone.utc)


@query("SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def event_parse(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("props").alias("records"))
    return messages.parse(events, T.StructType().add("k", "integer")).select("event_id", "user_id", "k")


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def message_roundtrip(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = events.withColumn("ts", F.col("ts").cast("string"))
    sent = messages.to_messages(text)
    got = messages.parse(messages.decode(sent).select("records"), text.schema)
    return got.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value",
                      "props")


@query("SELECT sha256(text) AS text_hash, length(text) AS n_chars FROM documents "
       "UNION ALL SELECT sha256(html), length(html) FROM pages")
def message_quarantine(spark, sf_dir):
    """Prose and web pages sent into a feed of JSON events: all of it, and no event, is set aside."""
    events = table(spark, sf_dir, "events")
    feed = union_feeds(events.select(messages.message(events.columns).alias("records")),
                       table(spark, sf_dir, "documents").select(F.col("text").alias("records")),
                       table(spark, sf_dir, "pages").select(F.col("html").alias("records")))
    parsed = messages.parse(feed, T.StructType().add("event_id", "long"))
    _, bad = messages.split_malformed(parsed, "event_id")
    return bad.select(F.sha2("records", 256).alias("text_hash"), F.length("records").cast("long").alias("n_chars"))


@query("""SELECT TRY_CAST(o_orderkey AS BIGINT) AS o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority,
          TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus, TRY_CAST(o_totalprice AS DOUBLE) AS o_totalprice,
          TRY_CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CAST(NULL AS VARCHAR) AS o_comment FROM orders""")
def try_cast_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    text = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns])
    schema = (T.StructType().add("o_orderkey", "long").add("o_orderpriority", "integer")
              .add("o_orderstatus", "double").add("o_totalprice", "double").add("o_orderdate", "timestamp")
              .add("o_comment", "string"))
    return text.select(*typed(text, schema))


@query("SELECT c_custkey, sha256(c_name) AS name_hash, sha256('pepper' || c_name) AS peppered FROM customer")
def pii_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", pseudonym(F.col("c_name")).alias("name_hash"),
        pseudonym(F.col("c_name"), "pepper").alias("peppered"))


@query("SELECT event_id, CAST(ts AS DATE) AS booking_date, CAST(hour(ts) AS INTEGER) AS booking_hour FROM events")
def derive_date_hour(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *calendar("ts"))


_JSON = "'{' || " + " || ',' || ".join(
    f"""'"{c}":' || coalesce({f"to_json({c})" if c in ("p_brand", "p_name", "p_type") else f"CAST({c} AS VARCHAR)"}, 'null')"""
    for c in ("p_brand", "p_name", "p_retailprice", "p_size", "p_type")) + " || '}'"


@query(f"""SELECT p_partkey, sha256({_JSON}) AS fingerprint,
    sha256(concat_ws('|', p_brand, p_name, p_retailprice, p_size, p_type)) AS content_hash FROM part""")
def content_fingerprint(spark, sf_dir):
    """Parts by all their columns, in both forms."""
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", fingerprint(part, ["p_partkey"]).alias("fingerprint"),
                       fingerprint_joined(part, ["p_partkey"]).alias("content_hash"))


@query("""WITH existing AS (
            SELECT c_custkey, c_name, c_nationkey, c_acctbal,
                   CASE WHEN c_acctbal < 0 THEN 'UNKNOWN' ELSE c_mktsegment END AS c_mktsegment
            FROM customer SEMI JOIN orders ON o_custkey = c_custkey)
          SELECT s.* FROM customer s LEFT JOIN existing e ON s.c_custkey = e.c_custkey
          WHERE e.c_custkey IS NULL OR ROW(s.c_name, s.c_nationkey, s.c_acctbal, s.c_mktsegment)
                IS DISTINCT FROM ROW(e.c_name, e.c_nationkey, e.c_acctbal, e.c_mktsegment)""")
def content_hash_diff(spark, sf_dir):
    """Customers against a log of two loads, in which debtors have no segment yet."""
    source = table(spark, sf_dir, "customer")
    known = source.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey",
                        "left_semi")
    segment = F.when(F.col("c_acctbal") < 0, "UNKNOWN").otherwise(F.col("c_mktsegment"))
    log = union_feeds(
        known.withColumn("c_mktsegment", F.lit("OLD")).withColumn("loaded_at", F.lit(_utc(2024, 1, 1))),
        known.withColumn("c_mktsegment", segment).withColumn("loaded_at", F.lit(_utc(2024, 2, 1))))
    return detect_changes(source, log, "c_custkey")


@query("""SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC,
          o_orderkey DESC, o_orderstatus DESC, o_totalprice DESC, o_orderpriority DESC) = 1""", "latest_snapshot")
def snapshot(spark, sf_dir):
    return latest_snapshot(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("SELECT * FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey", "deleted_keys")
def deleted(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return deleted_keys(lines, table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


@query("SELECT d.doc_id, source, n_chars FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def manifest_diff(spark, sf_dir):
    """Documents that the labels, taken as a manifest, do not name yet."""
    found = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return not_loaded(found, table(spark, sf_dir, "labels"), ["doc_id"])


_NAMES = """names AS (SELECT DISTINCT 'historical_' || strftime(date_trunc('month', o_orderdate), '%Y%m%d') || '_'
            || strftime(date_trunc('month', o_orderdate) + INTERVAL 27 DAY, '%Y%m%d')
            || CASE o_orderstatus WHEN 'F' THEN '.csv' WHEN 'O' THEN '.json' ELSE '.txt' END AS file_name
            FROM orders)"""


def _file_names(df, day, status=None):
    """Names of monthly exports, as a listing would give them."""
    keys = [F.date_trunc("month", F.col(day)).alias("month")] + ([F.col(status)] if status else [])
    df, month = df.select(*keys).distinct(), F.col("month")
    suffix = F.lit(".csv") if status is None else (
        F.when(F.col(status) == "F", ".csv").when(F.col(status) == "O", ".json").otherwise(".txt"))
    stamp = lambda t: F.date_format(t, "yyyyMMdd")
    return df.select(F.concat(F.lit("historical_"), stamp(month), F.lit("_"),
                              stamp(month + F.make_dt_interval(days=F.lit(27))), suffix)
                     .alias("file_name")).distinct()


@query(with_(_NAMES) + "SELECT file_name FROM names WHERE NOT file_name LIKE '%.txt' "
       "AND substr(file_name, 12, 8) BETWEEN '19970101' AND '19981231'")
def file_date_selection(spark, sf_dir):
    listing = _file_names(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus")
    return files.select_by_date(listing, "1997-01-01", "1998-12-31")


@query(with_(_NAMES) + "SELECT file_name FROM names WHERE file_name LIKE '%.txt'")
def file_name_rejects(spark, sf_dir):
    return files.badly_named(_file_names(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus"))


@query(with_(_NAMES, """wanted AS (SELECT DISTINCT 'historical_' || strftime(date_trunc('month', l_shipdate), '%Y%m%d')
       || '_' || strftime(date_trunc('month', l_shipdate) + INTERVAL 27 DAY, '%Y%m%d') || '.csv' AS file_name
       FROM lineitem)""") + "SELECT file_name, file_name IN (SELECT file_name FROM names) AS found FROM wanted")
def file_name_selection(spark, sf_dir):
    """Files asked for by ship month among those that exist by order month."""
    listing = _file_names(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus")
    found, missing = files.select_by_names(listing, _file_names(table(spark, sf_dir, "lineitem"), "l_shipdate"))
    return union_feeds(found.withColumn("found", F.lit(True)), missing.withColumn("found", F.lit(False)))


@query("SELECT o_orderstatus, count(*) AS record_count FROM orders GROUP BY o_orderstatus")
def per_file_count(spark, sf_dir):
    path = work_dir(spark, "per_file_count")
    table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    counts = files.count_per_file(spark.read.parquet(path), F.col("_metadata.file_path"))
    status = F.regexp_extract("file_path", "o_orderstatus=([^/]*)/", 1)
    return counts.groupBy(status.alias("o_orderstatus")).agg(F.sum("record_count").alias("record_count"))


@query("SELECT * FROM part")
def csv_roundtrip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    path = work_dir(spark, "csv_roundtrip")
    files.write_csv(part, path)
    paths = [r.file_path for r in files.list_files(spark, path).select("file_path").collect()]
    return files.read_files(spark, paths, "csv", part.schema).drop(files.SOURCE_PATH, files.EXTRA)


@query("SELECT * FROM supplier")
def json_roundtrip(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    path = work_dir(spark, "json_roundtrip")
    files.write_json(supplier, path)
    return files.read_files(spark, [path], "json", supplier.schema, multi_line=False).drop(files.SOURCE_PATH, files.EXTRA)


@query("""SELECT conv_id, turn, role, text FROM conversations""")
def csv_text_roundtrip(spark, sf_dir):
    """Whole texts with commas, quotes, accents and line breaks through a fully quoted CSV."""
    talks = table(spark, sf_dir, "conversations")
    path = work_dir(spark, "csv_text_roundtrip")
    files.write_csv(talks, path)
    paths = [r.file_path for r in files.list_files(spark, path).select("file_path").collect()]
    return files.read_files(spark, paths, "csv", talks.schema, multi_line=True).drop(files.SOURCE_PATH, files.EXTRA)


@query(with_(RIDES) + "SELECT *, CASE WHEN ride_status_id = 1 THEN 'csv' ELSE 'json' END AS carrier FROM rides")
def historical_load(spark, sf_dir):
    """Completed rides as CSV under two column orders, cancelled ones as JSON, all gzipped; loaded, then asked again."""
    raw = rides(spark, sf_dir, BY_DRIVER)
    landing, table_path, manifest = (work_dir(spark, f"historical_{n}") for n in ("landing", "rides", "manifest"))
    done = raw.where("ride_status_id = 1")
    files.write_csv(done.where("pickup_city_id = dropoff_city_id"), f"{landing}/a", compression="gzip")
    files.write_csv(done.where("pickup_city_id <> dropoff_city_id").select(*reversed(raw.columns)), f"{landing}/b",
                    compression="gzip")
    files.write_json(raw.where("ride_status_id = 2"), f"{landing}/c", compression="gzip")
    for _ in range(2):
        bronze.load_historical(spark, landing, table_path, manifest, _utc(2024, 1, 1), json_lines=True)
    carrier = F.regexp_extract(files.SOURCE_PATH, r"\.(csv|json)\.gz$", 1).alias("carrier")
    return bronze.read_historical(spark, table_path, manifest).select(*RIDE.fieldNames(), carrier)


@query("""SELECT p_partkey, p_retailprice, TIMESTAMP '2024-01-01' AS loaded_at FROM part
          UNION ALL SELECT p_partkey, p_retailprice + 1, TIMESTAMP '2024-02-01' FROM part WHERE p_size > 25""")
def reference_load(spark, sf_dir):
    """Parts loaded three times: all, those with a new price, and nothing."""
    path = work_dir(spark, "reference_load")
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_size") > 25, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    bronze.append_changes(spark, part, path, "p_partkey", _utc(2024, 1, 1))
    bronze.append_changes(spark, part.withColumn("p_retailprice", price), path, "p_partkey", _utc(2024, 2, 1))
    bronze.append_changes(spark, part.withColumn("p_retailprice", price), path, "p_partkey", _utc(2024, 3, 1))
    return spark.read.parquet(path).select("p_partkey", "p_retailprice", "loaded_at")


@query(with_(SILVER) + "SELECT * FROM silver")
def silver_rides(spark, sf_dir):
    return silver.conform(rides(spark, sf_dir))


@query(with_(SILVER) + "SELECT * FROM silver")
def union_feeds_to_silver(spark, sf_dir):
    """Completed rides through messages, cancelled ones through the historical table."""
    raw = rides(spark, sf_dir)
    live, _ = silver.from_messages(messages.to_messages(raw.where("ride_status_id = 1")))
    return silver.unite(live, raw.where("ride_status_id = 2"))


@query("""SELECT 'R' || s_suppkey AS reason_key, s_suppkey AS supplier_id, s_name AS supplier_name, CAST(s_nationkey AS VARCHAR) AS region
    FROM supplier WHERE s_nationkey % 5 <> 0 OR s_nationkey IS NULL""")
def reference_files(spark, sf_dir):
    """Suppliers as reference files (JSON arrays, a column undeclared), read with declared types; only active rows."""
    at = work_dir(spark, "reference_files")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("R"), "s_suppkey").alias("reason_key"), F.col("s_suppkey").alias("supplier_id"),
        F.col("s_name").alias("supplier_name"), F.col("s_nationkey").alias("region"),
        F.when(F.col("s_nationkey") % 5 == 0, F.lit(False)).when(F.col("s_nationkey") % 5 == 1, F.lit(True)).alias("is_active"))
    n = -(-rows.count() // 1000) or 1  # a file holds one array of about 1,000 rows
    arrays = rows.groupBy(F.pmod("supplier_id", F.lit(n)).cast("int").alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartitionById(n, F.col("file")).select("value").write.text(at)
    declared = T.StructType([T.StructField("reason_key", T.StringType()), T.StructField("supplier_id", T.LongType()),
                             T.StructField("supplier_name", T.StringType()), T.StructField("is_active", T.BooleanType())])
    read = files.read_reference(spark, at, declared)
    return read.where(active()).select("reason_key", "supplier_id", "supplier_name", "region")
