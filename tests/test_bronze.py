"""Sources, loads and change detection."""

import json
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tripmart.functions.columns import fingerprint, fingerprint_joined
from tripmart.operators.changes import deleted_keys, detect_changes, latest_snapshot
from tripmart.operators.joins import union_feeds
from tripmart.plans import bronze
from tripmart.schemas import MANIFEST, REFERENCE, RIDE
from tripmart.sources import files, messages

T1, T2, T3 = (datetime(2026, m, 1, tzinfo=timezone.utc) for m in (1, 2, 3))


def ride(ride_id, **values):
    record = {f.name: None for f in RIDE.fields}
    return record | {"ride_id": ride_id, "booking_timestamp": "2026-01-05T08:30:00.123456", "total_fare": 10.5} | values


def write_csv(path, records, columns=None):
    columns = columns or list(records[0])
    quote = lambda v: '"' + ("" if v is None else str(v)).replace('"', '""') + '"'
    path.write_text("\n".join([",".join(map(quote, columns))] +
                              [",".join(quote(r[c]) for c in columns) for r in records]) + "\n", encoding="utf-8")


@pytest.fixture
def lake(tmp_path):
    (tmp_path / "landing").mkdir()
    return tmp_path


def load(spark, lake, at):
    return bronze.load_historical(spark, str(lake / "landing"), str(lake / "rides"), str(lake / "manifest"), at)


def rides_of(spark, lake):
    return bronze.read_historical(spark, str(lake / "rides"), str(lake / "manifest"))


def manifest_of(spark, lake):
    return bronze.read_manifest(spark, str(lake / "manifest"))


def test_csv_columns_follow_each_file_header(spark, lake):
    rows = [ride("R1", pickup_address='ถนน 1, "ซอย" 2', driver_rating=4.5)]
    write_csv(lake / "landing/a.csv", rows)
    write_csv(lake / "landing/b.csv", [rows[0] | {"ride_id": "R2"}], list(reversed(list(rows[0]))))
    short = ["ride_id", "rating", "unknown"]
    write_csv(lake / "landing/c.csv", [{"ride_id": "R3", "rating": "bad", "unknown": "x"}], short)
    (lake / "landing/d.csv").write_text("")
    paths = [r.file_path for r in files.list_files(spark, str(lake / "landing")).collect()]
    assert len(paths) == 3  # Spark does not list files of no bytes
    paths.append(str(lake / "landing/d.csv"))
    got = {r.ride_id: r for r in files.read_files(spark, paths, "csv").collect()}
    assert got["R1"].pickup_address == got["R2"].pickup_address == 'ถนน 1, "ซอย" 2'
    assert got["R2"].driver_rating == 4.5 and got["R2"].booker_id is None
    assert got["R3"].rating is None and "unknown" not in got["R3"].asDict()
    assert got["R1"]._source_path.endswith("a.csv")


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="Unsupported format"):
        files.read_files(spark, [], "xml")


def test_load_is_incremental_and_counts_each_file(spark, lake):
    write_csv(lake / "landing/one.csv", [ride("R1"), ride("R2")])
    (lake / "landing/two.json").write_text(json.dumps([ride("R3", booker_name="ก")], ensure_ascii=False))
    (lake / "landing/empty.json").write_text("[]")
    write_csv(lake / "landing/header.csv", [], RIDE.fieldNames())
    (lake / "landing/readme.txt").write_text("not a ride file")
    first = load(spark, lake, T1)
    assert first and load(spark, lake, T2) is None
    counts = {r.file_name: r.record_count for r in manifest_of(spark, lake).collect()}
    assert counts == {"one.csv": 2, "two.json": 1, "empty.json": 0, "header.csv": 0}
    assert set(MANIFEST.fieldNames()) <= set(manifest_of(spark, lake).columns)
    write_csv(lake / "landing/three.csv", [ride("R4")])
    assert load(spark, lake, T2) not in (None, first)
    assert sorted(r.ride_id for r in rides_of(spark, lake).collect()) == ["R1", "R2", "R3", "R4"]


def test_replaced_file_of_equal_size_is_loaded_again(spark, lake):
    path = lake / "landing/one.csv"
    write_csv(path, [ride("R1", total_fare=10.5)])
    load(spark, lake, T1)
    size = path.stat().st_size
    write_csv(path, [ride("R1", total_fare=20.5)])
    assert path.stat().st_size == size
    os.utime(path, (2e9, 2e9))
    assert load(spark, lake, T2)
    got = rides_of(spark, lake)
    assert sorted(r.total_fare for r in got.collect()) == [10.5, 20.5]
    from tripmart.plans import gold, silver
    fact = gold.fact_rides(silver.conform(got)).collect()
    assert [(r.ride_id, r.total_fare) for r in fact] == [("R1", 20.5)]


def test_load_that_died_before_the_manifest_is_invisible_and_repeated(spark, lake, monkeypatch):
    write_csv(lake / "landing/one.csv", [ride("R1")])
    def die(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:
        m.setattr(bronze, "count_per_file", die)
        with pytest.raises(RuntimeError):
            load(spark, lake, T1)
    assert rides_of(spark, lake).count() == 0
    write_csv(lake / "landing/two.csv", [ride("R2")])  # so the repetition loads another set of files
    assert load(spark, lake, T2)
    assert sorted(r.ride_id for r in rides_of(spark, lake).collect()) == ["R1", "R2"]


def test_load_can_be_limited_to_selected_files(spark, lake):
    for name in ("historical_20260101_20260201.csv", "historical_20260201_20260301.csv", "other.csv"):
        write_csv(lake / "landing" / name, [ride(name)])
    listing = files.list_files(spark, str(lake / "landing"))
    chosen = files.select_by_date(listing, "2026-01-15", "2026-02-01")
    assert [r.file_name for r in chosen.collect()] == ["historical_20260201_20260301.csv"]
    assert [r.file_name for r in files.badly_named(listing).collect()] == ["other.csv"]
    names = spark.createDataFrame([("other.csv",), ("gone.csv",)], "file_name string")
    found, missing = files.select_by_names(listing, names)
    assert [r.file_name for r in found.collect()] == ["other.csv"]
    assert [r.file_name for r in missing.collect()] == ["gone.csv"]
    bronze.load_historical(spark, str(lake / "landing"), str(lake / "rides"), str(lake / "manifest"), T1, chosen)
    assert [r.ride_id for r in rides_of(spark, lake).collect()] == ["historical_20260201_20260301.csv"]


def test_impossible_date_in_a_name_is_not_selected(spark):
    listing = spark.createDataFrame([("historical_20269901_20260201.csv",)], "file_name string")
    assert files.select_by_date(listing, "2000-01-01", "2100-01-01").count() == 0


def test_exports_can_be_read_back(spark, lake):
    rows = spark.createDataFrame([ride("R1", pickup_address='a, "b"', booker_name=None)], RIDE)
    files.write_csv(rows, str(lake / "csv"))
    read = lambda fmt: "".join(p.read_text() for p in (lake / fmt).glob(f"*.{fmt}"))
    text = read("csv")
    assert text.startswith('"ride_id","booker_id"') and '"a, ""b"""' in text
    files.write_json(rows, str(lake / "json"))
    assert '"booker_name":null' in read("json")
    for fmt in ("csv", "json"):
        paths = [str(p) for p in (lake / fmt).glob(f"*.{fmt}")]
        assert files.read_files(spark, paths, fmt).drop("_source_path", "_extra").collect() == rows.collect()


def test_fingerprint_tells_nulls_and_delimiters_apart(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, "a|b", ""), (4, "a", "b|")], "k int, x string, y string")
    assert df.select(fingerprint(df, ["k"])).distinct().count() == 4
    assert df.select(fingerprint_joined(df, ["k"])).distinct().count() == 2
    swapped = df.select("y", "k", "x")
    same = df.withColumn("h", fingerprint(df, ["k"])).join(swapped.withColumn("g", fingerprint(swapped, ["k"])), "k")
    assert same.where("h <> g").count() == 0


def test_latest_snapshot_never_doubles_a_key(spark):
    log = spark.createDataFrame([(1, "a", T1), (1, "b", T1), (2, "c", T1), (2, "d", T2)],
                                "k int, v string, loaded_at timestamp")
    assert sorted((r.k, r.v) for r in latest_snapshot(log, "k").collect()) == [(1, "b"), (2, "d")]


def test_detect_changes(spark):
    log = spark.createDataFrame([(1, "a", T1), (2, "b", T1), (2, "c", T2), (9, "gone", T1)],
                                "k int, v string, loaded_at timestamp")
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, detect_changes(source, log, "k").collect())) == [(2, "b"), (3, "new")]
    assert [r.k for r in deleted_keys(source, log, "k").collect()] == [9]
    grown = source.withColumn("extra", F.when(F.col("k") == 1, 5))
    assert sorted(r.k for r in detect_changes(grown, log, "k").collect()) == [1, 2, 3]
    assert detect_changes(source, log, "k", broadcast_rows=0).count() == 2


def test_reference_tables_load_changes_only(spark, lake):
    rows = {
        "map_provinces": [{"province_id": "TH-10", "province_name": "Bangkok"}],
        "map_payment_methods": [{"payment_method_id": 1, "payment_method": "Cash", "is_card": False,
                                 "requires_auth": False, "is_active": True, "retired_at": None}],
        "map_ride_options": [{"ride_option_id": 1, "ride_option_name": "Economy", "vehicle_class": "Sedan",
                              "passenger_capacity": 4, "base_rate": 45.0, "per_km": 9.0, "per_minute": 2.5,
                              "is_active": True, "retired_at": None}],
        "map_ride_statuses": [{"ride_status_id": 1, "ride_status": "Completed"}],
        "map_cancellation_reasons": [{"cancellation_reason_id": 1, "initiator": None, "cancellation_reason": None}],
    }
    folder, store = lake / "mapping", str(lake / "bronze")
    folder.mkdir()
    def put():
        for name, body in rows.items():
            (folder / f"{name}.json").write_text(json.dumps(body))
    put()
    assert all(bronze.load_references(spark, str(folder), store, T1).values())
    assert not any(bronze.load_references(spark, str(folder), store, T2).values())
    rows["map_ride_options"][0]["per_km"] = 10.0          # not tracked: overwrites the open version
    put()
    assert bronze.load_references(spark, str(folder), store, T2)["map_ride_options"]
    rows["map_ride_options"][0]["ride_option_name"] = "Eco"  # tracked: opens a version
    put()
    bronze.load_references(spark, str(folder), store, T3)
    bronze.load_references(spark, str(folder), store, T3)    # a repeated load replaces itself
    log = bronze.reference_log(spark, store, "map_ride_options")
    assert log.count() == 3
    assert dict(log.dtypes) == {f.name: f.dataType.simpleString() for f in REFERENCE["map_ride_options"].fields} | {
        "loaded_at": "timestamp"}
    from tripmart.plans import gold
    versions = gold.versioned_dim(log, "dim_ride_option").orderBy("__START_AT").collect()
    assert [(v.ride_option_name, v.per_km, v["__END_AT"] is None) for v in versions] == [
        ("Economy", 10.0, False), ("Eco", 10.0, True)]
    assert gold.static_dim(bronze.reference_log(spark, store, "map_provinces"), "dim_province").count() == 1
    with pytest.raises(FileNotFoundError):
        bronze.reference_log(spark, store, "map_planets")


def test_kafka_options():
    options = messages.kafka_options("host:9093", "rides", "user", "secret")
    assert options["startingOffsets"] == "earliest" and options["failOnDataLoss"] == "true"
    assert options["maxOffsetsPerTrigger"] == "10000" and options["kafka.security.protocol"] == "SASL_SSL"
    assert 'username="user" password="secret"' in options["kafka.sasl.jaas.config"]
    assert "kafka.sasl.mechanism" not in messages.kafka_options("host:9092", "rides")


def test_messages_and_quarantine(spark):
    rows = spark.createDataFrame([ride("R1", booker_name="ก")], RIDE)
    sent = messages.to_messages(rows)
    bad = sent.withColumn("value", F.lit("{bad").cast("binary"))
    parsed = messages.parse(messages.decode(union_feeds(sent, bad)))
    good, quarantine = messages.split_malformed(parsed)
    assert good.select(*RIDE.fieldNames()).collect() == rows.collect()
    assert [r.records for r in quarantine.collect()] == ["{bad"]
    assert json.loads(good.first().records)["booker_id"] is None  # nulls are sent


def test_load_keeps_line_breaks_new_columns_and_odd_names(spark, lake):
    """Quoted line breaks, undeclared columns of CSV and JSON, and file names with blanks, braces and per cent signs."""
    odd = ["rides jan.csv", "rides{1}.csv", "rides%20x.csv", "a[b]*?.csv"]
    for i, name in enumerate(odd):
        rows = [ride(f"R{i}", pickup_address='No. 1, "x"\nRoad 2') | {"weather": "rain"}]
        write_csv(lake / "landing" / name, rows)
    (lake / "landing" / "more rides.json").write_text(json.dumps([ride("J1") | {"weather": "sun", "stops": 2}, ride("J2")]))
    assert load(spark, lake, T1)
    got = {r.ride_id: r for r in bronze.read_historical(spark, str(lake / "rides"), str(lake / "manifest")).collect()}
    assert sorted(got) == ["J1", "J2", "R0", "R1", "R2", "R3"]
    assert all(got[f"R{i}"].pickup_address == 'No. 1, "x"\nRoad 2' and got[f"R{i}"].total_fare == 10.5 for i in range(4))
    assert got["R0"]._extra == {"weather": "rain"} and got["J1"]._extra == {"weather": "sun", "stops": "2"}
    assert got["J2"]._extra is None
    counts = bronze.read_manifest(spark, str(lake / "manifest")).collect()
    assert sorted(r.record_count for r in counts) == [1, 1, 1, 1, 2]
    assert load(spark, lake, T2) is None


def test_reference_grows_a_column(spark, lake):
    at = lake / "map_provinces.json"
    at.write_text(json.dumps([{"province_id": "A", "province_name": "Alpha"}]))
    table, schema = str(lake / "map_provinces"), REFERENCE["map_provinces"]
    assert bronze.append_changes(spark, files.read_reference(spark, str(at), schema), table, "province_id", T1)
    at.write_text(json.dumps([{"province_id": "A", "province_name": "Alpha", "region": "North"}]))
    assert bronze.append_changes(spark, files.read_reference(spark, str(at), schema), table, "province_id", T2)
    assert not bronze.append_changes(spark, files.read_reference(spark, str(at), schema), table, "province_id", T3)
    assert sorted(r.region or "" for r in files.read_table(spark, table).collect()) == ["", "North"]


def test_headers_take_one_job(spark, lake):
    """The number of jobs does not follow the number of files."""
    def jobs(n):
        folder = lake / f"many{n}"
        folder.mkdir()
        for i in range(n):
            write_csv(folder / f"f{i}.csv", [ride(f"R{i}")], None if i % 2 else list(reversed(ride("x"))))
        sc = spark.sparkContext
        sc.setJobGroup(f"headers{n}", "")
        paths = [r.file_path for r in files.list_files(spark, str(folder)).collect()]
        assert files.read_csv(spark, paths).count() == n
        sc._jsc.clearJobGroup()
        return len(sc.statusTracker().getJobIdsForGroup(f"headers{n}"))
    assert jobs(3) == jobs(20)


def test_csv_headers_over_several_lines(spark, lake):
    """Two files whose headers begin alike: each value goes under its own file's column."""
    lines = '"ride_id","booker\nid","total_fare"\n"R1","a ""b""\nc","10.5"\n'
    (lake / "landing/a.csv").write_text(lines)
    (lake / "landing/b.csv").write_text(lines.replace("booker\nid", "booker\n\n2").replace("R1", "R2"))
    (lake / "landing/c.csv").write_text("\nride_id,total_fare\nR3,2\n")
    paths = [str(lake / f"landing/{n}.csv") for n in "abc"]
    for multi_line in (True, False):
        got = {r.ride_id: r for r in files.read_csv(spark, paths, multi_line=multi_line).collect()}
        assert {k: float(r.total_fare) for k, r in got.items()} == {"R1": 10.5, "R2": 10.5, "R3": 2.0}
        assert got["R1"]._extra == {"booker\nid": 'a "b"\nc'} and got["R2"]._extra == {"booker\n2": 'a "b"\nc'}
        assert got["R3"]._extra is None


def test_csv_with_repeated_and_missing_names(spark, lake):
    (lake / "landing/a.csv").write_text("ride_id,x,X,\nR1,1,2,3\n")
    (row,) = files.read_csv(spark, [str(lake / "landing/a.csv")]).collect()
    assert row.ride_id == "R1" and row._extra == {"x1": "1", "X2": "2", "_c3": "3"}


def test_csv_under_names_of_patterns_with_long_fields(spark, lake):
    """The multi-line reader takes such names as they are; a field of 1 MB goes through."""
    long = 'x "y"\n' * 170_000
    for name in ("a{1}.csv", "b[c]*.csv", "plain.csv"):
        write_csv(lake / "landing" / name, [ride("R1") | {"note": long}], [*RIDE.fieldNames(), "note"])
    paths = [r.file_path for r in files.list_files(spark, str(lake / "landing")).collect()]
    got = files.read_csv(spark, paths, multi_line=True).collect()
    assert len(got) == 3 and {r._extra["note"] for r in got} == {long} and len({r._source_path for r in got}) == 3


def test_gzipped_files_load_as_plain_ones(spark, lake):
    """Exports may be compressed: the same rows, listed, counted and loaded once."""
    rows = spark.createDataFrame([ride(f"R{i}", pickup_address='a "b",\nc') for i in range(5)], RIDE)
    files.write_csv(rows.where("ride_id < 'R2'").coalesce(1), str(lake / "landing/a"), compression="gzip")
    files.write_csv(rows.where("ride_id = 'R2'").select(*reversed(rows.columns)).coalesce(1), str(lake / "landing/b"))
    files.write_json(rows.where("ride_id > 'R2'").coalesce(1), str(lake / "landing/c"), compression="gzip")
    names = [r.file_name for r in files.list_files(spark, str(lake / "landing")).collect()]
    assert sorted(files.file_format(n) for n in names) == ["csv", "csv", "json"]
    assert sorted(n.endswith(".gz") for n in names) == [False, True, True]
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    load = lambda: bronze.load_historical(spark, str(lake / "landing"), str(lake / "rides"), str(lake / "manifest"), at,
                                          json_lines=True)
    assert load() and load() is None
    got = bronze.read_historical(spark, str(lake / "rides"), str(lake / "manifest")).select(*RIDE.fieldNames())
    assert sorted(got.collect(), key=str) == sorted(rows.collect(), key=str)
    assert sorted(r.record_count for r in bronze.read_manifest(spark, str(lake / "manifest")).collect()) == [1, 2, 2]
