"""Streams: batch cuts, replays and crashes do not change what is stored."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tripmart.operators.history import history
from tripmart.operators.latest import latest
from tripmart.plans import bronze, silver
from tripmart.schemas import ENVELOPE, REFERENCE, RIDE
from tripmart.sources import messages
from tripmart.streaming import keyed, refresh, rides as live
from tripmart.streaming.runs import append_to, start
from test_operators import random_log

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
LOG = "k int, tracked string, other int, seq long"


def feed(spark, tmp_path, parts):
    """A stream that takes one part per batch."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return (spark.readStream.schema(spark.createDataFrame([], LOG).schema).option("maxFilesPerTrigger", 1)
            .parquet(str(tmp_path / "in")))


def cut(rows, n):
    return [rows[i::n] for i in range(n)]


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select(*b.columns).collect()), key=str)
    return key(a) == key(b)


@pytest.mark.parametrize("batches", [1, 3])
def test_upsert_stream_equals_batch(spark, tmp_path, batches):
    log = random_log(7, 120)
    target = str(tmp_path / "target")
    assert keyed.read_upserted(spark, target, "k", "seq") is None
    writer = keyed.upsert_stream(feed(spark, tmp_path, cut(log, batches)), target, "k", "seq")
    start(writer, str(tmp_path / "cp")).awaitTermination()
    want = latest(spark.createDataFrame(log, LOG), "k", "seq")
    assert same(keyed.read_upserted(spark, target, "k", "seq"), want)


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    log = random_log(8, 90)
    parts = [spark.createDataFrame(p, LOG) for p in cut(log, 3)]
    for n in (0, 1, 1, 2, 0):
        keyed._append(latest(parts[n], "k", "seq"), str(tmp_path / "rows"), n)
        keyed._append(parts[n], str(tmp_path / "log"), n)
    whole = spark.createDataFrame(log, LOG)
    assert same(keyed.read_upserted(spark, str(tmp_path / "rows"), "k", "seq"), latest(whole, "k", "seq"))
    assert keyed.changes(spark, str(tmp_path / "log")).count() == len(log)


def test_history_stream_equals_batch(spark, tmp_path):
    log = random_log(9, 90)
    target = str(tmp_path / "target")
    assert keyed.read_history(spark, target, "k", "seq", ["tracked"]) is None
    start(keyed.history_stream(feed(spark, tmp_path, cut(log, 3)), target), str(tmp_path / "cp")).awaitTermination()
    assert same(keyed.read_history(spark, target, "k", "seq", ["tracked"]),
                history(spark.createDataFrame(log, LOG), "k", "seq", ["tracked"]))


def test_newest_load_is_read_and_a_repeated_one_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "dim")
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    put = lambda day, df: refresh.write_load(df, path, T0 + timedelta(days=day))
    put(0, rows("a", "b"))
    put(1, rows("torn"))
    put(1, rows("a", "c"))
    assert sorted(r.name for r in refresh.read_load(spark, path).collect()) == ["a", "c"]
    put(0, rows("old"))
    assert sorted(r.name for r in refresh.read_load(spark, path).collect()) == ["a", "c"]
    assert refresh.read_load(spark, path).columns == ["name"]


def ride(ride_id, at, **values):
    return {f.name: None for f in RIDE.fields} | {"ride_id": ride_id, "booking_timestamp": at} | values


def sent(spark, *rides):
    return messages.to_messages(spark.createDataFrame(list(rides), RIDE))


def run_silver(spark, tmp_path):
    source = lambda name, schema: spark.readStream.schema(schema).parquet(str(tmp_path / name))
    united = live.unite_feeds(source("live", ENVELOPE), source("historical", RIDE), dedup=True)
    start(live.write_silver(united, str(tmp_path / "silver")), str(tmp_path / "cp")).awaitTermination()


def test_silver_stream_unites_feeds_and_keeps_late_history(spark, tmp_path):
    put_live = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "live"))
    put_old = lambda *r: (spark.createDataFrame(list(r), RIDE).coalesce(1).write.mode("append")
                          .parquet(str(tmp_path / "historical")))
    bad = sent(spark, ride("x", "y")).withColumn("value", F.lit("{bad").cast("binary"))
    put_live(sent(spark, ride("L1", "2026-05-10T10:00:00", booker_name="A"), ride("L1", "2026-05-10T10:00:00",
                                                                                  booker_name="A")).unionByName(bad))
    put_old(ride("H1", "2026-04-01T00:00:00"))
    run_silver(spark, tmp_path)
    # A second run: a resent live ride, a new one, and history far older than the watermark.
    put_live(sent(spark, ride("L1", "2026-05-10T10:00:00", booker_name="A"), ride("L2", "2026-05-10T11:00:00")))
    put_old(ride("H0", "2020-01-01T00:00:00"), ride("H2", "bad time"))
    run_silver(spark, tmp_path)
    got = live.read_silver(spark, str(tmp_path / "silver"))
    assert sorted(r.ride_id for r in got.collect()) == ["H0", "H1", "H2", "L1", "L2"]
    assert [r.records for r in live.read_quarantine(spark, str(tmp_path / "silver")).collect()] == ["{bad"]
    assert got.where("ride_id = 'L1'").first().booker_name == silver.conform(
        spark.createDataFrame([ride("L1", None, booker_name="A")], RIDE)).first().booker_name


def test_bronze_stream_keeps_messages(spark, tmp_path):
    sent(spark, ride("L1", "2026-05-10T10:00:00")).write.parquet(str(tmp_path / "in"))
    stream = messages.file_feed(spark, str(tmp_path / "in"), max_files=1)
    start(live.land_messages(stream, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == [*ENVELOPE.fieldNames(), "records"]
    assert json.loads(got.first().records)["ride_id"] == "L1"


def test_hourly_report_is_final_after_the_watermark(spark, tmp_path):
    rows = [("2026-05-10 10:05:00", 1.0), ("2026-05-10 10:55:00", 2.5), ("2026-05-11 12:00:00", 9.0)]
    (spark.createDataFrame(rows, "at string, v double").withColumn("at", F.col("at").cast("timestamp"))
     .write.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema("at timestamp, v double").parquet(str(tmp_path / "in"))
    start(append_to(live.hourly_live(stream, "at", value="v"), str(tmp_path / "out")), str(tmp_path / "cp")
          ).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(str(r.hour_start), r.rides, r.amount) for r in got] == [("2026-05-10 10:00:00", 2, 3.5)]


def test_refresh_is_incremental_and_repeatable(spark, tmp_path):
    from datetime import datetime, timezone

    from tripmart.sources import files
    from tripmart.streaming.refresh import read_gold, refresh

    root, landing = str(tmp_path / "lake"), tmp_path / "landing"
    (tmp_path / "mapping").mkdir()
    (tmp_path / "live").mkdir()
    old = lambda name, *r: files.write_csv(spark.createDataFrame(list(r), RIDE).coalesce(1), str(landing / name))
    at = lambda day: datetime(2026, 6, day, tzinfo=timezone.utc)
    live_at = lambda *r: (sent(spark, *r).coalesce(1).withColumn("timestamp", F.lit(at(5)))
                          .write.mode("append").parquet(str(tmp_path / "live")))

    def run(day):
        feed = messages.file_feed(spark, str(tmp_path / "live"))
        refresh(spark, root, str(landing), None, at(day), feed)
        return {r.ride_id: r.total_fare for r in read_gold(spark, root, "fact_rides").collect()}

    old("a", ride("H1", "2026-04-01T00:00:00", total_fare=1.0, booker_id="B1", booker_name="old"))
    live_at(ride("L1", "2026-05-10T10:00:00", total_fare=2.0, booker_id="B1", booker_name="new"))
    assert run(1) == {"H1": 1.0, "L1": 2.0}
    assert run(2) == {"H1": 1.0, "L1": 2.0}
    old("b", ride("H1", "2026-04-01T00:00:00", total_fare=9.0, booker_id="B1", booker_name="old"))  # a correction
    live_at(ride("L2", "2020-01-01T00:00:00", total_fare=3.0, booker_id="B2"))                      # very late
    assert run(3) == {"H1": 9.0, "L1": 2.0, "L2": 3.0}
    want = silver.conform(spark.createDataFrame([ride("x", None, booker_name="new")], RIDE)).first().booker_name
    bookers = {r.booker_id: r.booker_name for r in read_gold(spark, root, "dim_booker").collect()}
    assert bookers == {"B1": want, "B2": None}


def _message(spark, folder, rows, number):
    body = [(json.dumps(r).encode() if isinstance(r, dict) else r.encode(),) for r in rows]
    values = spark.createDataFrame(body, "value binary").select(*[
        F.col("value") if f.name == "value" else F.lit(T0 if f.name == "timestamp" else None).cast(f.dataType).alias(f.name)
        for f in ENVELOPE.fields])
    values.coalesce(1).write.parquet(str(folder / f"part{number}"))


def _raw(ride_id, fare):
    return {f.name: None for f in RIDE.fields} | {"ride_id": ride_id, "booking_timestamp": "2026-01-05T08:30:00",
                                                  "total_fare": fare, "booker_id": "B1", "driver_id": "D1", "vehicle_id": "V1"}


def test_refresh_with_feeds_that_come_and_go(spark, tmp_path, monkeypatch):
    """Live only, then both, then files only; a load that died before its manifest; rows without an id; references."""
    root, landing, mapping, sent = (tmp_path / n for n in ("root", "landing", "mapping", "sent"))
    for folder in (landing, mapping, sent):
        folder.mkdir()
    for name, schema in REFERENCE.items():
        (mapping / f"{name}.json").write_text(json.dumps([{f.name: None for f in schema.fields} | {schema.fieldNames()[0]: 1}]))

    def run(live, number):
        stream = messages.file_feed(spark, f"{sent}/*") if live else None
        refresh.refresh(spark, str(root), str(landing), str(mapping), T0 + timedelta(days=number), stream)
        return {r.ride_id: r.total_fare for r in refresh.read_gold(spark, str(root), "fact_rides").collect()}

    _message(spark, sent, [_raw("L1", 1.0), "{bad", _raw(None, 5.0)], 0)
    assert run(True, 0) == {"L1": 1.0}
    (landing / "a.json").write_text(json.dumps([_raw("H1", 2.0), _raw(None, 3.0), _raw(None, 4.0)]))
    _message(spark, sent, [_raw("L2", 1.5)], 1)
    assert run(True, 1) == {"L1": 1.0, "L2": 1.5, "H1": 2.0}

    # a load writes its rows and dies before it is named; then another file arrives
    (landing / "b.json").write_text(json.dumps([_raw("H2", 6.0)]))
    with monkeypatch.context() as broken:
        broken.setattr(bronze, "count_per_file", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run(False, 2)
    (landing / "c.json").write_text(json.dumps([_raw("H3", 7.0)]))
    want = {"L1": 1.0, "L2": 1.5, "H1": 2.0, "H2": 6.0, "H3": 7.0}
    assert run(False, 3) == want and run(True, 4) == want
    silver_rows = live.read_silver(spark, f"{root}/silver/rides").collect()
    assert sorted(r.ride_id for r in silver_rows) == sorted(want)
    assert live.read_quarantine(spark, f"{root}/silver/rides").count() == 4
    assert spark.read.parquet(f"{root}/bronze/live_messages").count() == 4
    assert refresh.read_gold(spark, str(root), "dim_ride_option").count() == 1
    assert refresh.read_gold(spark, str(root), "dim_province").count() == 1


def test_files_of_a_feed_go_once_they_are_landed(spark, tmp_path):
    """Batches of bounded bytes; the files of committed batches are deleted, the landed messages are all there."""
    rides = [ride(f"L{i}", "2026-05-10T10:00:00") for i in range(6)]
    for r in rides:
        sent(spark, r).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        feed = messages.file_feed(spark, str(tmp_path / "in"), max_bytes=1, clean=True)
        start(live.land_messages(feed, str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
        return sorted(json.loads(r.records)["ride_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [r["ride_id"] for r in rides]
    assert len(list((tmp_path / "in").glob("*.parquet"))) <= 2
    sent(spark, ride("L6", "2026-05-10T11:00:00")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [*[r["ride_id"] for r in rides], "L6"]


def test_one_batch_of_upserts_is_read_without_a_shuffle(spark, tmp_path):
    log, target = random_log(10, 60), str(tmp_path / "rows")
    rows = spark.createDataFrame(log, LOG)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    keyed._append(latest(rows.where("seq < 5"), "k", "seq"), target, 3)
    first = keyed.read_upserted(spark, target, "k", "seq")
    assert "Exchange" not in plan(first) and same(first, latest(rows.where("seq < 5"), "k", "seq"))
    keyed._append(latest(rows.where("seq >= 5"), "k", "seq"), target, 4)
    both = keyed.read_upserted(spark, target, "k", "seq")
    assert "Exchange" in plan(both) and same(both, latest(rows, "k", "seq"))
