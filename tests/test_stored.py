"""Bucketed tables, points in boxes, corrections of closed hours: against plain forms, and the plans they promise."""

import random
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tripmart.operators.grid import box_cells, in_boxes, with_boxes
from tripmart.operators.latest import upsert
from tripmart.plans import audits
from tripmart.plans.tables import merged, save_bucketed, table_or_none, upsert_bucketed
from tripmart.streaming import corrections, rides as live
from tripmart.streaming.runs import append_to, start

LOG = "k int, j string, seq long, v double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select(*b.columns).collect()), key=str)
    return key(a) == key(b)


def rows(seed, n, nulls=True):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice([*v, None] if nulls else v)
    return [(pick(*range(12)), pick("a", "b"), pick(1, 2, 3), pick(0.5, 1.5)) for _ in range(n)]


@pytest.fixture
def name(spark):
    yield (found := f"t_{uuid.uuid4().hex[:8]}")
    for t in (found, f"{found}_next"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_upserts_into_buckets_equal_upserts(spark, name, tmp_path):
    want, keys = None, ["k", "j"]
    for i in range(4):
        part = spark.createDataFrame(rows(i, 60) if i != 2 else [], LOG)
        want = upsert(want, part, keys, "seq")
        got = upsert_bucketed(part, name, keys, "seq", 4, str(tmp_path / f"v{i}"))
        assert got.columns == part.columns and same(got, want)
    assert spark.catalog.tableExists(name) and not spark.catalog.tableExists(f"{name}_next")


def test_a_run_that_died_before_the_rename_is_taken_up(spark, name, tmp_path):
    first, second = (spark.createDataFrame(rows(i, 30), LOG) for i in (5, 6))
    assert table_or_none(spark, name) is None
    save_bucketed(upsert(None, first, ["k", "j"], "seq"), f"{name}_next", ["k", "j"], 4, str(tmp_path / "a"))
    got = upsert_bucketed(second, name, ["k", "j"], "seq", 4, str(tmp_path / "b"))
    assert same(got, upsert(first, second, ["k", "j"], "seq"))


def _with(spark, settings, fn):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_the_stored_side_is_not_shuffled(spark, name, tmp_path):
    stored = spark.createDataFrame(rows(7, 50, nulls=False), LOG).dropDuplicates(["k", "j"])
    save_bucketed(stored, name, ["k", "j"], 8, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").glob("*.parquet"))) <= 8
    arriving = spark.createDataFrame(rows(8, 50), LOG)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}

    def check(joined):
        side = joined.split("FullOuter" if "FullOuter" in joined else "LeftOuter", 1)[1]
        scan = next(line for line in side.splitlines() if "FileScan parquet" in line)
        above = side[:side.index(scan)]
        return scan, above

    scan, above = _with(spark, settings, lambda: check(plan(merged(spark.table(name), arriving, ["k", "j"], "seq"))))
    assert "Bucketed: true" in scan and "Exchange" not in above
    fact = spark.range(100).select(F.col("id"), (F.col("id") % 12).cast("int").alias("k"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("id") % 2 + 1).cast("int")).alias("j"))
    star = _with(spark, settings, lambda: plan(fact.join(spark.table(name), ["k", "j"], "left")))
    assert "SelectedBucketsCount: 8 out of 8" in star and star.count("Exchange") == 1


X0 = ["min_x", "min_y", "max_x", "max_y"]


def _boxes(rnd, n):
    out = []
    for i in range(n):
        side = rnd.choice([0.0, 0.01, 0.125, 1.0, 7.0, 300.0])
        x, y = rnd.choice([-1, 1]) * rnd.randrange(80) / 8, rnd.randrange(-80, 80) / 8
        out.append((i, x, y, x + side, y + side * rnd.random()))
    return out + [(n, None, 0.0, 1.0, 1.0), (n + 1, 1.0, 1.0, 0.0, 2.0), (n + 2, float("-inf"), 0.0, float("inf"), 1.0),
                  (n + 3, float("nan"), 0.0, 1.0, 1.0)]


def test_points_in_boxes_equal_all_pairs(spark):
    rnd = random.Random(3)
    boxes = _boxes(rnd, 60)
    points = [(i, rnd.randrange(-90, 90) / 8, rnd.randrange(-90, 90) / 8) for i in range(300)]
    points += [(300, None, 1.0), (301, float("nan"), 1.0), (302, float("inf"), 0.0), (303, 1e300, 0.0), (304, boxes[0][3], boxes[0][4])]
    df, areas = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(
        boxes, "b int, min_x double, min_y double, max_x double, max_y double")
    valid = [b for b in boxes if None not in b and all(abs(v) < 1e9 for v in b[1:]) and b[1] <= b[3]]
    want = sorted((p[0], b[0]) for p in points if p[1] is not None and abs(p[1]) < 1e9 for b in valid
                  if b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4])
    found = in_boxes(df, "x", "y", areas)
    assert sorted((r.p, r.b) for r in found.collect()) == want and len(want) > 500
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    by_point = {r.p: list(r.boxes) for r in with_boxes(df, "x", "y", areas, "b").collect()}
    assert by_point == {p[0]: [b for q, b in want if q == p[0]] for p in points}
    assert box_cells(areas).groupBy("b").count().agg(F.max("count")).first()[0] <= 25
    with pytest.raises(ValueError):
        in_boxes(df, "x", "y", areas.withColumn("x", F.lit(1)))


def test_no_boxes_and_no_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "p int, x double, y double")
    areas = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0)], "b int, min_x double, min_y double, max_x double, max_y double")
    assert in_boxes(df, "x", "y", areas.limit(0)).count() == 0 and in_boxes(df.limit(0), "x", "y", areas).count() == 0
    assert [list(r.boxes) for r in with_boxes(df, "x", "y", areas.limit(0), "b").collect()] == [[]]


def test_rides_outside_their_province(spark):
    areas = spark.createDataFrame([("A", 0.0, 0.0, 1.0, 1.0), ("B", 0.5, 0.5, 2.0, 2.0)],
                                  "province_id string, min_lat double, min_lon double, max_lat double, max_lon double")
    fact = spark.createDataFrame([("in", "A", 1.0, 0.0), ("other", "A", 1.5, 1.5), ("none", "B", 3.0, 3.0), ("both", "C", 0.7, 0.7),
                                  ("lost", "A", None, 1.0), ("nowhere", None, 0.1, 0.1)],
                                 "ride_id string, pickup_city_id string, pickup_latitude double, pickup_longitude double")
    got = {r.ride_id: list(r.found_in) for r in audits.outside_area(fact, areas).collect()}
    assert got == {"other": ["B"], "none": [], "both": ["A", "B"], "lost": [], "nowhere": ["A"]}


def test_late_rows_are_booked_once(spark, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    day = lambda d, h, m=0: datetime(2026, 5, d, h, m)
    schema = "at timestamp, kind string, v double"
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        query = start(append_to(live.hourly_live(stream, "at", "kind", "v"), out), checkpoint)
        query.awaitTermination()
        return corrections.closed_until(query)

    put((day(1, 10), "a", 1.0), (day(3, 0), "a", 2.0))
    run()
    put((day(1, 10, 5), "a", 0.1), (day(1, 11), "b", 0.2), (day(3, 1), "a", 4.0), (None, "a", 9.0))  # two hours behind, one open
    until = run()
    landed, report = spark.read.parquet(path), spark.read.parquet(out)
    late = corrections.late_rows(landed, report, "at", ["kind"], "v", until)
    assert sorted((r.hour_start, r.kind, r.rides, r.amount) for r in late.collect()) == [
        (day(1, 10), "a", 1, 0.1), (day(1, 11), "b", 1, 0.2)]
    full = corrections.corrected(report, late, ["kind"])
    want = corrections.hourly(landed, "at", ["kind"], "v", until).withColumn("amount", F.col("amount").cast("double"))
    assert same(full, want) and full.count() == 2
    assert corrections.late_rows(landed, report.unionByName(late), "at", ["kind"], "v", until).count() == 0
