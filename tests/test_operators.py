"""Upserts, histories and as-of joins against hand-made rows and brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripmart.operators import asof, sizing
from tripmart.operators.asof import asof_join
from tripmart.operators.history import END, START, history, rebuild_touched
from tripmart.operators.joins import Dim, duplicate_keys, orphans, star_join, union_feeds
from tripmart.operators.latest import first_seen, latest, upsert

LOG = "k int, tracked string, other int, seq long"
FIXTURE = [(1, "A", 10, 1), (1, "A", 12, 2), (1, "B", 12, 3), (1, "A", 12, 4), (2, "X", 1, 1)]
VERSIONS = [(1, "A", 12, 1, 3), (1, "A", 12, 4, None), (1, "B", 12, 3, 4), (2, "X", 1, 1, None)]


def _versions(df):
    got = df.select("k", "tracked", "other", START, END).collect()
    return sorted((tuple(r) for r in got), key=str)


def brute_history(log):
    """Versions by walking each key's rows in order."""
    out = []
    for key in {r[0] for r in log}:
        rows = {}
        low = lambda s: -1 if s is None else s  # a null sequence comes first
        for r in sorted((r for r in log if r[0] == key), key=lambda r: (low(r[3]), r[1], r[2])):
            rows[r[3]] = r  # the last by tie-break wins
        rows = [rows[s] for s in sorted(rows, key=low)]
        start = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or rows[i][1] != rows[start][1]:
                last = rows[i - 1]
                out.append((key, last[1], last[2], rows[start][3], rows[i][3] if i < len(rows) else None))
                start = i
    return sorted(out, key=str)


def test_scd2_fixture(spark):
    assert _versions(history(spark.createDataFrame(FIXTURE, LOG), "k", "seq", ["tracked"])) == sorted(VERSIONS, key=str)


def random_log(seed, rows=600, keys=8):
    """Key 0 holds a third of all rows; sequences repeat, so there are ties and copies."""
    rnd = random.Random(seed)
    out = []
    for _ in range(rows):
        key = 0 if rnd.random() < 0.33 else rnd.randrange(keys)
        seq = None if rnd.random() < 0.01 else rnd.randrange(rows // 3)
        out.append((key, rnd.choice("AAB"), rnd.randrange(3), seq))
    return out + out[:20]


@pytest.mark.parametrize("rows_per_chunk", [10_000, 50, 3])
def test_scd2_hot_keys_equal_brute_force(spark, rows_per_chunk):
    log = random_log(rows_per_chunk)
    got = history(spark.createDataFrame(log, LOG), "k", "seq", ["tracked"], ["tracked", "other"],
                  rows_per_chunk=rows_per_chunk)
    assert _versions(got) == brute_history(log)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from("AB"), st.integers(0, 2), st.integers(0, 12)),
                min_size=1, max_size=40), st.randoms())
def test_scd2_properties(spark, log, rnd):
    shuffled = log[:]
    rnd.shuffle(shuffled)
    cut = rnd.randrange(len(log) + 1)
    frame = lambda rows: spark.createDataFrame(rows, LOG)
    whole = _versions(history(frame(log), "k", "seq", ["tracked"], ["tracked", "other"], rows_per_chunk=5))
    assert whole == brute_history(log)
    if 0 < cut < len(log):
        opts = {"tiebreak": ["tracked", "other"]}
        before = history(frame(shuffled[:cut]), "k", "seq", ["tracked"], **opts)
        after = rebuild_touched(before, frame(shuffled), frame(shuffled[cut:]), "k", "seq", ["tracked"], **opts)
        assert _versions(after) == whole
    for key in {v[0] for v in whole}:
        spans = sorted((v[3], v[4]) for v in whole if v[0] == key and v[4] is not None)
        open_spans = [v for v in whole if v[0] == key and v[4] is None]
        assert len(open_spans) == 1
        bounds = spans + [(open_spans[0][3], None)]
        assert all(a[1] == b[0] for a, b in zip(bounds, bounds[1:]))


def test_scd2_null_tracked_is_a_value(spark):
    log = [(1, None, 0, 1), (1, None, 1, 2), (1, "A", 1, 3)]
    got = _versions(history(spark.createDataFrame(log, LOG), "k", "seq", ["tracked"]))
    assert got == sorted([(1, None, 1, 1, 3), (1, "A", 1, 3, None)], key=str)


def test_scd1_two_batches(spark):
    frame = lambda rows: spark.createDataFrame(rows, "u string, v string, seq int")
    state = upsert(None, frame([("u1", "old", 1), ("u2", "late-winner", 9)]), "u", "seq")
    state = upsert(state, frame([("u1", "new", 2), ("u2", "stale", 3)]), "u", "seq")
    assert sorted(map(tuple, state.collect())) == [("u1", "new", 2), ("u2", "late-winner", 9)]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 4)), st.text("ab", max_size=2)),
                min_size=1, max_size=30), st.randoms())
def test_scd1_does_not_depend_on_arrival(spark, rows, rnd):
    frame = lambda r: spark.createDataFrame(r, "k int, seq int, v string")
    whole = sorted(map(tuple, latest(frame(rows), "k", "seq").collect()), key=str)
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    cut = rnd.randrange(len(rows) + 1)
    state = None
    for part in (shuffled[:cut], shuffled[cut:], shuffled[:cut]):  # the first part is replayed
        state = upsert(state, frame(part), "k", "seq")
    assert sorted(map(tuple, state.collect()), key=str) == whole
    best = {}
    for k, s, v in rows:
        best[k] = max(best.get(k, (-1, "")), (-1 if s is None else s, v))
    assert {k: (-1 if s is None else s, v) for k, s, v in whole} == best


def test_first_seen(spark):
    df = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2), ("u2", "x", 5), ("u3", "n", None)],
                               "u string, v string, seq int")
    assert sorted(r.v for r in first_seen(df, "u", "seq").collect()) == ["n", "old", "x"]


ROWS = [(1, 0), (1, 2), (1, 3), (1, 9), (2, 0), (3, 5), (1, None), (None, 5)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
@pytest.mark.parametrize("before_first,early", [("null", None), ("earliest", "A")])
def test_asof_fixture(spark, broadcast_rows, before_first, early):
    log = [*FIXTURE, (None, "N", 0, 1)]
    versions = history(spark.createDataFrame(log, LOG), "k", "seq", ["tracked"])
    rows = spark.createDataFrame(ROWS, "k int, at long")
    got = asof_join(rows, versions, "k", "at", ["tracked"], before_first=before_first, broadcast_rows=broadcast_rows)
    assert got.columns == ["k", "at", "tracked"]
    want = {(1, 0, early), (1, 2, "A"), (1, 3, "B"), (1, 9, "A"), (2, 0, "X" if early else None), (3, 5, None),
            (1, None, None), (None, 5, None)}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(ROWS)


@pytest.mark.parametrize("before_first", ["null", "earliest"])
@pytest.mark.parametrize("rows_per_chunk", [10_000, 20])
def test_asof_hot_keys_equal_broadcast(spark, before_first, rows_per_chunk):
    log = random_log(5, 400)
    versions = history(spark.createDataFrame(log, LOG), "k", "seq", ["tracked"], ["tracked", "other"]).where(
        F.col(START) > 20)  # nothing is valid in the beginning
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, 0 if rnd.random() < 0.4 else rnd.randrange(9), rnd.randrange(140))
                                  for i in range(700)], "id int, k int, at long")
    args = (rows, versions, "k", "at", ["tracked", "other"])
    small = asof_join(*args, before_first=before_first)
    large = asof_join(*args, before_first=before_first, broadcast_rows=0, rows_per_chunk=rows_per_chunk)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert small.count() == 700


def test_asof_many_versions_per_key_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(asof, "VERSIONS_PER_KEY", 2)
    versions = history(spark.createDataFrame(FIXTURE, LOG), "k", "seq", ["tracked"])
    rows = spark.createDataFrame(ROWS, "k int, at long")
    got = asof_join(rows, versions, "k", "at", ["tracked"])
    assert "_chunk" in got._jdf.queryExecution().toString()
    assert {tuple(r) for r in got.collect()} >= {(1, 0, "A"), (1, 3, "B")}


def test_asof_rejects_unknown_policy(spark):
    df = spark.createDataFrame(ROWS, "k int, at long")
    with pytest.raises(ValueError):
        asof_join(df, df, "k", "at", [], before_first="latest")


@pytest.mark.parametrize("moment", [lambda i: i, lambda i: i if i else -10 ** 9, lambda i: f"{i:05d}", lambda i: f"x{i % 1000:05d}"],
                         ids=["even", "burst", "text", "one prefix"])
def test_chunks_keep_order_and_bound_the_hot_key(spark, moment):
    rows = spark.createDataFrame([(0, moment(i)) for i in range(1000)] + [(1, moment(i)) for i in range(5)]
                                 + [(None, moment(i)) for i in range(150)], ["k", "t"])
    rest, hot = sizing.in_chunks(rows, ["k"], [F.col("t")], 100)
    assert {(r.k, r._chunk) for r in rest.collect()} == {(1, 0)} and hot.count() == 1150
    for key, n in (("k = 0", 1000), ("k IS NULL", 150)):
        chunks = [r._chunk for r in hot.where(key).orderBy("t").collect()]
        assert len(chunks) == n and chunks == sorted(chunks)
        assert max(chunks.count(c) for c in set(chunks)) <= 100
    assert sizing.in_chunks(rows, ["k"], [F.col("t")], 1000)[1] is None


def test_history_and_asof_of_a_bursty_text_ordered_hot_key(spark):
    """All but one change in the last moment, ordered by text: no chunk holds more than its share, results are exact."""
    rnd = random.Random(11)
    log = [(0, rnd.choice("AB"), i % 3, f"2026-01-31T23:59:{i:06d}" if i else "2001") for i in range(900)]
    log += [(1, "A", 0, "2026"), (None, "B", 1, "2025")] + log[:300]
    df = spark.createDataFrame(log, "k int, tracked string, other int, seq string")
    small = history(df, "k", "seq", ["tracked"], ["tracked", "other"])
    large = history(df, "k", "seq", ["tracked"], ["tracked", "other"], rows_per_chunk=40)
    assert _versions(large) == _versions(small)
    rows = spark.createDataFrame([(i, 0, f"2026-01-31T23:59:{rnd.randrange(950):06d}") for i in range(500)]
                                 + [(i, 0, "2026-01-31T23:59:000500") for i in range(400)] + [(7, 1, "2027"), (8, 1, None)],
                                 "id int, k int, at string")
    want, got = (sorted(map(tuple, asof_join(rows, small, "k", "at", ["tracked", "other"], **o).collect()), key=str)
                 for o in ({"broadcast_rows": 10 ** 6}, {"broadcast_rows": 0, "rows_per_chunk": 30}))
    assert got == want and len(got) == 902


def test_small_side_is_hinted_only_within_its_bound(spark):
    df = spark.range(10)
    assert sizing.fits(df, 10) and not sizing.fits(df, 9)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(sizing.small_side(df, 10)).lower()
    assert "broadcast" not in plan(sizing.small_side(df, 9)).lower()


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_star_join_keeps_every_row_and_both_roles(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    fact = spark.createDataFrame([(1, "a", "b"), (2, "b", None), (3, "z", "a")], "id int, p string, d string")
    dim = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "code string, name string")
    got = star_join(fact, [Dim(dim, "p", "code", ["name"], "pickup_"), Dim(dim, "d", "code", ["name"], "dropoff_")])
    assert got.columns == ["id", "p", "d", "pickup_name", "dropoff_name"]
    assert sorted((r.id, r.pickup_name, r.dropoff_name) for r in got.collect()) == [
        (1, "Alpha", "Beta"), (2, "Beta", None), (3, None, "Alpha")]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("policy", ["earliest", "null"])
def test_asof_plans_agree_on_open_starts_and_mixed_times(spark, policy):
    versions = spark.sql("""SELECT * FROM VALUES (1, 'a', NULL, TIMESTAMP'2026-01-05 10:00:00'),
        (1, 'b', TIMESTAMP'2026-01-05 10:00:00', TIMESTAMP'2026-01-07 00:00:00'), (1, 'c', TIMESTAMP'2026-01-07 00:00:00', NULL),
        (2, 'd', TIMESTAMP'2026-01-06 12:00:00', NULL), (NULL, 'e', NULL, NULL) AS t(k, v, __START_AT, __END_AT)""")
    rows = spark.sql("""SELECT * FROM VALUES (1, DATE'2026-01-04'), (1, DATE'2026-01-05'), (1, DATE'2026-01-06'),
        (1, DATE'2026-01-07'), (2, DATE'2026-01-06'), (2, DATE'2026-01-07'), (3, DATE'2026-01-07'), (1, NULL), (NULL, DATE'2026-01-07')
        AS t(k, day)""")
    first = "d" if policy == "earliest" else None
    want = sorted([(1, 4, "a"), (1, 5, "a"), (1, 6, "b"), (1, 7, "c"), (2, 6, first), (2, 7, "d"), (3, 7, None), (1, None, None),
                   (None, 7, None)], key=str)
    for options in ({}, {"broadcast_rows": 0}, {"broadcast_rows": 0, "rows_per_chunk": 2}):
        got = asof_join(rows, versions, "k", "day", ["v"], before_first=policy, **options).collect()
        assert sorted([(r.k, r.day and r.day.day, r.v) for r in got], key=str) == want, options


def test_rebuilding_null_keys(spark):
    log = spark.createDataFrame([(None, "a", 1), (None, "c", 5), (1, "x", 1), (2, "y", 1)], "k int, v string, seq int")
    late = spark.createDataFrame([(None, "b", 3), (2, "z", 2)], log.schema)
    every = log.unionByName(late)
    got = rebuild_touched(history(log, "k", "seq", ["v"]), every, late, "k", "seq", ["v"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, history(every, "k", "seq", ["v"]).collect()), key=str)


def test_union_by_name_and_integrity_helpers(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(2.5, 2)], "w double, id int")
    got = union_feeds(a, b)
    assert sorted(map(tuple, got.select("id", "v", "w").collect())) == [(1, "x", None), (2, None, 2.5)]
    assert duplicate_keys(union_feeds(a, a, b), ["id"]).collect()[0].id == 1
    child = spark.createDataFrame([(1,), (7,), (None,)], "fk int")
    assert [r.fk for r in orphans(child, a, "fk", "id").collect()] == [7]
