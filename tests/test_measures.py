"""Exact quantiles, mergeable distinct counts, marts by deltas, offset intervals and table comparison against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tripmart.operators import deltas, distinct, offsets, quantiles, reconcile


@pytest.mark.parametrize("limits", [{}, {"buckets": 4, "rows_to_order": 3}, {"buckets": 2, "rows_to_order": 0}])
def test_exact_quantiles(spark, limits):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([rng.gauss(0, 1), 7.0, rng.random() * 1e9, -1e308, 1e308, None, math.nan]),
             rng.randrange(5)) for _ in range(400)] + [("c", None, 1), ("d", 2.5, 1)]
    fractions = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(rows, "k string, x double, y int"), ["k"], ["x", "y"], fractions, **limits)
    want = {}
    for k in ["a", "b", "c", "d", None]:
        for m, i in (("x", 1), ("y", 2)):
            values = sorted(r[i] for r in rows if r[0] == k and r[i] is not None and not math.isnan(r[i]))
            for f in fractions if values else []:
                want[k, m, f] = (len(values), values[max(1, len(values) - math.floor(len(values) - f * len(values))) - 1])
    assert {(r.k, r.measure, r.fraction): (r.n, r.value) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("block", [7, 1000])
def test_landed_intervals(spark, block):
    """Gaps and copies planted across block borders; one partition holds most messages."""
    held = [i for i in range(-20, 300) if not (40 <= i < 65 or i in (90, 91, 140, 203))]
    rows = [("t", 0, i) for i in held + [5, 5, 77, 139]] + [("t", 1, 9), ("t", 1, None), (None, 0, 6), (None, 0, 7)]
    df = spark.createDataFrame(rows, "topic string, part int, at long")
    got = {(r.topic, r.part, r.first): (r.last, r.messages, r.missing_after)
           for r in offsets.landed_intervals(df, ["topic", "part"], "at", block).where("topic IS NOT NULL").collect()}
    assert got == {("t", 0, -20): (39, 62, 25), ("t", 0, 65): (89, 26, 2), ("t", 0, 92): (139, 49, 1), ("t", 0, 141): (202, 62, 1),
                   ("t", 0, 204): (299, 96, None), ("t", 1, 9): (9, 1, None)}
    copies = {(r.offset, r.copies) for r in offsets.repeated_offsets(df, ["topic", "part"], "at").collect()}
    assert copies == {(5, 3), (77, 2), (139, 2)}
    assert offsets.landed_intervals(df.limit(0), ["topic", "part"], "at").count() == 0


def test_comparison_of_tables(spark):
    rng = random.Random(4)
    left = [(rng.randrange(400), rng.choice(["x", "y", None, ""]), rng.randrange(3)) for _ in range(900)] + [(None, "n", 1)] * 3
    right = [r for r in left if rng.random() > 0.01] + [(5000, "new", 1), (None, "m", 1)] + [left[3]] * 2
    right = [(k, "changed" if rng.random() < 0.01 else v, n) for k, v, n in right]
    a, b = (spark.createDataFrame(r, "k int, v string, n int").repartition(3) for r in (left, right))
    by_key = lambda rows: {k: Counter(r for r in rows if r[0] == k) for k in {r[0] for r in left + right}}
    want, old, new = Counter(), by_key(left), by_key(right)
    for k in old:
        gone, come = sum((old[k] - new[k]).values()), sum((new[k] - old[k]).values())
        want.update({(k, "changed"): min(gone, come), (k, "missing"): max(gone - come, 0), (k, "extra"): max(come - gone, 0)})
    got = reconcile.compare_tables(a, b, ["k"], ["k", "v", "n"])
    assert Counter((r.k, r.kind) for r in got.collect()) == +want and sum(want.values()) > 10
    assert reconcile.compare_tables(a, a.repartition(5), ["k"], ["k", "v", "n"]).count() == 0
    apart = reconcile.differing_buckets(*[reconcile.digest_tree(t, ["k"], ["k", "v", "n"]) for t in (a, b)]).count()
    assert 0 < apart <= len({k for (k, _), n in want.items() if n})


def test_distinct_counts_from_bitmaps(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(6), f"u{rng.randrange(300)}") for _ in range(1500)] + [(2, None), (9, None)]
    df = spark.createDataFrame(rows, "day int, who string").repartition(4)
    numbers = distinct.numbered(df, "who")
    ids = sorted(r.number for r in numbers.collect())
    assert ids == list(range(1, len({w for _, w in rows if w}) + 1))
    maps = distinct.bitmaps(df, ["day"], numbers, "who")
    assert {r.day: r.distinct for r in distinct.count_distinct(maps, ["day"]).collect()} == {
        d: len({w for e, w in rows if e == d and w}) for d in range(6)}
    assert distinct.count_distinct(maps.withColumn("all", maps.day * 0), ["all"]).first().distinct == len(ids)
    wide = spark.range(70_000).selectExpr("cast(id as string) AS who", "1 AS day")
    maps = distinct.bitmaps(wide, ["day"], distinct.numbered(wide, "who"), "who")
    assert maps.count() == 3 and distinct.count_distinct(maps, ["day"]).first().distinct == 70_000


def test_marts_by_deltas(spark):
    """Corrections move rows between groups, empty a group, come late and twice; the mart equals a full recompute."""
    rng, state, mart, rows = random.Random(6), None, None, {}
    for batch in range(4):
        arriving = [(rng.randrange(40), rng.randrange(6), rng.choice("abc"), rng.choice([None, rng.randrange(100)])) for _ in range(30)]
        df = spark.createDataFrame(arriving, "id int, seq int, g string, v long")
        changes = deltas.changed_rows(state, df, "id", "seq", ["g", "v"])
        changes = spark.createDataFrame(changes.collect(), changes.schema)
        mart = spark.createDataFrame(*(lambda m: (m.collect(), m.schema))(deltas.merged_sums(mart, changes, ["g"], ["v"])))
        state = spark.createDataFrame(*(lambda s: (s.collect(), s.schema))(deltas.merged_state(state, changes, "id")))
        now = {r.id: r for r in state.collect()}
        best = defaultdict(lambda: -1)
        for i, seq, *_ in [*((i, r[0]) for i, r in rows.items()), *arriving]:
            best[i] = max(best[i], seq)
        assert {i: r.seq for i, r in now.items()} == dict(best)
        rows = {i: (r.seq, r.g, r.v) for i, r in now.items()}
        sums = defaultdict(lambda: [0, 0])
        for _, g, v in rows.values():
            sums[g][0] += 1
            sums[g][1] += v or 0
        assert {r.g: [r.rows, r.v] for r in mart.collect()} == dict(sums)
