"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripmart.llm import negatives

SCHEMA = "id long, vec array<float>, label int, vec_id string, row int, vector string"


def vectors(seed=5, n=260, width=6):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-0.4, 0.9) for _ in range(width)], rng.choice([0, 1, 1, 1, 2, 3])) for i in range(n)]
    rows += [(1000 + i, rows[20][1], i % 2) for i in range(30)]  # ties
    rows += [(20, rows[20][1], 1), (40, rows[3][1], 1), (None, rows[7][1], 1), (None, rows[7][1], 2)]
    rows += [(2000, None, 1), (2020, [0.5] * 6, None), (2040, [0.5, None] * 3, 1), (2060, [float("nan")] * 6, 1),
             (2080, [float("inf")] + [0.1] * 5, 2), (2100, [], 1), (2120, [0.7, 0.2], 1), (2140, [-9.5] * 6, 1), (2160, [1.0] * 9, 9)]
    return rows


def brute(rows, k=5, m=10, low=30, high=90):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab, n) for n, (i, v, lab) in enumerate(rows)
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in kept:
        if a[0] is None or a[0] % 20:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[1], b[1])), b[0] is None, b[0] or 0, b) for b in kept if b is not a),
                        key=lambda s: s[:3])
        for p in [s for s in scored if s[3][2] == a[2]][:k]:
            fits = [s for s in scored if s[3][2] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:m]
            out += [(a[0], p[3][0], r, s[3][0], -p[0], -s[0]) for r, s in enumerate(fits, 1)]
    return out


def plain(rows):
    return sorted(rows, key=lambda r: tuple(-1 if v is None else v for v in r))


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    return plain(tuple(r) for r in negatives.mine(df, "id", F.col("label"), "vec", F.col("id") % 20 == 0, **options).collect())


@pytest.mark.parametrize("options", [{}, {"rows_per_group": 17}, {"positives": 2, "negatives": 3, "most_percent": 100}])
def test_equals_brute_force(spark, options):
    rows = vectors()
    want = brute(rows, options.get("positives", 5), options.get("negatives", 10), 30, options.get("most_percent", 90))
    assert mined(spark, rows, **options) == plain(want) and len(want) > 100


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-3000, 4000) for _ in range(40)], i % 3) for i in range(120)]
    assert negatives.exact_kind(256 * 4000, 40) == np.float64
    assert mined(spark, rows) == plain(brute(rows))
    assert negatives.exact_kind(1 << 20, 1 << 14) == np.int64


def test_nothing_to_find(spark):
    rows = [(0, [1.0], 1), (20, [1.0], 2), (3, [-1.0], 1)]
    assert mined(spark, rows) == brute(rows) == []
    df = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(df, "id", F.col("label"), "vec", F.col("id") % 20 == 0).collect() == []


def test_best_keeps_first_of_ties():
    scores = np.array([5, 7, 7, 1, 7, 9])
    assert negatives._best(scores, np.arange(6), 3).tolist() == [5, 1, 2]
    assert negatives._best(scores, np.array([0, 3]), 3).tolist() == [0, 3]
