"""Mixing, decontamination and licence scans against brute force."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict
from decimal import Decimal

import pytest

from tripmart.llm import decontaminate, licenses, mixing

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = Decimal(sum(sizes.values())), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            target.update({s: level * weight[s] for s in free})
            break
        for s in over:
            target[s] = Decimal(most * sizes[s])
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 50, None: 7}, {"a": 0, "b": 0},
                                   {"x": 5}, {"a": 100, "b": 3, "c": 2, "d": 1, "e": 900, "f": 1, "g": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 3).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - float(want[s])) < 1e-6 for s in want)


@pytest.mark.parametrize("rows_per_slice", [mixing.ROWS_PER_SLICE, 2])
def test_plan(docs, rows_per_slice):
    rows = mixing.plan_mix(docs, rows_per_slice=rows_per_slice).collect()
    source = Counter(r.source for r in docs.collect())
    assert Counter(r.source for r in rows) == source
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(spaced(r.text))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert 0 <= r["copies"] <= 3 and r.source_size == sizes[r.source]
        taken[r.source] += r["size"] * r["copies"]
        largest[r.source] = max(largest[r.source], r["size"])
    want = brute_targets(dict(sizes))
    for s, t in want.items():
        assert abs(taken[s] - float(t)) <= largest[s] + 1
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.plan_mix(docs, rows_per_slice=rows_per_slice).collect()), key=str)


@pytest.mark.parametrize("rows_per_slice", [mixing.ROWS_PER_SLICE, 2])
def test_one_order_at_every_size(spark, docs, rows_per_slice):
    """Places by size desc, doc_id with null last: the order of the SQL twin, not of any cut."""
    rows = [(i * 7919 % 1000, "w " * (1 + i % 2), f"s{i % 3}") for i in range(600)] + [(None, "w", "s0"), (5, "w v", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.plan_mix(df, rows_per_slice=rows_per_slice).collect()
    assert len(plan) == len(rows)
    want, target = {}, {r.source: r.target / r.source_size for r in plan}
    for source, share in target.items():
        digest = hashlib.md5(("17:" + ("\x01" if source is None else source)).encode()).hexdigest()
        up_to = lambda place: math.floor(place * share + int(digest[:8], 16) / 2**32)
        of = sorted((r for r in rows if r[2] == source), key=lambda r: (-len(spaced(r[1])), r[0] is None, r[0]))
        want |= {(i, source): min(up_to(n + 1) - up_to(n), 3) for n, (i, _, _) in enumerate(of)}
    assert {(r.doc_id, r.source): r["copies"] for r in plan} == want
    key = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    assert key(mixing.plan_mix(docs, rows_per_slice=rows_per_slice)) == key(mixing.plan_mix(docs))


def test_mix_emits_what_is_planned(docs):
    plan = Counter()
    for r in mixing.plan_mix(docs).collect():
        plan[r.doc_id, r.source, r["size"]] += r["copies"]
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_copy"]
    got = Counter((r.doc_id, r.source, len(spaced(r.text))) for r in out.collect())
    assert got == +plan


def test_mix_of_nothing(no_docs):
    assert mixing.plan_mix(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


ITEMS = ["one two three four five six seven eight nine ten eleven twelve", "a b c", "", None, "...",
         "la la la la la la la la la la la", "short item"]


def brute_hits(text, items):
    words, hit, ids = alnum(text), set(), set()
    for item_id, item in items:
        found = alnum(item)
        n = min(len(found), 10)
        windows = {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if found else set()
        for i in range(len(words) - n + 1) if found else ():
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(str(item_id))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("bound", [decontaminate.BROADCAST_ROWS, 0])
def test_contamination(spark, docs, texts, bound, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    items = list(enumerate([*ITEMS, " ".join(texts[12].split()[20:45]), texts[17][5000:5400]]))
    extra = [(200, "x y One two THREE four five six seven-eight nine ten q one two three four five six seven eight nine"),
             (201, "one two three four five six seven eight nine"), (202, "zz short item")]
    all_docs = docs.select("doc_id", "text", "_key", "n_words").unionByName(
        spark.createDataFrame([(i, t, 2, "x") for i, t in extra], "doc_id long, text string, _key int, n_words string"))
    bench = spark.createDataFrame([*items, items[0], (None, "b b b")], "item_id long, text string")
    out = decontaminate.contamination(all_docs, bench)
    assert out.columns == ["doc_id", "text", "_key", "n_words", "_n_words", "n_hit", "item_ids"]
    got = out.collect()
    assert len(got) == all_docs.count()
    for r in got:
        assert (r["_n_words"], r.n_hit, r.item_ids) == brute_hits(r.text, items), r.doc_id
    kept = decontaminate.clean(all_docs, bench)
    assert kept.columns == all_docs.columns
    assert Counter(r.text for r in kept.collect()) == Counter(r.text for r in got if not r.n_hit)


def test_contamination_of_nothing(docs, no_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, none).collect()} == {0}


def test_native_plans(docs):
    for df in (mixing.plan_mix(docs), mixing.mix(docs), decontaminate.clean(docs, docs.selectExpr("doc_id AS item_id", "text")),
               licenses.scan(docs)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


LICENSED = [
    (1, "All rights reserved. CC-BY 4, the GNU general PUBLIC license; all all rights reserved", 4, 0, 12, "cc-by,gpl,reserved"),
    (2, "all rights", 0, None, None, ""),
    (3, None, 0, None, None, ""),
    (4, "cc by cc by", 2, 0, 2, "cc-by"),
    (5, "General public licenses and ccby", 0, None, None, ""),
]


def test_licenses(spark, docs):
    rows = [(i, t) for i, t, *_ in LICENSED]
    out = licenses.scan(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string"))
    got = out.collect()
    assert len(got) == 6
    for r in got:
        _, text, n, first, last, labels = LICENSED[r.doc_id - 1]
        assert (r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == (n, first, last, labels)
        assert r.n_words == len(alnum(text)) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    out = licenses.scan(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licenses_with_drift(spark):
    text = ("x " * 5 + "Permission is hereby granted, free of any charge, to any person obtaining a copy of this fine software " + "y " * 9)
    far = "permission is hereby granted by us all and now free of charge for ever to a friend"
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(1, text), (2, far)], "doc_id long, text string")).collect()}
    assert got[1].labels == ["mit"] and got[1].score >= licenses.COVERAGE and not got[1].base_labels
    assert got[2].labels == []
