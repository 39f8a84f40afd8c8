"""Merkle manifests against a tree built in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tripmart.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 8 * 8
        out.append((level[first:at], level[at + 1:first + 8]))
        at //= 8
    return out


def folded(leaf, path):
    for left, right in path:
        leaf = sha(*left, leaf, *right)
    return leaf


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, path) for rows in the order of FIELDS."""
    parts = {}
    for r in rows:
        parts.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([p[2] for p in sorted(parts[x], key=lambda p: p[:3])]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(parts[x], key=lambda p: p[:3])):
            path = way(trees[x], i) + way(top, n)
            out.append((r, leaf, trees[x][-1][0], top[-1][0], "".join(d for a, b in path for d in a + b), path))
    return out


def manifest(df, stride=2):
    return merkle.manifest(df, "lang", "doc_id", FIELDS, [F.col("doc_id")], stride)


def many(spark, n=700):
    rows = [(i if i % 50 else None, f"text {i}", "en" if i % 9 else ["de", None, "fr", "ß", "\U0001F600", "z"][i // 9 % 6],
             None if i % 4 else "s", i) for i in range(n)]
    return spark.createDataFrame([*rows, rows[1], rows[1], (5, "Alone", "xx", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


@pytest.mark.parametrize("stride", [1, 2, 3])
def test_equals_brute_force(spark, docs, stride):
    for df in (docs, many(spark)):
        got = sorted((r.item.doc_id or -1, r.leaf, r.subroot, r.root, "".join(a + b for a, b in r.path))
                     for r in manifest(df, stride).collect())
        want = sorted((r[0] or -1, *facts[:4]) for r, *facts in brute([tuple(r) for r in df.select(*FIELDS).collect()]))
        assert got == want


def test_fold_and_proof(spark):
    df = many(spark)
    rows = manifest(df).select("*", merkle.fold(F.col("leaf"), F.col("path")).alias("good"), merkle.proof(F.col("path")).alias("p"),
                               merkle.fold(F.sha2(F.lit("other"), 256), F.col("path")).alias("bad")).collect()
    assert len(rows) == df.count() and {r.good for r in rows} == {rows[0].root}
    assert all(r.bad != r.root for r in rows)
    assert max(len(r.path) for r in rows) == 4 + 1 and min(len(r.path) for r in rows) == 1


def test_one_row_and_one_part(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (row,) = manifest(spark.createDataFrame([(1, None, None, None, None)], schema)).collect()
    assert row.leaf == row.subroot == row.root == leaf_of((1, None, None, None, None)) and row.path == []
    rows = manifest(spark.createDataFrame([(i, "x" * 100_000, "en", None, 1) for i in range(9)], schema)).collect()
    assert {len(r.path) for r in rows} == {2} and {r.root for r in rows} == {rows[0].subroot}
    # the ninth leaf is alone in its run
    assert [s for r in rows for s in r.path[:1] if not s.left and not s.right] == [("", "")]


def test_no_rows(no_docs):
    assert manifest(no_docs).collect() == []


def test_query(spark, sf_dir):
    from tripmart.llm.queries import QUERIES
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op11_merkle"](spark, sf_dir).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text[r.doc_id] is not None \
            and any("A" <= c <= "Z" for c in text[r.doc_id])
        assert r.verified == (not changed) == (r.folded_root == r.root)
