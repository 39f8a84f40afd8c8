"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.components import components
from tripmart.llm.hashing import mix64, odd_numbers, rows_of, set_digest, shingle_set
from tripmart.llm.text import column, free_names, written

#: Words of a shingle, and the link threshold in percent of the union.
SHINGLE, PERCENT = 5, 85
#: 80 permutations, whose minima and maxima make 160 values in 32 bands of 5. A pair at similarity 0.85 misses all
#: bands with a probability of (1 - 0.85^5)^32 = 7e-9.
PERMUTATIONS, BAND = 80, 5
#: After its middle, so many members of a bucket are compared with the others at a time.
LEADERS = 64

_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                        ("bands", pa.list_(pa.int64()))])
_SPARK_SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"


def signature_bands(sets: list[np.ndarray], permutations: int, band: int) -> np.ndarray:
    """A row of band hashes per non-empty set. Every permutation gives its minimum and its maximum.

    Bands hold minima only or maxima only: both are unbiased, and the two from one permutation fall into different
    bands.
    """
    values, starts = np.concatenate(sets), np.cumsum([0, *[len(s) for s in sets[:-1]]])
    turn, shift = odd_numbers(permutations, 2), odd_numbers(permutations, 3)
    ends = np.empty((2, permutations, len(sets)), np.uint64)
    for p in range(permutations):
        turned = values * turn[p] + shift[p]
        np.minimum.reduceat(turned, starts, out=ends[0, p])
        np.maximum.reduceat(turned, starts, out=ends[1, p])
    groups = ends.reshape(2 * permutations // band, band, len(sets))
    hashes = np.arange(1, len(groups) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(band):
        hashes = mix64(hashes ^ groups[:, i]) * np.uint64(2 * i + 3)
    return hashes.T


def _signatures(shingle: int, permutations: int, band: int):
    n_bands = 2 * permutations // band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, 1 << 19):
            sets = [shingle_set(t.as_py(), shingle) for t in rows.column("text")]
            full = [s for s in sets if len(s)]
            bands = signature_bands(full, permutations, band).view(np.int64) if full else np.empty((0, n_bands), np.int64)
            counts = np.array([len(s) > 0 for s in sets], np.int32) * n_bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                                             pa.array(np.ascontiguousarray(bands).reshape(-1)))
            yield pa.record_batch([rows.column("doc_id"), rows.column("text_hash"),
                                   pa.array([len(s) for s in sets], pa.int64()),
                                   pa.array([set_digest(s) if len(s) else None for s in sets], pa.binary()), lists],
                                  schema=_SIGNATURE)
    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for rows in rows_of(batches):
            sets = [shingle_set(t.as_py(), shingle) for t in rows.column("text")]
            wanted = rows.column("node").to_pylist()
            same = [(n, s) for n, s in zip(wanted, sets) if set_digest(s) == n]
            yield pa.record_batch([pa.array(np.arange(row, row + len(same))), pa.array([n for n, _ in same], pa.binary()),
                                   pa.array([s.tobytes() for _, s in same], pa.binary())], names=["id", "node", "shingles"])
            row += len(same)
    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            shared, linked = [], []
            for x, y in zip(rows.column("x"), rows.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * shared[-1] >= percent * (len(x) + len(y) - shared[-1]))
            yield pa.record_batch([rows.column("a"), rows.column("b"), pa.array(shared, pa.int64()),
                                   pa.array(linked, pa.bool_())], names=["a", "b", "shared", "linked"])
    return run


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs `a`, `b` with `shared`, the size of the intersection of their full sets, and whether they are `linked`."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a binary, b binary, shared long, linked boolean")


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("shingles")]
        ids = np.repeat(rows.column("id").to_numpy(), [len(x) for x in sets])
        yield pa.record_batch([pa.array(np.concatenate(sets)), pa.array(ids)], names=["shingle", "id"])


def _common(sets: DataFrame) -> DataFrame:
    """`node`, `v`: how many shingles of a set any other set has as well."""
    single = sets.select("id", "shingles").mapInArrow(_shingles, "shingle long, id long").groupBy("shingle").agg(
        F.count("*").alias("sets"), F.min("id").alias("id")).where("sets = 1").groupBy(F.col("id").alias("_id")).agg(
        F.count("*").alias("alone"))
    return sets.join(single, F.col("id") == F.col("_id"), "left").select(
        "node", (F.octet_length("shingles") / 8 - F.coalesce("alone", F.lit(0))).cast("long").alias("v")).groupBy(
        "node").agg(F.max("v").alias("v"))


def _hopeful(members: DataFrame, percent: int) -> DataFrame:
    """Members of buckets (`bucket`, `node`, `n`, `v`) without those that cannot be linked with any other one there.

    At most v of the n shingles of a set are shared, and the other set has at least as many, and not fewer than the
    smallest one of the bucket.
    """
    least = members.groupBy("bucket").agg(F.min("n").alias("_least"))
    return members.join(least, "bucket").where(f"100 * v >= {percent} * (n + greatest(_least, v) - v)").drop("_least")


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT,
                    permutations: int = PERMUTATIONS, band: int = BAND, leaders: int = LEADERS) -> DataFrame:
    """One row per document: `doc_id`, `text_hash`, `n_shingles`, `component_id`, `kept`.

    Texts with 100 * intersection >= percent * union of their shingle sets are linked; `component_id` is the
    smallest doc_id of a component. Sets that are equal are one node from the start, so copies cost nothing. Nodes
    that share a band meet in a bucket. No bucket is expanded into pairs: its middle, the set with the fewest
    shingles that no other set has, is compared with all others on full sets. Then `leaders` more at a time are compared
    with those that are not in their component by then and that, by what both share with the middle, can be linked
    at all (an exact bound), and leave the bucket. A bucket is finished when all that is left in it is one component,
    so no link between candidates is lost, whatever a bucket's size.

    Null or empty texts, or texts without words, have no shingles and are linked with nothing. Equal doc_ids of
    different texts are separate rows. A null doc_id never names a component: its row is kept if no other document
    of the component has an id. No rows give no rows.
    """
    signed = written(docs.select("doc_id", F.col("text"), _text_hash(docs).alias("text_hash")).mapInArrow(
        _signatures(shingle, permutations, band), _SPARK_SIGNATURE), "neardup-signatures")
    nodes = written(signed.where("n_shingles > 0").groupBy(F.col("digest").alias("node")).agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")),
        "neardup-nodes")

    in_buckets = nodes.select("node", "n", F.explode_outer("bands").alias("bucket"))
    shared = in_buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = written(in_buckets.join(shared.select("bucket"), "bucket"), "neardup-buckets")

    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node").withColumnRenamed(
        "doc_id", "_id")
    texts = docs.select("doc_id", "text").join(wanted, F.expr("doc_id <=> _id")).select("node", "text")
    sets = written(texts.mapInArrow(_sets(shingle), "id long, node binary, shingles binary"), "neardup-sets")

    members = written(_hopeful(members.join(_common(sets), "node"), percent), "neardup-members")
    middle = members.groupBy("bucket").agg(F.min(F.struct(F.expr("n - v"), "node")).alias("_m"))
    members = members.join(middle.select("bucket", F.col("_m.node").alias("middle")), "bucket")
    others = members.where("node <> middle")
    compared = written(_compared(others.select(F.col("node").alias("a"), F.col("middle").alias("b")).distinct(), sets, percent),
                       "neardup-compared")
    labels = components(compared.where("linked"), "a", "b")
    left = others.join(compared.select(F.col("a").alias("node"), F.col("b").alias("middle"), F.col("shared").alias("s")),
                       ["node", "middle"]).drop("middle")

    # What two sets share lies in the middle of their bucket, or outside of it in shingles that are not theirs alone.
    most = "(least(s, t) + least(v - s, w - t))"
    may_link = F.expr(f"100 * {most} >= {percent} * (n + m - {most})")
    while True:
        named = left.join(labels, "node", "left").select(*left.columns, F.coalesce("label", "node").alias("label"))
        open_ = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        left = written(named.join(open_.select("bucket"), "bucket", "left_semi"), "neardup-left")
        if left.isEmpty():
            break
        # small components lead: once all but the largest one of a bucket have led, nothing is left to compare
        members_of = left.groupBy("bucket", "label").agg(F.count("*").alias("size"))
        place = Window.partitionBy("bucket").orderBy("size", F.col("n") - F.col("v"), "node")
        leading = written(left.join(members_of, ["bucket", "label"]).withColumn("place", F.row_number().over(place)).where(
            F.col("place") <= leaders).select("bucket", F.col("node").alias("b"), F.col("label").alias("of"),
                                              F.col("n").alias("m"), F.col("v").alias("w"), F.col("s").alias("t")), "neardup-leading")
        # between two leaders, whichever of the two pairs has the larger node first
        ends = [F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")]
        pairs = left.join(leading, "bucket").where((F.col("label") != F.col("of")) & may_link).select(*ends).distinct()
        found = written(_compared(pairs, sets, percent), "neardup-compared")
        labels = _relabel(labels, found.where("linked"))
        left = left.join(leading.select("bucket", F.col("b").alias("node")), ["bucket", "node"], "left_anti").drop("label")

    named = signed.join(labels, F.col("digest") == F.col("node"), "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("label", "digest").alias("label"))
    named = written(named, "neardup-named")
    heads = named.where("label IS NOT NULL").groupBy(F.col("label").alias("_label")).agg(F.min("doc_id").alias("_head"))
    out = named.join(heads, F.col("label") == F.col("_label"), "left")
    head = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("_head"))
    return out.select("doc_id", "text_hash", "n_shingles", head.alias("component_id"), F.col("doc_id").eqNullSafe(head).alias("kept"))


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of components."""
    la = labels.select(F.col("node").alias("_a"), F.col("label").alias("la"))
    lb = labels.select(F.col("node").alias("_b"), F.col("label").alias("lb"))
    ends = links.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left").select(
        F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    merged = components(ends, "a", "b").select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    old = labels.join(merged, F.col("label") == F.col("_old"), "left").select(
        "node", F.coalesce("_new", "label").alias("label"))
    fresh = merged.join(labels, F.col("_old") == F.col("node"), "left_anti").select(
        F.col("_old").alias("node"), F.col("_new").alias("label"))
    return written(old.unionByName(fresh), "neardup-labels")


def _text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(column(docs, "text"), F.lit("")))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """`doc_id`, `n_shingles`, `component_id`, `kept` of every document, as in `classes`."""
    return classes(docs, **options).drop("text_hash")


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each near-duplicate component, columns as they are: the one with the smallest id.

    Equal rows stay together, and rows without an id stay. Other cases as in `classes`.
    """
    gone, of, text = free_names(docs, "_gone", "_of", "_text")
    dropped = classes(docs, **options).where("NOT kept AND doc_id IS NOT NULL").select(
        F.col("doc_id").alias(gone), F.col("text_hash").alias(of)).distinct()
    here = docs.withColumn(text, _text_hash(docs))
    return here.join(dropped, (column(here, "doc_id") == column(dropped, gone)) & (column(here, text) == column(dropped, of)),
                     "left_anti").drop(text)
