"""Hard negatives: for an anchor and each of its positives the closest rows of other labels that are not too close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.llm.text import column, written

#: Components become whole numbers of this part; with larger ones than MOST, scores might not fit into 64 bits.
SCALE, MOST = 256, float(1 << 20)
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between so many percent of the positive's.
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: Rows that a task holds while all anchors pass by, and anchors that are scored at a time.
ROWS_PER_GROUP, ANCHORS_PER_STEP = 1 << 18, 64

def candidates(rows: DataFrame, vec_id: str, label: Column, vector: str, is_anchor: Column) -> DataFrame:
    """Rows that take part, with whole-number components and a number of their own (so ids may repeat or be null).

    Left out: null labels, null vectors, and vectors with a null, non-finite or too large component.
    """
    vec = column(rows, vector)
    scaled = F.transform(vec, lambda x: x.cast("double") * SCALE)
    usable = label.isNotNull() & vec.isNotNull() & F.forall(scaled, lambda x: F.coalesce(F.abs(x) < MOST, F.lit(False)))
    return rows.where(usable).select(
        F.monotonically_increasing_id().alias("row"), column(rows, vec_id).cast("long").alias("id"),
        label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("vector"))


def exact_kind(most: int, width: int) -> np.dtype:
    """What holds every sum of `width` products of whole numbers up to `most` exactly, the fastest first."""
    largest = most * most * width
    return np.dtype(np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64)


def _matrix(vectors: pa.Array, width: int, kind: np.dtype) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones go on with zeros, which no product counts."""
    values, sizes = np.asarray(vectors.flatten()).astype(kind), np.asarray(vectors.value_lengths(), np.int64)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), kind)
    at = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - at] = values
    return out


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k of `at` with the highest scores, best first; the smaller place among equals. `at` ascends."""
    if len(at) > k:
        bound = np.partition(scores[at], len(at) - k)[len(at) - k]
        above = at[scores[at] > bound]
        at = np.sort(np.concatenate([above, at[scores[at] == bound][:k - len(above)]]))
    return at[np.argsort(-scores[at], kind="stable")]


class _Group:
    """Rows of a task in the order of their ids, ready for anchors to pass by."""

    def __init__(self, parts: list[pa.RecordBatch], width: int, kind: np.dtype):
        rows = pa.Table.from_batches(parts).combine_chunks()
        ids = rows.column("id").to_pylist()
        own = np.asarray(rows.column("row"))
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, own[i])), np.int64)
        self.row, self.label = own[order], np.asarray(rows.column("label"))[order]
        self.ids = [ids[i] for i in order]
        self.vectors = np.concatenate([_matrix(b.column("vector"), width, kind) for b in parts])[order]

    def positives(self, anchor: dict, scores: np.ndarray, k: int) -> Iterator[tuple]:
        at = np.flatnonzero((self.label == anchor["label"]) & (self.row != anchor["row"]))
        for i in _best(scores, at, k):
            yield anchor["row"], 0, int(scores[i]), self.ids[i], int(self.row[i])

    def negatives(self, anchor: dict, scores: np.ndarray, k: int) -> Iterator[tuple]:
        """The best k of every slot: slot i goes from the upper limit of positive i down to that of positive i + 1.

        Scores below the lower limit of the slot's own positive are in no window that reaches into the slot.
        """
        upper, lower = anchor["upper"], anchor["lower"]
        here = np.flatnonzero((self.label != anchor["label"]) & (scores <= upper[0]) & (scores >= min(lower)))
        slot = np.searchsorted(-np.array(upper), -scores[here], side="right") - 1
        for i in range(len(upper)):
            for j in _best(scores, here[(slot == i) & (scores[here] >= min(lower[:i + 1]))], k):
                yield anchor["row"], i, int(scores[j]), self.ids[j], int(self.row[j])


_HIT = "anchor long, slot int, score long, id long, row long"
_HIT_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
_HIT_NAMES = ["anchor", "slot", "score", "id", "row"]


def _pass_by(width: int, kind: np.dtype, k: int, find):
    """A task's groups one after the other: first their rows, which are held, then all anchors in steps."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, number = [], None, None
        for batch in batches:
            numbers = np.asarray(batch.column("group"))
            anchors = np.asarray(batch.column("passes"))
            marks = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(anchors.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *marks], [*marks, batch.num_rows]):
                if a == b:
                    continue
                if number != numbers[a]:
                    held, group, number = [], None, numbers[a]
                part = batch.slice(a, b - a)
                if not anchors[a]:
                    held.append(part)
                    continue
                if group is None and held:
                    group, held = _Group(held, width, kind), []
                for start in range(0, part.num_rows if group else 0, ANCHORS_PER_STEP):
                    some = part.slice(start, ANCHORS_PER_STEP)
                    scores = (_matrix(some.column("vector"), width, kind) @ group.vectors.T).astype(np.int64)
                    facts = some.select(["row", "label", "upper", "lower"]).to_pylist()
                    hits = [h for anchor, s in zip(facts, scores) for h in find(group, anchor, s, k)]
                    if hits:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*hits), _HIT_TYPES)], names=_HIT_NAMES)
    return run


def _compared(rows: DataFrame, anchors: DataFrame, width: int, kind: np.dtype, groups: int, k: int, find) -> DataFrame:
    """Each anchor against each row, and the best `k` per anchor and slot of every group of rows.

    Rows are dealt into groups by number, so no label or id makes a group large; each anchor goes once to each group,
    behind its rows.
    """
    none = F.lit(None).cast("array<long>")
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("group"), F.lit(False).alias("passes"),
                        "row", "id", "label", none.alias("upper"), none.alias("lower"), "vector")
    copies = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("passes"),
                            "row", "id", "label", "upper", "lower", "vector")
    both = dealt.unionByName(copies).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "passes")
    hits = both.mapInArrow(_pass_by(width, kind, k, find), _HIT)
    return best_per_slot(hits, k)


def best_per_slot(hits: DataFrame, k: int) -> DataFrame:
    """The best `k` of every anchor and slot; Spark keeps no more of any task before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= k).drop("_at")


def _percent(score: Column, percent: int) -> Column:
    """So many percent of a score, rounded down in whole numbers."""
    parts = score * percent
    return F.call_function("div", parts - F.pmod(parts, F.lit(100)), F.lit(100))


def _ranked(hits: DataFrame) -> Column:
    """An anchor's hits, best first: descending score, ascending id (null last), ascending row."""
    return F.sort_array(F.collect_list(F.struct(
        (-F.col("score")).alias("down"), F.col("id").isNull().alias("no_id"), "id", "row", "score", "slot")))


def mine(rows: DataFrame, vec_id: str, label: Column, vector: str, is_anchor: Column, positives: int = POSITIVES,
         negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
         rows_per_group: int = ROWS_PER_GROUP) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.

    A score is the inner product of the whole-number vectors; higher ones come first, then smaller ids (null last),
    then rows as they were read. An anchor's positives are its first rows of the same label but itself. For each of them:
    the first `negatives` rows of other labels whose score lies in its window, `least_percent` to `most_percent` of the
    positive's score. Windows overlap. Their upper limits cut the scores into slots, one per positive; each group of rows
    keeps the best of each slot, groups are merged per anchor and slot, and a window's rows are the beginning of all slots
    from its own limit down, above its lower limit. So no window is searched twice, and an anchor's rows are bounded.

    Null, short and repeated rows: see `candidates`; a shorter vector goes on with zeros. Repeated ids are rows of their
    own, so an anchor id that is there twice has two sets of results. Without positives, or with a negative positive score
    (an empty window), nothing is returned; no rows give no rows. Each group of rows is held by a task
    (`rows_per_group` rows of 4 to 8 bytes a component), each anchor is sent to each group.
    """
    own = written(candidates(rows, vec_id, label, vector, is_anchor), "negatives-rows")
    facts = own.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"),
                    F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("most")).first()
    width = facts["width"] or 0
    kind = exact_kind(facts["most"] or 0, width)
    groups = max(own.sparkSession.sparkContext.defaultParallelism, -(-facts["n"] // rows_per_group))
    none = F.lit(None).cast("array<long>")
    anchors = own.where("anchor")
    near = _compared(own, anchors.withColumns({"upper": none, "lower": none}), width, kind, groups, positives,
                     _Group.positives)
    lists = written(near.groupBy("anchor").agg(_ranked(near).alias("positives")), "negatives-positives")
    limits = lists.select(
        F.col("anchor").alias("row"),
        F.transform("positives", lambda p: _percent(p["score"], most_percent)).alias("upper"),
        F.transform("positives", lambda p: -_percent(-p["score"], least_percent)).alias("lower"))
    far = _compared(own, anchors.join(limits, "row"), width, kind, groups, negatives, _Group.negatives)
    found = far.groupBy("anchor").agg(_ranked(far).alias("negatives"))
    met = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")).join(lists, "anchor").join(found, "anchor")
    windows = met.select("anchor_id", "negatives", F.posexplode("positives").alias("_slot", "_p"))
    in_window = F.slice(F.filter("negatives", lambda n: (n["slot"] >= F.col("_slot")) & (
        100 * n["score"] >= least_percent * F.col("_p.score"))), 1, negatives)
    return windows.select("anchor_id", "_p", F.posexplode(in_window).alias("_at", "_n")).select(
        "anchor_id", F.col("_p.id").alias("positive_id"), (F.col("_at") + 1).alias("rank"),
        F.col("_n.id").alias("negative_id"), F.col("_p.score").alias("positive_score"),
        F.col("_n.score").alias("negative_score"))
