"""A Merkle manifest of a dataset: one digest for all rows, and proofs that a row is among them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tripmart.llm.text import column, written

#: Children of a node; the last node of a level may have fewer.
FAN = 8
#: Every so many levels are stored. Those between are computed again from the stored nodes below when a proof needs them.
STRIDE = 2


def field(value: Column) -> Column:
    """A value so that neighbours cannot be mistaken for it: `-` for null, else its bytes in UTF-8, `:`, the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts behind each other."""
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The digest at the top of a path, from a leaf and the siblings to its left and right on each level."""
    return F.aggregate(path, leaf, lambda own, step: digest(step["left"], own, step["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path behind each other, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


@dataclass(frozen=True)
class Trees:
    """Stored levels of one tree per value of `tree`, lowest first, each as a table of blocks.

    A block holds the nodes that share an ancestor on the next stored level (at most FAN ** stride): `tree`, `block`,
    `m` (nodes of the tree on this level) and `nodes` (array of `at`, `digest`, and on the lowest level `item`).
    `roots` has `tree` and `digest`.
    """

    levels: list[DataFrame]
    roots: DataFrame
    stride: int


def _numbered(leaves: DataFrame, order: Sequence[Column]) -> DataFrame:
    """`leaves` with `at` (place in its tree) and `m` (leaves of the tree); no task orders a whole tree.

    Rows are dealt by ranges of tree and order. A row's number in its range and the sizes of the ranges before give its
    place; there are about as many sizes as ranges and trees.
    """
    rows = written(leaves.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    by = [F.col("tree"), *order, F.col("digest"), F.col("_row")]
    ranged = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
        "_n", F.monotonically_increasing_id()).withColumn("_range", F.shiftrightunsigned("_n", 33)), "merkle-ranges")
    sizes = ranged.groupBy("tree", "_range").agg(F.min("_n").alias("_first"), F.count("*").alias("_size"))
    along = Window.partitionBy("tree").orderBy("_range")
    ahead = sizes.withColumn("_ahead", F.sum("_size").over(along) - F.col("_size")).withColumn(
        "m", F.sum("_size").over(Window.partitionBy("tree"))).drop("_size")
    return ranged.join(ahead, ["tree", "_range"]).withColumn("at", F.col("_n") - F.col("_first") + F.col("_ahead"))


def _parents(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, FAN), "")))


def _interior(digests: Column, stride: int) -> list[Column]:
    """A block's own nodes, and the levels above it inside the block."""
    out = [digests]
    for _ in range(stride):
        out.append(_parents(out[-1]))
    return out


def _height(m: Column, stride: int) -> Column:
    """Levels from here to the next stored level: fewer where the tree ends before, none for a lone node."""
    return sum(((m > FAN ** i).cast("int") for i in range(stride)), F.lit(0))


def _blocks(nodes: DataFrame, stride: int, *more: str) -> DataFrame:
    kept = F.struct("at", "digest", *more)
    return nodes.groupBy("tree", F.floor(F.col("at") / FAN ** stride).alias("block"), "m").agg(
        F.sort_array(F.collect_list(kept)).alias("nodes"))


def build(leaves: DataFrame, order: Sequence[Column], stride: int = STRIDE) -> Trees:
    """Trees over `leaves` (`tree`, `digest`, `item`, and what `order` names), one per value of `tree`.

    Leaves stand in `order`; leaves that are equal in it by digest. While a level has several nodes, every FAN
    neighbours become the digest of theirs; a lone leaf is its own root. Each stored level takes one shuffle
    of the one below, which has FAN ** stride times as many nodes. `tree` must not be null.
    """
    numbered = _numbered(leaves, order)
    level = written(_blocks(numbered, stride, "item"), "merkle-level")
    largest = level.agg(F.max("m")).first()[0] or 0
    levels = [level]
    while True:
        ups = _interior(F.transform("nodes", lambda x: x["digest"]), stride)
        top = ups[stride]
        for i in range(stride - 1, -1, -1):
            top = F.when(_height(F.col("m"), stride) == i, ups[i]).otherwise(top)
        above = level.select("tree", F.col("block").alias("at"), top[0].alias("digest"),
                             F.ceil(F.col("m") / FAN ** stride).alias("m"))
        largest = -(-largest // FAN ** stride)
        if largest <= 1:
            return Trees(levels, written(above.select("tree", "digest"), "merkle-roots"), stride)
        level = written(_blocks(above, stride), "merkle-level")
        levels.append(level)


def _step(level: Column, place: Column) -> Column:
    """The siblings of a block's node on one level, to the left and to the right."""
    first = F.floor(place / FAN).cast("int") * FAN
    return F.struct(F.array_join(F.slice(level, first + 1, place - first), "").alias("left"),
                    F.array_join(F.slice(level, place + 2, first + FAN - 1 - place), "").alias("right"))


def proofs(trees: Trees, above: DataFrame) -> DataFrame:
    """`tree`, `digest`, `item`, `path` of every leaf, and the other columns of `above`.

    `above` has `tree` and `path`: the way on from each root (an empty array where the root is the end). From the top
    down, every block meets the path of its ancestor, one row for a block, and hands it to its nodes behind their own
    steps. Nodes of levels that are not stored exist only inside that step, for the block in hand. `path` is an array
    of (`left`, `right`): the siblings on both sides, bottom first. Only paths of stored nodes above leaves are written.
    """
    more = [c for c in above.columns if c not in ("tree", "path")]
    ahead = above.withColumn("at", F.lit(0).cast("long"))
    for depth in range(len(trees.levels) - 1, -1, -1):
        inner = _interior(F.transform("nodes", lambda x: x["digest"]), trees.stride)[:trees.stride]
        met = trees.levels[depth].join(ahead.withColumnRenamed("at", "block"), ["tree", "block"])
        each = met.select("tree", "path", *more, *[level.alias(f"_{i}") for i, level in enumerate(inner)],
                          _height(F.col("m"), trees.stride).alias("_up"), F.posexplode("nodes").alias("_place", "_node"))
        steps = F.array(*[_step(F.col(f"_{i}"), F.floor(F.col("_place") / FAN ** i).cast("int")) for i in range(trees.stride)])
        path = F.concat(F.slice(steps, 1, F.col("_up")), "path").alias("path")
        if depth:
            ahead = written(each.select("tree", F.col("_node.at").alias("at"), path, *more), "merkle-paths")
        else:
            return each.select("tree", F.col("_node.digest").alias("digest"), F.col("_node.item").alias("item"), path, *more)
    raise AssertionError("trees have at least one level")


_PATH = "array<struct<left:string,right:string>>"


def manifest(rows: DataFrame, part: str, order: str, fields: Sequence[str], keep: Sequence[Column] = (),
             stride: int = STRIDE) -> DataFrame:
    """`leaf`, `item`, `subroot`, `root`, `path` of every row; `part` names the column with a tree per value.

    A leaf is the digest of the row's `fields`, each with its length in front, null as `-`. Leaves of a part stand by
    `order` (null first, then by digest, so rows with equal or no ids have a place). The parts' roots stand by part,
    null first, and make the top tree. `path` leads from the leaf through the subroot to the root; `fold` and `proof`
    read it. `item` carries the columns `keep`, evaluated once per row beside the leaf: they must have names.
    Equal rows are leaves of their own. A part of one row has its leaf as subroot, one part its subroot as root. No rows
    give no rows. Other columns of `rows` are not read, whatever their names.
    """
    at = {c: column(rows, c) for c in {part, order, *fields}}
    leaves = rows.select(F.coalesce(F.concat(F.lit("="), at[part].cast("string")), F.lit("-")).alias("tree"),
                         digest(*[field(at[c]) for c in fields]).alias("digest"), at[order].alias("_order"),
                         F.struct(F.lit(0).alias("_"), *keep).alias("item"))
    parts = build(leaves, [F.col("_order").asc_nulls_first()], stride)
    top = build(parts.roots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("item")),
                [F.col("item")], stride)
    start = top.roots.select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    tops = proofs(top, start).select(F.col("item").alias("tree"), "path", "root", F.col("digest").alias("subroot"))
    return proofs(parts, written(tops, "merkle-tops")).select(
        F.col("digest").alias("leaf"), "item", "subroot", "root", "path")
