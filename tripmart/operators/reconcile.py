"""Comparison of two large tables by digests of key buckets: only buckets that differ are joined."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripmart.operators.sizing import settled

#: Leaves of the digest tree, and leaves below one inner node.
BUCKETS, FAN = 4096, 64


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def row_digest(columns: Sequence[str]) -> Column:
    """A row's digest; nulls stay apart from empty values by a mark of their own."""
    return F.md5(F.to_json(F.struct(*[F.struct(F.col(c).isNull().alias("n"), F.col(c).cast("string").alias("v")).alias(f"c{i}")
                                      for i, c in enumerate(columns)])))


def digest_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS, fan: int = FAN) -> DataFrame:
    """`level` (0 leaves, 1 inner nodes, 2 root), `node`, `rows`, `low`, `high`: sums of digests that no order changes.

    One aggregate over the table; a table of `buckets` rows is left. Two halves of a digest are summed on their own, so
    equal rows add up instead of cancelling each other.
    """
    halves = [F.conv(F.substring(row_digest(columns), i, 8), 16, 10).cast("long") for i in (1, 9)]
    leaves = df.groupBy(_bucket(keys, buckets).alias("node")).agg(
        F.count("*").alias("rows"), F.sum(halves[0]).alias("low"), F.sum(halves[1]).alias("high"))
    leaves = settled(leaves)
    out = leaves.select(F.lit(0).alias("level"), "*")
    for level, node in ((1, F.floor(F.col("node") / fan).cast("int")), (2, F.lit(0))):
        out = out.unionByName(leaves.groupBy(node.alias("node")).agg(
            *[F.sum(c).alias(c) for c in ("rows", "low", "high")]).select(F.lit(level).alias("level"), "*"))
    return out


def differing_buckets(left: DataFrame, right: DataFrame) -> DataFrame:
    """`node` of the leaves that differ in two digest trees. Leaves below equal inner nodes are not compared."""
    def apart(level: int, a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.where(F.col("level") == level).withColumn("side", F.lit(1)).unionByName(
            b.where(F.col("level") == level).withColumn("side", F.lit(-1)))
        sums = [F.sum(F.col(c) * F.col("side")).alias(c) for c in ("rows", "low", "high")]
        return both.groupBy("node").agg(*sums).where("rows <> 0 OR low <> 0 OR high <> 0").select("node")

    inner = apart(1, left, right).select(F.col("node").alias("_inner"))
    below = lambda t: t.where("level <> 0 OR exists_in").drop("exists_in")
    marked = [t.join(F.broadcast(inner), F.floor(t["node"] / FAN) == F.col("_inner"), "left").withColumn(
        "exists_in", F.col("_inner").isNotNull()).drop("_inner") for t in (left, right)]
    return apart(0, *[below(t) for t in marked])


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """`keys`, `copy`, `kind` (`missing`: only left; `extra`: only right; `changed`) and both digests of rows that differ.

    First both tables become digest trees (one aggregate each). Then only rows of differing buckets are read into the
    join; there are at most BUCKETS of these numbers. Rows of one key are met in the order of their digests (`copy` from
    1), those that both tables hold first, so repeated keys are compared as sets with repeats. Null keys are keys.
    """
    nodes = F.broadcast(differing_buckets(*[digest_tree(t, keys, columns) for t in (left, right)]))

    def rows(df: DataFrame, mark: str) -> DataFrame:
        here = df.withColumn("_node", _bucket(keys, BUCKETS)).join(nodes, F.col("_node") == F.col("node"), "left_semi")
        return here.select(*[F.col(k).alias(f"{mark}{i}") for i, k in enumerate(keys)], row_digest(columns).alias(f"{mark}d")
                           ).groupBy(*[f"{mark}{i}" for i in range(len(keys))], f"{mark}d").agg(F.count("*").alias(f"{mark}n"))

    a, b = rows(left, "a"), rows(right, "b")
    same = reduce(and_, [F.col(f"a{i}").eqNullSafe(F.col(f"b{i}")) for i in range(len(keys))])
    spare = a.join(b, same & (F.col("ad") == F.col("bd")), "full").select(
        *[F.coalesce(f"a{i}", f"b{i}").alias(f"_k{i}") for i in range(len(keys))], F.coalesce("ad", "bd").alias("_d"),
        (F.coalesce("an", F.lit(0)) - F.coalesce("bn", F.lit(0))).alias("_more")).where("_more <> 0")
    each = spare.withColumn("_side", F.sign("_more").cast("int")).withColumn(
        "_one", F.explode(F.array_repeat(F.lit(1), F.abs("_more").cast("int"))))
    place = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))], "_side").orderBy("_d")
    met = each.withColumn("copy", F.row_number().over(place)).groupBy(*[f"_k{i}" for i in range(len(keys))], "copy").agg(
        F.max(F.when(F.col("_side") == 1, F.col("_d"))).alias("left_digest"),
        F.max(F.when(F.col("_side") == -1, F.col("_d"))).alias("right_digest"))
    kind = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return met.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "copy", kind.alias("kind"), "left_digest", "right_digest")
