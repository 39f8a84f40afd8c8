"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.text import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
    return both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the smallest of them. Edges run from large to small."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    down = edges.join(least, F.col("a") == F.col("n")).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, or has others hang on it, and not both."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return roles.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).where(
        "hangs > 1 OR hangs + holds > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """`node`, `label` for every node of a link: label is the smallest node that links reach.

    Each round takes a few shuffles of the links; the number of rounds grows with the logarithm of the size. No task
    sees a whole component: minima are combined before they are shuffled, and a node with very many links is only the
    target of them. Links may repeat, run either way, or join a node to itself; null ends are ignored.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    edges = written(edges, "components")
    while not _stars(edges):
        edges = written(_small_star(_large_star(edges)).distinct(), "components")
    tops = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
