"""Union-find grouping as alternating star contractions, so that no link or component ever leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written

MAX_ROUNDS = 40


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (u > v)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for links (a, b) of any integers, each linked node with the least node it is connected to.

    Self-links and nulls are ignored; no links give no rows. Raises if the contraction hasn't settled after MAX_ROUNDS,
    which takes components with paths of more than 2^MAX_ROUNDS links.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        after_edges = written(_stars(edges), "links")
        after = mark(after_edges)
        drop_written(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components haven't settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
