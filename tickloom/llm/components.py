"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.session import written_once


def _sum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edges (``a``, ``b``) reaches, as ``node, component``.

    Stars alternate until nothing changes: every node's larger neighbours move to its smallest one, then
    every node and its smaller neighbours do. All steps are aggregates and joins that skew handling
    splits; each result is written to the shared folder, so lineage stays short.
    """
    a, b = F.col("a"), F.col("b")
    edges = written_once(edges.where(a != b).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = _sum(edges)
    while before[0]:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(
            b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(
            F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")),
                              F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select(
            "e.a", "e.b").where(a != b).distinct()
        edges = written_once(small)
        after = _sum(edges)
        if after == before:
            break
        before = after
    joined = edges.select(a.alias("node"), b.alias("component"))
    return joined.unionByName(
        edges.select(b.alias("node"), b.alias("component")).distinct())
