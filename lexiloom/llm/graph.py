"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Nothing is gathered on the driver but a number a round. Every step groups by a vertex with map-side minima and joins
the minima back. Edges meet them by vertex and by one of SALTS shares of their other end, so that the edges of a vertex
with very many neighbours are spread over as many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import staged


SALTS = 16


def _with_minima(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges (u, v) with m of least (k, m), k = u."""
    salted = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    share = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    return edges.withColumn("e", share).join(salted, (F.col("u") == F.col("k")) & (F.col("e") == F.col("s")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: of both directions, every larger neighbour of u goes to u's minimum.
    Small star: every smaller neighbour of u, and u itself, goes to the smallest of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        moved = _with_minima(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        moved = _with_minima(edges, least).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars: every u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("hub")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("hub")))
    per = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return per.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("hub") > 0)))).first()[0] == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs, any direction, repeats and loops allowed. Returns (node, component), component being the
    smallest node of its component; nodes without an edge to another do not appear."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            break
        now = staged(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
