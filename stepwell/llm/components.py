"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations with joins; edges stay in tables in the shared folder, and
the driver sees one number a round.  A node with many edges is aggregated before the
shuffle, and joins on it are ones whose hot partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwell.llm import tables as S


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are hung on the least of it and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are hung on the least of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    met = edges.join(least, "b")
    return met.select(F.col("m").alias("x"), F.col("a").alias("y")).union(met.select("m", "b")).filter("x < y").distinct().toDF("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """For edges (a, b) of numbers, a row (node, root) for each node but the roots: root is its component's least."""
    now = S.Table(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now.df)
    while True:
        after = S.Table(_small(_large(now.df)), "edges")
        now.drop()
        now, (before, mark) = after, (mark, _mark(after.df))
        if before == mark:
            return now.df.select(F.col("b").alias("node"), F.col("a").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Tells edge sets apart: a star forest is what a round leaves as it is."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s
