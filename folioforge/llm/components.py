"""Connected components by alternating large and small stars.

Edges stay distributed; the driver only sees two numbers a round. A hub's
minimum comes from a partially aggregated ``groupBy`` and returns to its edges
by a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settled


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, root)``, root the least node reachable.

    Self loops, nulls, repeated and reversed edges are fine; nodes without an
    edge to another node do not appear.
    """
    edges = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges, last = settled(edges, "edges"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        least = settled(least, "least")  # written, so that the join can be split where a hub is
        large = both.join(least, both.a == least.u).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = settled(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(down, large.a == down.u).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = settled(small.where("a != b").distinct(), "small")
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
        last = tuple(row)
