"""Which pages belong to a site: filters, and the crawl as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.shared import settled


def filtered(found: DataFrame, hosts: list[str] | None, scope: str, most: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """found(*by, url, pos) -> (*by, url, path, pos): pages of the hosts (of any, if none are given) in scope, one for
    each path, the first found, and the first ``most`` of each group.

    Query and fragment go; "/a" and "/a/" are different paths.
    """
    kept = found.withColumn("url", U.without("url", query=True)).withColumn("path", U.path("url"))
    own = F.lit(True) if hosts is None else U.host("url").isin([h.lower() for h in hosts])
    kept = kept.where(own & U.in_scope("url", F.lit(scope)) & ~F.col("path").rlike(U.NO_PAGE))
    first = kept.withColumn("n", F.row_number().over(Window.partitionBy(*by, "path").orderBy("pos", "url"))).where("n = 1").select(*by, "url", "path", "pos")
    if not most:
        return first
    if not by:
        return first.orderBy("pos", "url").limit(most)
    return first.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "url"))).where(F.col("n") <= most).drop("n")


def largest(candidates: DataFrame) -> DataFrame:
    """candidates(strategy, url, path, pos) -> rows of the strategy with most pages; of equals the least strategy."""
    best = candidates.groupBy("strategy").agg(F.count("*").alias("n")).agg(F.min_by("strategy", F.struct(-F.col("n"), F.col("strategy"))).alias("strategy"))
    return candidates.join(F.broadcast(best), "strategy")  # one row


#: Rounds after which what was visited is written as one table, so that its plan stays short on deep graphs.
ROUNDS = 16


def reachable(links: DataFrame, start: DataFrame) -> DataFrame:
    """links(src, dst), start(node) -> (node, depth): breadth first.

    Each round joins the frontier with the links and drops what was visited by an anti join; a round's result is
    written, so lineage stays short. Rounds go on until nothing new is found.
    """
    frontier = settled(start.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node")).where("node is not null").distinct()
        frontier = settled(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
        if depth % ROUNDS == 0:
            seen = settled(seen, "seen")
    return seen
