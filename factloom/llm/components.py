"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is a fixed number of joins and minima over links; nothing of the graph reaches the driver but
two sums per round. Minima and links are read from written tables, so that adaptive execution can split the
links of a node that has very many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import forget, written


def _sum(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours, and itself, to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "stars")
    across = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b; long, not null); root is its smallest node."""
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    before = _sum(links)
    while before[0]:
        large = written(_large_star(links).distinct(), "links")
        after = written(_small_star(large).distinct(), "links")
        forget(links)
        forget(large)
        links, now = after, _sum(after)
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
