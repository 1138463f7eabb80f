"""Connected components of links, by alternating large-star and small-star rounds on DataFrames.

Every round is two joins and two distributed groupings over what links are left; it is written to the shared
folder, so lost executors cost one round. The driver sees only a count and a checksum.

A node with very many links (a hub) would send all of them to one task of such a join. Least neighbours are found
by partial aggregation; those of hubs then reach the links by broadcast, all others by a join. A node is a hub above
`least_hub` links, or more where there are many links, so that there are never more than 50,000 hubs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import staged

MOST_HUBS = 50_000


def _with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows (a, b) with the m of least (c, m, n) where a = c; n is the number of rows that a node has."""
    hubs = least.filter(F.col("n") > hub).select("c", "m")
    met = rows.join(F.broadcast(hubs), F.col("a") == F.col("c"), "left").select("a", "b", "m")
    rest = met.filter(F.col("m").isNull()).select("a", "b").join(least.filter(F.col("n") <= hub).hint("merge"), F.col("a") == F.col("c")).select("a", "b", "m")
    return met.filter(F.col("m").isNotNull()).union(rest)


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "c")
    return _with_least(both.filter("b > a"), least, hub).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "c")
    moved = _with_least(edges, least, hub).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("c", "m").toDF("a", "b")).filter("a != b").distinct()


def components(links: DataFrame, most_rounds: int = 60, least_hub: int = 64) -> DataFrame:
    """(id, root) for every id that a link (a, b) of two longs touches, roots left out: root is the least id reachable.

    Direction, repeats and loops do not matter. No links: no rows.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        if not n:
            break
        # Large-star sees every link from both ends: at most 2n / hub nodes have more than `hub` of them.
        hub = max(least_hub, 2 * n // MOST_HUBS)
        spread = _large_star(edges, hub)
        edges = staged(_small_star(spread, hub), "links")
        n, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, mark) == seen:
            break
        seen = (n, mark)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
