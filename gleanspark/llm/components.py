"""Connected components by alternating stars, over links of any sortable type; each round is a table in the shared folder.

Where a node has far more links than a task's share of all of them (the hub of a star), its links are met where they are (`spread_join`), so no task
gets all of them. Self-links and repeated links count once. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, spread_join, written

SKEW, LEAST = 4, 256  # times a task's share, and links at least, from which a node is a hub


def _large_star(links: DataFrame, hubs: bool) -> DataFrame:
    """Every node's larger neighbours move to the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    met = spread_join(both, least, ["a"], "n") if hubs else both.join(least, "a")
    return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them. Links point from larger to smaller here: a node has few smaller ones by now."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple[tuple, bool]:
    """(what tells whether anything moved, whether there are hubs)."""
    by_root = links.groupBy("b").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    n, x, most = by_root.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    share = (n or 0) / int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (n or 0, x), (most or 0) > max(LEAST, SKEW * share)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): the smallest node of the component, for every node that is not the smallest itself. A table as `written` makes them."""
    links = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, hubs = _state(links)
    while before[0]:
        last, links = links, written(_small_star(_large_star(links, hubs)), "links")
        dropped(last)
        after, hubs = _state(links)
        if after == before:
            break
        before = after
    out = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.scratch = links.scratch
    return out
