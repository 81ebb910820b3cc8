"""Connected components of a table of links by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_scratch, scratch


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; component is the smallest node reachable.

    Both steps take minima per node with map-side partial aggregation and join them back on the node, so a
    hub's neighbours are never gathered: AQE splits its rows. Each round is a written table; the one before
    is removed. No links: an empty result.
    """
    cur = links.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    cur = scratch(cur.filter("a > b").distinct(), "links")
    if cur.isEmpty():
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(most_rounds):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_scratch(cur)
        cur = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("links did not settle; raise most_rounds")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
