"""Connected components of an edge table, by rounds of joins."""

from pyspark.sql import functions as F

from logkeep.session import stored


def components(edges, left="a", right="b"):
    """(node, root): the smallest node that each node of ``edges`` reaches.

    Every round links each node to the smallest neighbour of its neighbourhood, first
    among larger neighbours, then among all; a node with many links is one aggregation
    row combined before the shuffle. Rounds end when nothing changes; each is written to
    the shared folder, so a lost executor costs one round. Nodes without edges are absent;
    null ends are left out.
    """
    links = edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
    links = stored(links.where("a <> b").selectExpr(
        "greatest(a, b) a", "least(a, b) b").distinct(), "links")
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b a", "m b")
        keep = large.unionAll(least.where("m < a").selectExpr("a", "m b")).distinct()
        keep = keep.where("a > b")
        low = keep.groupBy("a").agg(F.min("b").alias("m"))
        small = keep.join(low, "a").where("b <> m").selectExpr("b a", "m b")
        fresh = stored(small.unionAll(low.selectExpr("a", "m b")).distinct(), "links")
        changed = fresh.exceptAll(links).limit(1).count() or links.exceptAll(fresh).limit(1).count()
        links = fresh
        if not changed:
            return links.selectExpr("a node", "b root").unionAll(
                links.selectExpr("b node", "b root").distinct())
