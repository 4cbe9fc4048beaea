"""Connected components of a graph given as links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taleweave.session import discard, hand_over


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link in (a, b); the root is the smallest node reachable.

    A round hooks nodes to the smallest node next to them, first those above, then those below. The smallest neighbour
    is a plain minimum, taken before the shuffle as far as possible, and no node's neighbours are gathered. Each round's
    links are written to the shared folder, so lineage stays short. Rounds end when the links no longer change.
    """
    both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    links, seen = hand_over(both, "links"), None
    while True:
        print_ = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if print_ == seen:
            break
        seen = print_
        before = links
        # large star: every neighbour above a node goes to the smallest one around it
        sides = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = links = hand_over(links.filter("u != v").distinct(), "large-star")
        # small star: a node and the neighbours below it go to the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        down = links.join(least, "u")
        links = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        links = hand_over(links.filter("u != v").distinct(), "small-star")
        discard(before, large)
    ends = links.groupBy("u").agg(F.min("v").alias("root"))
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    inner = ends.select(F.col("u").alias("node"), "root")
    return inner.unionByName(roots.join(inner, "node", "left_anti"))
