"""Connected components by alternating large-star and small-star steps.

Public method: Kiveris et al., "Connected Components in MapReduce and Beyond".
Every step is two aggregations and joins over links; labels never gather in
one task or on the driver, only the number of changed links does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswell.session import discard, materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (u, v) with u <> v, u > v on input for the small star."""
    if large:
        sides = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = links
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is its least node.

    ``links`` has bigint columns a and b. Repeated links, links to oneself and
    either order are fine; rows with a NULL end are dropped. No links give no rows.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    current = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # settled: every node has one link, and none leads to a node that has a link itself
        several = current.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = current.join(current.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if several.unionByName(chained).isEmpty():
            break
        before, current = current, materialize(_star(_star(current, True), False), "links")
        discard(before)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
