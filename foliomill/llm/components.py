"""Connected components of a table of links by alternating star contraction.

Links stay a table: every step is a join and an aggregation, and each round is
written to the shared folder, so nothing but two numbers per round reaches the
driver.  The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node that are larger (or not larger) than it on its least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.where("v > u") if large else both
    out = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (u, v); a component is known by its least node.

    Null ends are dropped; a link of a node to itself and repeated links change nothing.
    """
    links = links.dropna().where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    before = None
    while True:
        links = write_table(_stars(_stars(links, large=True), large=False), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    tops = links.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
