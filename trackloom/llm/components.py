"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.stages import Shelf


def connected_components(links: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """links(a, b) of long nodes -> (node, root): every node of a link but the roots themselves,
    with the smallest node that it reaches. No link gives no row.

    Each pass hangs the larger neighbours of a node on its smallest one, then does the same
    among the smaller ones; minima are combined before the shuffle, and a table of links never
    grows. Each pass is written and the one before dropped; only a count and a checksum come to
    the driver. The result is a table of the shelf.
    """
    shelf, name = shelf or Shelf(links.sparkSession), f"roots-{uuid4().hex[:6]}"
    state = (F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    links = shelf.put(name, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        now = links.agg(*state).first()
        if now == before or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        links = shelf.put(name, hung)
