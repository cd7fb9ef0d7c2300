"""Connected components of a table of links, by alternating large and small stars (Kiveris and others, 2014).

Every step is an aggregation and an equi-join, so a node with very many links is combined before the shuffle and its join can be
split. Each round is written to the shared folder: lineage stays short and a lost executor costs no earlier round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.shared import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them; links point to the smaller node already."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root of each node with a link to another: the root is the smallest node that links reach.

    links: columns a and b, any order, repeated or not; a link of a node with itself says nothing. No links: an empty table.
    """
    now = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    mark = F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))
    before = now.agg(*mark).first()
    while before[0]:
        now = written(_small_star(_large_star(now)), "links")
        after = now.agg(*mark).first()
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
