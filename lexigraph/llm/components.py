"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.llm.scratch import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of ``links`` (a, b): root is the smallest node that links lead to.

    Large and small stars alternate until every link points at a root; the number of rounds is logarithmic. Each
    round's minima are written first, so that joins with them can be split where a node has very many links.
    """
    high, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    now = materialise(links.where("a <> b").select(high, low).distinct(), "links", few=True)
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima", few=True)
        large = now.join(least.withColumnsRenamed({"u": "v"}), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star", few=True)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "minima", few=True)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small-star", few=True)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether each node either has one link down and none up to it, or none down: then the links' ends are roots."""
    end = lambda node, down: F.struct(F.col(node).alias("node"), F.lit(down).alias("down"))
    ends = links.select(F.inline(F.array(end("u", 1), end("v", 0))))
    downs = ends.groupBy("node").agg(F.sum("down").alias("n"), F.min("down").alias("least"))
    return downs.where("n > 1 or (n = 1 and least = 0)").isEmpty()
