"""Directed multigraphs as edges (src, dst): stochastic matrices and dead ends. Node ids may be of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigraph.sources.scratch import discard, materialise


def out_degrees(edges: DataFrame) -> DataFrame:
    """src, out_deg, parallel edges counted."""
    return edges.groupBy("src").agg(F.count("*").alias("out_deg"))


def stochastic_matrix(edges: DataFrame) -> DataFrame:
    """i, j, a: for each edge j to i a cell 1 / out-degree of j; parallel edges give as many rows."""
    # Degrees are summed within tasks first and then joined: a hub's edges need not meet in one task, as in a window.
    met = edges.join(out_degrees(edges), "src")
    return met.select(F.col("dst").alias("i"), F.col("src").alias("j"), (F.lit(1.0) / F.col("out_deg")).alias("a"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """node, in_deg, out_deg, loops of every node, parallel edges counted: one shuffle over both ends of the edges."""
    loop = F.when(F.col("src") == F.col("dst"), 1).otherwise(0)
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.lit(0).alias("into"), F.lit(1).alias("out"), loop.alias("loop")),
                F.struct(F.col("dst").alias("node"), F.lit(1).alias("into"), F.lit(0).alias("out"), F.lit(0).alias("loop")),
            )
        ).alias("end")
    ).select("end.*")
    return ends.groupBy("node").agg(F.sum("into").alias("in_deg"), F.sum("out").alias("out_deg"), F.sum("loop").alias("loops"))


def _alone():
    """Nodes whose only edge in and only edge out is their loop."""
    return (F.col("in_deg") == 1) & (F.col("out_deg") == 1) & (F.col("loops") == 1)


def dead_end_nodes(edges: DataFrame) -> DataFrame:
    """node: those without edges out, and those with nothing but one loop."""
    return node_degrees(edges).where((F.col("out_deg") == 0) | _alone()).select("node")


def remove_dead_ends(edges: DataFrame, compat: bool = False) -> DataFrame:
    """The edges that remain when dead ends, and what leads to them alone, are pruned until nothing changes.

    Degrees are counted once. An edge goes when its target dies, which takes it from its source's out-degree; what leads
    into a node stays as long as the node does. So a round reads the edges for those into the newly dead alone, and
    writes the degrees of the nodes that are left, never the edges. ``compat`` leaves a graph as it is in which no node
    is alive from the start, as one of single loops alone.
    """
    dead = (F.col("out_deg") == 0) | _alone()
    nodes = materialise(node_degrees(edges), "degrees")
    if compat and nodes.where(~dead).isEmpty():
        return edges
    while True:
        newly = nodes.where(dead).select("node")
        if newly.isEmpty():
            return edges.join(nodes.select("node"), edges["dst"] == nodes["node"], "left_semi")
        lost = edges.join(newly, edges["dst"] == newly["node"], "left_semi").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("lost"))
        left = nodes.where(~dead).join(lost, "node", "left").withColumn("out_deg", F.col("out_deg") - F.coalesce("lost", F.lit(0))).drop("lost")
        before, nodes = nodes, materialise(left, "degrees")
        discard(before)
