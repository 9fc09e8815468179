"""Connected components over link tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def component_labels(links: DataFrame) -> DataFrame:
    """_node and _label for each end of the links (_a, _b longs): the component's smallest node.

    Alternates large-star and small-star steps; both keep the components, and at the end each node
    hangs on its component's smallest. Each round is written to the shared folder; the driver learns
    only the number of links and a checksum, which stand still at the end. Nodes without links are
    not listed. No links: an empty table.
    """
    low, high = F.least("_a", "_b"), F.greatest("_a", "_b")
    edges = written(links.select(low.alias("_a"), high.alias("_b")).filter("_a <> _b").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("_a", "_b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            nodes = edges.select(F.col("_b").alias("_node"), F.col("_a").alias("_label"))
            return nodes.unionByName(edges.select(F.col("_a").alias("_node"), F.col("_a").alias("_label"))).distinct()
        seen = tuple(state)
        edges = written(_small_star(written(_large_star(edges, state[0]), "links")), "links")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself. A hub's edges are spread."""
    both = edges.select(F.col("_a").alias("_u"), F.col("_b").alias("_v")).unionByName(edges.select(F.col("_b").alias("_u"), F.col("_a").alias("_v")))
    least = written(both.groupBy("_u").agg(F.least(F.col("_u"), F.min("_v")).alias("_m"), F.count("*").alias("_n")), "least")
    moved = spread_join(both.filter(F.col("_v") > F.col("_u")), least, "_u", "_n", 2 * n)
    return moved.select(F.col("_m").alias("_a"), F.col("_v").alias("_b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them. Edges are (smaller _a, larger _b)."""
    least = written(edges.groupBy(F.col("_b")).agg(F.min("_a").alias("_m"), F.count("*").alias("_n")), "least")
    joined = spread_join(edges, least, "_b", "_n")
    moved = joined.select(F.col("_m").alias("_x"), F.col("_a").alias("_y")).unionByName(joined.select(F.col("_m").alias("_x"), F.col("_b").alias("_y")))
    return moved.filter("_x <> _y").select(F.col("_x").alias("_a"), F.col("_y").alias("_b")).distinct()
