"""Connected components of a link table, by contraction.

Every node points at its smallest neighbour if that is smaller than itself; pointers are followed to their
ends by doubling; links are rewritten between the ends and those inside a component fall away. Each round is
an aggregate with map-side combination and joins Spark may split, written to files of the checkpoint folder, whose
size the planner of the next round then knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.plans.attach import has_at_most
from tablewright.plans.lineage import cut_seeing, filed

#: Two long integers a row.
BROADCAST_NODES = 200_000


def sided(nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Pointers of few nodes are broadcast, so that a node with very many links is no key of a shuffle. ``rows``: their
    number, if it is known."""
    few = has_at_most(nodes, BROADCAST_NODES) if rows is None else rows <= BROADCAST_NODES
    return F.broadcast(nodes) if few else nodes


def flatten(parent: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, parent) with every parent an end; ``parent`` is on disk and has ``rows`` rows, if that is known."""
    while True:
        up = parent.where("node != parent").select(F.col("node").alias("_p"), F.col("parent").alias("_pp"))
        further = F.coalesce("_pp", "parent")
        parent, moved = cut_seeing(
            parent.join(sided(up, rows), F.col("parent") == F.col("_p"), "left").select(
                "node", further.alias("parent"), (further != F.col("parent")).alias("_moved")
            ),
            F.count_if("_moved"),
            filed,
        )
        parent = parent.drop("_moved")
        if not moved:
            return parent


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b). The root is the smallest node of the component."""
    links, left = cut_seeing(undirected(links), F.count("*"), filed)
    labels = None
    while left:
        both = links.union(links.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        parent, rows = cut_seeing(parent.select("node", F.least("node", "_least").alias("parent")), F.count("*"), filed)
        parent = flatten(parent, rows)
        # ends stay as they are, so their pointers are not sent to the joins
        to = sided(parent.where("node != parent").select(F.col("node").alias("_n"), F.col("parent").alias("_p")), rows)
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("root"))
        else:
            labels = filed(labels.join(to, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_p", "root").alias("root")))
        moved = links.join(to, F.col("a") == F.col("_n"), "left").select(F.coalesce("_p", "a").alias("a"), "b")
        moved = moved.join(to, F.col("b") == F.col("_n"), "left").select("a", F.coalesce("_p", "b").alias("b"))
        links, left = cut_seeing(undirected(moved), F.count("*"), filed)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def undirected(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
