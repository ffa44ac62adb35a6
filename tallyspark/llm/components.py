"""Connected components of a graph of links, by rounds of contraction.

Each round every node points to its smallest neighbour, pointers are followed to their ends
by doubling, and the links are rewritten between those ends. Links that fall inside one end
vanish, so the graph shrinks by at least half of its nodes a round. All tables of a round
are written, so that the plan stays short and survives lost executors. Joins are on plain
columns of written tables: AQE splits a partition that one node has made large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, stash


def _pointers(links: DataFrame) -> DataFrame:
    """(node, parent) over all nodes: parent is the end of the chain of smallest neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pointers = stash(
        both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.min("b"), F.first("a")).alias("parent")
        ),
        "pointers",
    )
    while True:
        on = pointers.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        followed = pointers.join(on, "parent").select(
            "node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")
        )
        followed = stash(followed, "followed")
        discard(pointers)
        pointers = followed.select("node", "parent")
        if followed.filter("moved").isEmpty():
            return pointers


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the same in a whole component.

    Nodes are longs; links with a null end or with equal ends are no links. Without links
    the result is empty.
    """
    links = stash(links.filter("a <> b").select("a", "b").distinct(), "links")
    found: DataFrame | None = None
    while not links.isEmpty():
        pointers = _pointers(links)
        a = pointers.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = pointers.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        before = links
        links = stash(
            links.join(a, "a")
            .join(b, "b")
            .filter("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .distinct(),
            "links",
        )
        discard(before)
        if found is None:
            found = pointers.select("node", F.col("parent").alias("root"))
        else:
            later = pointers.select(F.col("node").alias("root"), F.col("parent").alias("end"))
            known = found
            found = stash(
                found.join(later, "root", "left").select(
                    "node", F.coalesce("end", "root").alias("root")
                ),
                "found",
            )
            discard(known)
            discard(pointers)
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
