"""Connected components of an edge table, by alternating large and small stars.

Each star is one grouped minimum and one join over the edges; every round is written to the shared folder, so the
lineage stays short and nothing but two numbers per round reaches the driver. A hub, a node with more links than
``most_links`` and than one in ``HUBS`` of all, gets its minimum by broadcast instead: its links stay where they are, in
as many tasks as they come in. Each link has two ends, so there are fewer than 2 ``HUBS`` such nodes, at any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise

#: A hub has more links than this, and more than one in HUBS of all links.
MOST_LINKS, HUBS = 1000, 10_000


def _with_least(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """edges (u, v) with the ``m`` of u's row in ``least`` (u, n, m), where n counts the links of u."""
    hubs = least.filter(F.col("n") > most).select("u", "m")
    if not hubs.limit(1).count():
        return edges.join(least.drop("n"), "u")
    # At most 2 * HUBS rows, as ``most`` is at least one in HUBS of all links.
    others = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.filter(F.col("n") <= most).drop("n"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(others)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m"))
    least = materialise(least.select("u", "n", F.least("u", "m").alias("m")), "large-star")
    return _with_least(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Edges go from the larger to the smaller end, as large stars leave them."""
    least = materialise(edges.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")), "small-star")
    moved = _with_least(edges, least, most).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionAll(moved).distinct()


def connected_components(edges: DataFrame, most_links: int = MOST_LINKS) -> DataFrame:
    """(node, component) for every node of edges (u, v) with another in its component: the smallest node reachable,
    for all nodes but that one. Ids are integers; nulls and loops are ignored."""
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialise(pairs, "edges")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(pairs)
    while seen[0]:
        most = max(most_links, seen[0] // HUBS)
        # A large star is written, since the small star reads it three times.
        large = materialise(_large_star(pairs, most), "edges")
        pairs = materialise(_small_star(large, most), "edges")
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
