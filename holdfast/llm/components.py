"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped minima and joins back to the edges. Each of these steps is cut by ``checkpoint()`` in
the shared folder, so that no plan holds another one several times: what the driver keeps of a plan doesn't grow
with the rounds. The minima tell the driver (two numbers) whether the edges are stars, which ends the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import shared_dir

#: A key is common if more than one row in so many has it.
COMMON = 1000
#: Nodes for which a round's edges are kept in one file more.
NODES_A_FILE = 200_000


def components(edges: DataFrame, nodes: int | None = None, spread: bool = False) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, component)`` for every node with an edge to another one;
    component is the smallest node reachable. Self-loops and repeats don't matter; empty gives empty.

    nodes: how many nodes there are at most, if known; rounds are then written in files of about
    ``NODES_A_FILE`` nodes rather than one for every shuffle partition.

    spread: the minima of nodes with many edges are broadcast, as :func:`spread_names` does it, so that no join has
    a hot key. Else adaptive execution splits such a join beyond its size threshold. The result is the same."""
    shared_dir(edges.sparkSession)
    cut = lambda df: (df if nodes is None else df.coalesce(nodes // NODES_A_FILE + 1)).checkpoint()
    join = spread_names if spread else lambda rows, low, key, value, _: rows.join(low.select(key, value), key)
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("copies"), F.count_if(F.expr("v < u")).alias("down")))
        ends, loose = low.agg(F.sum("copies"), F.count_if(F.expr("down > 1 or down > 0 and down < copies"))).first()
        if not loose:  # a node has one edge, to a smaller one, or edges to larger ones only: its minimum is the component's
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        large = cut(join(both, low, "u", "m", ends).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies")))
        small = join(large, low, "u", "m", ends // 2).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def spread_names(rows: DataFrame, named: DataFrame, key: str, value: str, total: int) -> DataFrame:
    """``rows`` joined with ``named(key, value, copies)``; ``total`` is the sum of the copies, or more. Keys of more
    than one row in ``COMMON`` are then fewer than ``COMMON``, so they are broadcast; what is left has no hot key to
    join on. The plan holds ``rows`` twice and ``named`` three times: both should be cut."""
    hot = named.where(F.col("copies") * COMMON > total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot.select(key, value)), key).unionByName(rest.join(named.where(F.col("copies") * COMMON <= total).select(key, value), key))
