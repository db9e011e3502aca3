"""Symbolic links: where a chain of links ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def resolve_links(nodes: DataFrame) -> DataFrame:
    """``nodes(node, target)`` (target null: no link) -> (node, last, hops, kind).

    kind: 'end' at a node that is no link, 'dangling' at one that is not there, 'cycle' on a revisit (last
    and hops are null then). Pointer doubling: each round squares the reach of every
    pointer, so a chain of n links takes about log2(n) joins; every node is a row, none is collected."""
    own = nodes.select("node", "target").dropDuplicates(["node"])
    known = own.select(F.col("node").alias("__k"), F.col("target").isNull().alias("__end"))
    step = own.where("target is not null").select("node", F.col("target").alias("at"), F.lit(1).cast("long").alias("hops"))
    step = checkpointed(step)
    reach = 1
    limit = step.count()
    while reach <= limit and step.limit(1).count():
        nxt = step.select(F.col("node").alias("__n"), F.col("at").alias("__at"), F.col("hops").alias("__h"))
        joined = step.join(nxt, F.col("at") == F.col("__n"), "left")
        moved = checkpointed(joined.select("node", F.coalesce("__at", "at").alias("at"), (F.col("hops") + F.coalesce("__h", F.lit(0))).alias("hops"), F.col("__n").isNotNull().alias("__open")))
        open_ = moved.where("__open").limit(1).count()
        step = moved.drop("__open")
        reach *= 2
        if not open_:
            break
    # what still points at a link after as many steps as there are links runs in a circle
    links = own.where("target is not null").select(F.col("node").alias("__l"))
    ended = step.join(known, F.col("at") == F.col("__k"), "left").join(links, F.col("at") == F.col("__l"), "left")
    circle = F.col("__l").isNotNull()
    kind = F.when(circle, "cycle").when(F.col("__k").isNull(), "dangling").otherwise("end")
    plain = own.where("target is null").select("node", F.col("node").alias("last"), F.lit(0).cast("long").alias("hops"), F.lit("end").alias("kind"))
    return ended.select("node", F.when(circle, F.lit(None)).otherwise(F.col("at")).alias("last"), F.when(~circle, F.col("hops")).alias("hops"), kind.alias("kind")).unionByName(plain)


def link_types(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Catalog with the types of symbolic links by what their chains end in: ``resolved`` is
    :func:`resolve_links` of (rel_path, normalised target)."""
    ends = files.select(F.col("rel_path").alias("__p"), F.col("ftype").alias("__t"))
    named = resolved.join(ends, F.col("last") == F.col("__p"), "left").select(F.col("node").alias("__node"), F.when(F.col("kind") != "end", F.col("kind")).otherwise(F.coalesce("__t", F.lit("unknown"))).alias("__kind"))
    joined = files.join(named, F.col("rel_path") == F.col("__node"), "left")
    kind = F.when(F.col("link_dst").isNotNull(), F.concat(F.lit("symlink_"), F.coalesce("__kind", F.lit("unknown")))).otherwise(F.col("ftype"))
    return joined.select(*(kind.alias(c) if c == "ftype" else F.col(c) for c in files.columns))
