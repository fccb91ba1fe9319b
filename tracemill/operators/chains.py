"""Paths in trees by pointer doubling: a round joins every node's ancestor at distance 2^k with itself, so paths of length d need log2(d) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import dropped, settled


def closure(links: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of every node of ``links`` (node, parent) and each of its ancestors, at its least depth.

    A chain ends where it would meet itself, so cycles are walked once and no node is its own ancestor. Links of a node to
    itself and with nulls are left out; a node with several parents has the ancestors of all.
    """
    up = settled(links.where("node <> parent").select("node", F.col("parent").alias("ancestor")).distinct())
    found, n, width = settled(up.withColumn("depth", F.lit(1).cast("bigint"))), up.count(), 1
    while n:
        far = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
        more = found.join(far, "ancestor").where("next <> node").select("node", F.col("next").alias("ancestor"), (F.col("depth") + width).alias("depth"))
        grown = settled(found.unionByName(more).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        size = grown.count()
        dropped(found)
        found = grown
        if size == n:
            break
        above = settled(up.join(far, "ancestor").select("node", F.col("next").alias("ancestor")).distinct())
        dropped(up)
        up, n, width = above, size, width * 2
    dropped(up)
    return found


def paths(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session, node, dist) of each node from a session's leaf up to its root; ``nodes`` are (session, node, up), ``leaves`` (session, leaf).

    A cycle is walked on until the path is longer than the session has nodes. A leaf that is not a node has no path.
    """
    up = settled(nodes.where("up is not null").select("session", "node", F.col("up").alias("far")))
    there = nodes.select("session", "node")
    found = settled(leaves.where("leaf is not null").select("session", F.col("leaf").alias("node")).join(there, ["session", "node"], "left_semi").distinct().withColumn("dist", F.lit(0).cast("bigint")))
    most = nodes.groupBy("session").count().agg(F.max("count")).first()[0] or 0
    n, width = found.count(), 1
    while n:
        more = found.join(up, ["session", "node"]).select("session", F.col("far").alias("node"), (F.col("dist") + width).alias("dist"))
        grown = settled(found.unionByName(more))
        size = grown.count()
        dropped(found)
        found = grown
        if size == n or width > most:
            break
        above = settled(up.join(up.select("session", F.col("node").alias("far"), F.col("far").alias("next")), ["session", "far"]).select("session", "node", F.col("next").alias("far")))
        dropped(up)
        up, n, width = above, size, width * 2
    dropped(up)
    return found


def active(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session, node, at, place): what is shown of each session of ``leaves``, numbered from 1.

    ``nodes`` are (session, node, up, at). Shown is the chain from the session's leaf up to its root, the root first. Where
    there is no leaf, or it is no node, or the chain has a parent that is no node or meets itself, all nodes are shown in
    the order of ``at``.
    """
    nodes = settled(nodes)
    path = paths(nodes.select("session", "node", "up"), leaves)
    sizes = nodes.groupBy("session").agg(F.count("*").alias("nodes"))
    # A dangling parent is on the path and no node; a cycle has more places than the session has nodes.
    met = path.join(nodes.select("session", "node", F.lit(True).alias("there")), ["session", "node"], "left")
    broken = met.groupBy("session").agg(F.max("dist").alias("far"), F.bool_or(F.col("there").isNull()).alias("dangling")).join(sizes, "session").where("dangling or far >= nodes").select("session")
    good = path.join(broken, "session", "left_anti")
    order = Window.partitionBy("session")
    chain = good.join(nodes, ["session", "node"]).select("session", "node", "at", F.row_number().over(order.orderBy(F.desc("dist"))).cast("bigint").alias("place"))
    others = nodes.join(good.select("session").distinct(), "session", "left_anti").join(leaves.select("session"), "session", "left_semi")
    return chain.unionByName(others.select("session", "node", "at", F.row_number().over(order.orderBy("at")).cast("bigint").alias("place")))
