"""Connected components of a table of links, without bringing links or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import common

#: Links that are worked off in one task, without a shuffle for each of the steps; more are dealt out.
FEW = 1_000


def _roots(nodes: DataFrame) -> DataFrame:
    """(node, up) with ``up`` the end of each node's path by ``up``: doubled until nothing changes. No path has a cycle."""
    while True:
        over = nodes.select(F.col("node").alias("up"), F.col("up").alias("over"))
        after = common.materialize(nodes.join(over, "up").select("node", F.col("over").alias("up"), (F.col("over") != F.col("up")).alias("moved")), "roots")
        nodes = after.drop("moved")
        if after.where("moved").isEmpty():
            return nodes


def _together(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` in one partition if they are few, so that steps over them need no shuffle."""
    return rows.coalesce(1) if rows.limit(FEW + 1).count() <= FEW else rows


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (lo, hi): ``label`` is the smallest node that it reaches.

    Each round draws every node to the smallest of its neighbours and itself, and on along such steps to their end; each
    end then stands for all that came to it, and the links between ends are the next round's. The first round's order is
    that of the ids, which settles stars at once; each later round has a hash order of its own, in which a linked node is
    an end with a chance of a half at most, so rounds grow with the logarithm of the nodes whatever the ids. Each
    round's tables are written to the shared folder. An empty input gives an empty result.
    """
    both = links.select(F.explode(F.array(F.struct("lo", "hi"), F.struct(F.col("hi").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select("e.lo", "e.hi")
    edges = _together(common.materialize(both.distinct(), "edges"))
    ends = common.materialize(edges.select(F.col("lo").alias("node")).distinct().withColumn("end", F.col("node")), "ends")
    turn = 0
    edges = edges.where("lo <> hi")
    while not edges.isEmpty():
        edges = _together(edges)
        key = lambda c: F.struct((F.xxhash64(F.lit(turn), c) if turn else F.lit(0)).alias("at"), F.col(c).alias("node"))  # noqa: B023, E731
        least = edges.groupBy(F.col("lo").alias("node")).agg(F.min(key("hi")).alias("least"))
        up = common.materialize(least.select("node", F.least("least", key("node"))["node"].alias("up")), "up")
        roots = _roots(up)
        ends = common.materialize(ends.join(roots.withColumnRenamed("node", "end"), "end", "left").select("node", F.coalesce("up", "end").alias("end")), "ends")
        lo, hi = (roots.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in ("lo", "hi"))
        edges = common.materialize(edges.join(lo, "lo").join(hi, "hi").where("lo_up <> hi_up").select(F.col("lo_up").alias("lo"), F.col("hi_up").alias("hi")).distinct(), "edges")
        turn += 1
    ends = _together(ends)
    smallest = ends.groupBy("end").agg(F.min("node").alias("label"))
    return common.materialize(ends.join(smallest, "end").select("node", "label"), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after more stored ``links`` (lo, hi): these alone are walked, between the components that there are."""
    lo, hi = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("lo", "hi"))
    between = _together(links).join(lo, "lo", "left").join(hi, "hi", "left").select(F.coalesce("lo_label", "lo").alias("lo"), F.coalesce("hi_label", "hi").alias("hi"))
    moved = components(between)
    new = moved.join(labels.select("node"), "node", "left_anti")
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    return common.materialize(old.select("node", F.coalesce("to", "label").alias("label")).unionByName(new), "labels")
