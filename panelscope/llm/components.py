"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Rows of two numbers that one task may hold.
TASK_ROWS = 100_000


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Each round points every node to its smallest neighbour, follows pointers
    once and contracts the edges, so the work left shrinks by a factor every
    round.  Null ends and loops are ignored.  The result is a written table.
    """
    live = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, first = None, live.count()
    left = first
    while left:
        # few rows need few tasks; more of them get more
        tasks = 1 + left // TASK_ROWS
        both = live.union(live.select("b", "a"))
        point = ws.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("to")).coalesce(tasks), "point")
        hop = point.select(F.col("node").alias("to"), F.col("to").alias("far"))
        step = ws.save(point.join(hop, "to").select("node", F.col("far").alias("to")).coalesce(tasks), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("component"))
        else:
            moved = step.select(F.col("node").alias("component"), F.col("to").alias("next"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            labels = ws.save(labels.coalesce(1 + first // TASK_ROWS), "labels")
        to_a, to_b = step.select(F.col("node").alias("a"), F.col("to").alias("x")), step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        live = live.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        live = ws.save(live.coalesce(tasks), "edges")
        left = live.count()
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels
