"""Fewest-hop paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach
from tradeweave.session import write_table


def _next_level(pairs: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(id, via): the nodes one step beyond the last level, and all their neighbours in it."""
    # Neighbours of a level lie in the level before, in it, or in the next one.
    seen = levels[-1].select("id")
    if len(levels) > 1:
        seen = seen.unionByName(levels[-2].select("id"))
    reached = pairs.join(levels[-1].select("id").distinct(), "id", "left_semi").select(F.col("nbr").alias("id"), F.col("id").alias("via")).distinct()
    return write_table(reached.join(seen.distinct(), "id", "left_anti"), "path")


def shortest_path(
    trades: DataFrame, entities: DataFrame, a, b, max_hops: int | None = None
) -> DataFrame:
    """One row per step of a fewest-hop undirected path from a to b; no rows if none.

    The search runs from both ends and always widens the end with fewer nodes, until
    the two meet; each end then only went part of the way.  Of all shortest paths the one is taken that,
    going back from b, always steps to the smallest node that is closer to a.
    """
    pairs = trades.select(F.col("src").alias("id"), F.col("dst").alias("nbr")).unionByName(
        trades.select(F.col("dst").alias("id"), F.col("src").alias("nbr"))
    )

    def end(key) -> DataFrame:
        me = entities.where(F.col("entity_id") == F.lit(key)).select(F.col("entity_id").alias("id"))
        return write_table(me.withColumn("via", F.col("id")), "path")

    sides = [[end(a)], [end(b)]]
    widths = [side[0].count() for side in sides]
    apart = sides[0][0].join(sides[1][0], "id", "left_semi").isEmpty()
    while all(widths) and apart and (max_hops is None or len(sides[0]) + len(sides[1]) - 2 < max_hops):
        k = int(widths[1] < widths[0])
        sides[k].append(_next_level(pairs, sides[k]))
        widths[k] = sides[k][-1].select("id").distinct().count()
        apart = sides[0][-1].join(sides[1][-1].select("id"), "id", "left_semi").isEmpty()

    from_a, from_b = sides
    hops = len(from_a) + len(from_b) - 2
    nodes = [] if apart else [b]
    if not apart:
        # From the meeting nodes on towards b: only what lies on a shortest path.
        on_path = from_a[-1].join(from_b[-1].select("id").distinct(), "id", "left_semi").select("id").distinct()
        steps = []
        for level in reversed(from_b[1:]):
            steps.append(write_table(level.join(on_path, "id", "left_semi"), "path"))
            on_path = steps[-1].select(F.col("via").alias("id")).distinct()
        for step in reversed(steps):
            nodes.append(step.where(F.col("via") == F.lit(nodes[-1])).agg(F.min("id")).first()[0])
        for level in reversed(from_a[1:]):
            nodes.append(level.where(F.col("id") == F.lit(nodes[-1])).agg(F.min("via")).first()[0])
    key_type = entities.schema["entity_id"].dataType.simpleString()
    rows = entities.sparkSession.createDataFrame([(k, node) for k, node in enumerate(reversed(nodes))], f"step long, entity_id {key_type}")
    return (
        attach(rows, entities, "entity_id", {"name": "name"})
        .select(F.lit(hops).cast("long").alias("hops"), "step", "entity_id", "name")
        .orderBy("step")
    )
