"""Betweenness centrality over unweighted shortest paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.hubs import HUB_DEGREE
from tradeweave.operators.network.projection import on_slots, spread_edges
from tradeweave.session import passing_tables, write_table

#: Rows of (source, node) that may be stored at once; sources are taken in batches that keep to it.
ROWS_ALIVE = 500_000_000


def pivots(nodes: DataFrame, sources: int, seed: int = 0) -> DataFrame:
    """``sources`` ids in an order drawn by MD5, which any engine repeats."""
    return nodes.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(seed))), "id").limit(sources)


def betweenness(
    nodes: DataFrame,
    pairs: DataFrame,
    sources: int | None = None,
    seed: int = 0,
    batches: int | None = None,
    hub_degree: int = HUB_DEGREE,
    rows_alive: int = ROWS_ALIVE,
) -> DataFrame:
    """(entity_id, betweenness) from distinct undirected (id, nbr) pairs.

    The sources of a batch walk outwards together, one level per join: rows are (source,
    node, paths).  Dependencies then flow back level by level and are added to a running
    sum of one row a node, and the batch's tables are deleted.  A batch has as many sources as ``rows_alive`` allows
    with a row for every node, unless ``batches`` is given.  ``sources`` picks
    that many pivots by a seeded hash and scales the result; the default is exact.
    """
    spark = nodes.sparkSession
    spread = spread_edges(pairs, "id", "nbr", F.lit(1), hub_degree)
    slots = spread.slots.withColumnRenamed("near", "node")
    n_nodes = nodes.count()
    starts, scale = nodes.select(F.col("id").alias("source")), 0.5
    if sources is not None:
        starts = pivots(nodes, sources, seed).select(F.col("id").alias("source"))
        scale *= n_nodes / max(min(sources, n_nodes), 1)
    starts = write_table(starts.join(slots.select(F.col("node").alias("source")), "source", "left_semi"), "sources")
    if batches is None:
        batches = -(-starts.count() * n_nodes // rows_alive)

    def send(rows: DataFrame, value: str) -> DataFrame:
        """Add up a value over the edges out of each (source, node)."""
        placed = on_slots(rows.join(slots, "node")).withColumnRenamed("node", "near")
        return (
            spread.edges.join(placed, ["near", "slot"])
            .groupBy("source", F.col("far").alias("node"))
            .agg(F.sum(value).alias(value))
        )

    total = None
    for batch in range(batches):
        mine = starts if batches == 1 else starts.where(F.pmod(F.xxhash64("source"), F.lit(batches)) == batch)
        with passing_tables(spark, "bfs") as write:
            parts = _dependencies(mine, send, write)
            if parts:
                summed = parts[0] if total is None else parts[0].unionByName(total)
                for part in parts[1:]:
                    summed = summed.unionByName(part)
                total = write_table(summed.groupBy("node").agg(F.sum("dependency").alias("dependency")), "dependency")
    scores = nodes.select(F.col("id").alias("node"))
    scores = scores.withColumn("dependency", F.lit(0.0)) if total is None else scores.join(total, "node", "left")
    result = write_table(
        scores.select(
            F.col("node").alias("entity_id"),
            (F.coalesce("dependency", F.lit(0.0)) * scale).alias("betweenness"),
        ),
        "betweenness",
    )
    spread.release()
    return result


def _dependencies(starts: DataFrame, send: Callable[[DataFrame, str], DataFrame], write: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """(node, dependency) of each inner level, summed over the starts."""
    levels = [write(starts.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))]
    while True:
        # A neighbour of this level lies in the level before, in this one or in the next.
        seen = levels[-1].select("source", "node")
        if len(levels) > 1:
            seen = seen.unionByName(levels[-2].select("source", "node"))
        found = write(send(levels[-1], "paths").join(seen, ["source", "node"], "left_anti"))
        if found.isEmpty():
            break
        levels.append(found)
    parts, below = [], None
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth]
        if below is None:
            judged = level.withColumn("dependency", F.lit(0.0))
        else:
            judged = level.join(below, ["source", "node"], "left").select(
                "source", "node", "paths", (F.col("paths") * F.coalesce("flow", F.lit(0.0))).alias("dependency")
            )
            judged = write(judged)
            parts.append(judged.groupBy("node").agg(F.sum("dependency").alias("dependency")))
        if depth > 1:
            below = send(
                judged.select("source", "node", ((1.0 + F.col("dependency")) / F.col("paths")).alias("flow")),
                "flow",
            )
    return parts
