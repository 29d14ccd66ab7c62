"""The graph the algorithms run on (G0), laid out so that hubs do not pile up."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.hubs import HUB_DEGREE

# Rounds of joins are planned for about this many edges per task.
EDGES_PER_PARTITION = 500_000


class Projection(NamedTuple):
    nodes: DataFrame  # id, isolated entities included
    edges: DataFrame  # src, dst, amount, tx_count


def project_graph(trades: DataFrame, entities: DataFrame, directed: bool = False) -> Projection:
    """Entities and weighted edges; undirected by default.

    Undirected means each stored edge appears in both orientations; reciprocal
    edges stay parallel.  Missing weights become 0.0 and 1.
    """
    edges = trades.select(
        "src",
        "dst",
        F.coalesce("amount", F.lit(0)).alias("amount"),
        F.coalesce("tx_count", F.lit(1).cast("long")).alias("tx_count"),
    )
    if not directed:
        edges = edges.unionByName(
            edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "amount", "tx_count")
        )
    return Projection(entities.select(F.col("entity_id").alias("id")), edges)


class SpreadEdges(NamedTuple):
    """Edges dealt over (near, slot): one node's edges fill several partitions if many."""

    edges: DataFrame  # near, slot, far, weight
    slots: DataFrame  # near, slots
    counted: DataFrame  # what is held in memory behind slots

    def release(self) -> None:
        self.edges.unpersist()
        self.counted.unpersist()


def spread_edges(edges: DataFrame, near: str, far: str, weight: Column, hub_degree: int = HUB_DEGREE) -> SpreadEdges:
    """Partition edges by their near end once, for many rounds of joins on it.

    A node with more than hub_degree edges gets one slot per hub_degree edges, so
    no partition holds more than a bounded part of it.  Values to be sent along
    the edges are copied to every slot of their node (see ``on_slots``).
    """
    rows = edges.select(F.col(near).alias("near"), F.col(far).alias("far"), weight.alias("weight"))
    slots = rows.groupBy("near").agg(
        F.count(F.lit(1)).alias("degree"),
        F.ceil(F.count(F.lit(1)) / F.lit(hub_degree)).cast("int").alias("slots"),
    ).persist()
    spark = edges.sparkSession
    wanted = slots.agg(F.sum("degree")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, int(wanted) // EDGES_PER_PARTITION)
    dealt = (
        rows.join(slots.drop("degree"), "near")
        .withColumn("slot", F.pmod(F.xxhash64("far"), F.col("slots")).cast("int"))
        .select("near", "slot", "far", "weight")
        .repartition(parts, "near", "slot")
        .persist()
    )
    return SpreadEdges(dealt, slots.drop("degree"), slots)


def on_slots(values: DataFrame) -> DataFrame:
    """Copy each row to every slot of its node; needs a ``slots`` column."""
    return values.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
