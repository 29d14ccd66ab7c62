"""Weighted PageRank (G1)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.hubs import HUB_DEGREE
from tradeweave.operators.network.projection import Projection, on_slots, spread_edges
from tradeweave.session import write_table


class PageRank(NamedTuple):
    scores: DataFrame  # entity_id, page_rank
    ran_iterations: int
    did_converge: bool


def pagerank(
    graph: Projection,
    weight: str = "amount",
    damping: float = 0.85,
    iterations: int = 20,
    tol: float | None = 1e-7,
    rounds_per_job: int = 5,
    hub_degree: int = HUB_DEGREE,
) -> PageRank:
    """rank = (1 - d) + d * sum of the neighbours' ranks by weight share, from 1 - d.

    Ranks are not normalised to sum to one.  ``rounds_per_job`` rounds are planned
    together; a round only needs the ranks before it, so the plan grows linearly.
    Convergence (no rank moved by ``tol``) is looked at after the last round of
    each job.
    """
    out = graph.edges.groupBy("src").agg(F.sum(weight).cast("double").alias("total"))
    shares = (
        graph.edges.join(out.where(F.col("total") > 0), "src")
        .select("src", "dst", (F.col(weight).cast("double") / F.col("total")).alias("share"))
    )
    spread = spread_edges(shares, "src", "dst", F.col("share"), hub_degree)
    base = 1.0 - damping
    nodes = write_table(
        graph.nodes.join(spread.slots.withColumnRenamed("near", "id"), "id", "left").select("id", "slots"), "ranks"
    )

    def advance(ranks: DataFrame) -> DataFrame:
        sent = on_slots(ranks.where(F.col("slots").isNotNull()).withColumnRenamed("id", "near"))
        arrived = (
            spread.edges.join(sent, ["near", "slot"])
            .groupBy(F.col("far").alias("id"))
            .agg(F.sum(F.col("rank") * F.col("weight")).alias("arrived"))
        )
        rank = base + damping * F.coalesce("arrived", F.lit(0.0))
        return nodes.join(arrived, "id", "left").select("id", "slots", rank.alias("rank"))

    ranks = nodes.withColumn("rank", F.lit(base))
    done, converged = 0, False
    while done < iterations and not converged:
        rounds = min(rounds_per_job, iterations - done)
        for _ in range(rounds - 1):
            ranks = advance(ranks)
        if rounds > 1:
            ranks = write_table(ranks, "ranks")
        before = ranks.select("id", F.col("rank").alias("before"))
        last = write_table(advance(ranks).join(before, "id"), "ranks")
        done += rounds
        if tol is not None:
            move = last.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0]
            converged = move is None or move < tol
        ranks = last.drop("before")
    spread.release()
    return PageRank(
        ranks.select(F.col("id").alias("entity_id"), F.col("rank").alias("page_rank")), done, converged
    )
