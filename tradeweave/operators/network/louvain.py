"""Communities by weighted modularity."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tradeweave.functions.hubs import HUB_DEGREE
from tradeweave.operators.network.projection import Projection, on_slots, spread_edges
from tradeweave.session import write_table

#: A move must gain this share of all weight, so that rounding moves nobody.
LEAST_GAIN = 1e-9


class Communities(NamedTuple):
    members: DataFrame  # entity_id, community_id
    community_count: int
    modularity: float
    modularities: list[float]  # after each level
    did_converge: bool  # the last level gained less than tol, rather than being the last one allowed


def modularity(members: DataFrame, graph: Projection, weight: str = "amount") -> float:
    """Modularity of a given (entity_id, community_id) assignment."""
    side = lambda end: members.select(F.col("entity_id").alias(end), F.col("community_id").alias(f"c_{end}"))
    edges = graph.edges.join(side("src"), "src").join(side("dst"), "dst")
    total = graph.edges.agg(F.sum(weight).cast("double").alias("t")).first()["t"]
    return _quality(edges.groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum(weight).alias("weight")), total) if total else 0.0


def _quality(merged: DataFrame, total: float) -> float:
    """Modularity of communities whose edges, loops included, are merged."""
    per = merged.groupBy("src").agg(
        F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0)).cast("double").alias("inside"),
        F.sum("weight").cast("double").alias("all"),
    )
    return float(per.agg(F.sum(F.col("inside") / total - (F.col("all") / total) * (F.col("all") / total))).first()[0])


def _coin(level: int, sweep: int) -> Column:
    """0 or 1 by id, another one for each sweep; any engine with MD5 draws the same."""
    return F.ascii(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(level), F.lit(sweep))), 1, 1)) % 2


def _settle(edges: DataFrame, total: float, sweeps: int, hub_degree: int, level: int) -> DataFrame:
    """(id, community) after nodes of one level moved between communities for up to ``sweeps`` sweeps.

    A sweep has two rounds: in the first, the nodes whose coin shows 0 may move to the neighbour
    community with the best gain, in the second the others; the smallest id wins ties.
    The level ends early when nobody moves in a sweep.  A community's total weight travels
    along the edges with its name, so a round is one job: it sums the totals, sums the links of
    the nodes whose turn it is, and writes who is where, counting the moves on the way.
    """
    spread = spread_edges(edges.where("src <> dst"), "dst", "src", F.col("weight"), hub_degree)
    slots = spread.slots.withColumnRenamed("near", "id")
    strengths = edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").cast("decimal(38,2)").alias("strength"))
    state = write_table(strengths.join(slots, "id", "left").select("id", "strength", "slots", F.col("id").alias("community")), "louvain")
    weigh = lambda c: F.col(c).cast("double")
    moves = 0
    for turn in range(2 * sweeps):
        mine = _coin(level, turn // 2) == turn % 2
        totals = state.groupBy("community").agg(F.sum("strength").alias("tot"))
        known = state.join(totals, "community")
        labels = on_slots(known.where(F.col("slots").isNotNull()).select(F.col("id").alias("near"), "slots", F.col("community").alias("target"), F.col("tot").alias("target_tot")))
        links = (
            spread.edges.withColumnRenamed("far", "id").where(mine)
            .join(labels, ["near", "slot"])
            .groupBy("id", "target", "target_tot")
            .agg(F.sum("weight").alias("link"))
        )
        own = F.col("target") == F.col("community")
        others = F.col("target_tot") - F.when(own, F.col("strength")).otherwise(0)
        gain = weigh("link") - weigh("strength") * others.cast("double") / total
        judged = links.join(known.where(mine).select("id", "strength", "community", "tot"), "id").withColumn("own", own).withColumn("gain", gain)
        best = judged.groupBy("id", "community", "strength", "tot").agg(
            F.min(F.struct((-F.col("gain")).alias("less"), F.col("target"))).alias("top"), F.max(F.when(F.col("own"), F.col("gain"))).alias("own_gain")
        )
        # A node without links into its own community can still stay there.
        stay = -weigh("strength") * (F.col("tot") - F.col("strength")).cast("double") / total
        better = -F.col("top.less") > F.coalesce("own_gain", stay) + LEAST_GAIN * total
        joined = best.where(better).select("id", F.col("top.target").alias("joined"))
        seen = Observation()
        placed = state.join(joined, "id", "left").observe(seen, F.count("joined").alias("moves"))
        state = write_table(placed.select("id", "strength", "slots", F.coalesce("joined", "community").alias("community")), "louvain")
        moves += seen.get["moves"]
        if turn % 2:
            if not moves:
                break
            moves = 0
    spread.release()
    return state.select("id", "community")


def louvain(
    graph: Projection,
    weight: str = "amount",
    max_levels: int = 10,
    max_sweeps: int = 15,
    tol: float = 1e-4,
    hub_degree: int = HUB_DEGREE,
) -> Communities:
    """Settle nodes, merge each community into one node, and repeat while that gains at least tol.

    A community is named by the id of one of its members.  Weights are summed as
    decimals, so the outcome does not depend on the order of rows.
    """
    edges = write_table(
        graph.edges.groupBy("src", "dst").agg(F.sum(weight).alias("weight")).where("weight > 0"), "louvain"
    )
    total = edges.agg(F.sum("weight").cast("double")).first()[0]
    members = graph.nodes.select(F.col("id").alias("entity_id"), F.col("id").alias("community_id"))
    history: list[float] = []
    converged = not total
    if total:
        before = _quality(edges, total)
        for level in range(max_levels):
            ends = _settle(edges, total, max_sweeps, hub_degree, level)
            merged = write_table(
                edges.join(ends.select(F.col("id").alias("src"), F.col("community").alias("c_src")), "src")
                .join(ends.select(F.col("id").alias("dst"), F.col("community").alias("c_dst")), "dst")
                .groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst"))
                .agg(F.sum("weight").alias("weight")),
                "louvain",
            )
            quality = _quality(merged, total)
            if quality - before < tol:
                converged = True
                break
            history.append(quality)
            before, edges = quality, merged
            step = ends.select(F.col("id").alias("community_id"), F.col("community").alias("merged"))
            members = write_table(
                members.join(step, "community_id", "left").select(
                    "entity_id", F.coalesce("merged", "community_id").alias("community_id")
                ),
                "communities",
            )
    count = members.select("community_id").distinct().count()
    return Communities(members, count, history[-1] if history else 0.0, history, converged)
