"""Set overlap by prefixes: which members two sets must share if they are alike.

Members are ranked by how many sets hold them, the rarest first.  Two sets of sizes n and m
with a Jaccard similarity of at least t have needed = ceil(t / (1 + t) * (n + m)) members in
common.  Of these the l-th stands at place n - needed + l at the latest in one set, and at
m - needed + l in the other.  So pairs are counted only where both places are
that early, and a pair with fewer than l such meetings is not alike: the
shuffled pairs are few although every similar pair is among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keeps rounding in a bound from dropping a pair.
SLACK = 1e-9
#: Meetings that are asked for, l above: more of them drop more pairs and read longer prefixes.
MEETINGS = 3


def overlap_needed(threshold: float, size: Column, other_size: Column) -> Column:
    return F.ceil(threshold / (1.0 + threshold) * (size + other_size) - SLACK)


def sizes_fit(threshold: float, size: Column, other_size: Column) -> Column:
    return F.least(size, other_size) >= threshold * F.greatest(size, other_size) - SLACK


def ranked(members: DataFrame, profile: DataFrame) -> DataFrame:
    """id, item, place (from 1, the rarest item first), held (items of the id), size and spare of distinct (id, item) rows.

    profile has id, size (of the whole set) and spare: how many members the set has besides those listed.
    """
    common = members.groupBy("item").agg(F.count(F.lit(1)).alias("_common"))
    rank = Window.partitionBy("id").orderBy("_common", "item")
    held = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return members.join(common, "item").join(profile, "id").select("id", "item", F.row_number().over(rank).alias("place"), held.alias("held"), "size", "spare")


def early(rows: DataFrame, threshold: float, meetings: int = MEETINGS) -> DataFrame:
    """The rows at which sets of at least this similarity meet often enough."""
    least = F.greatest(F.ceil(threshold * F.col("size") - SLACK) - F.col("spare"), F.lit(1))
    return rows.where(F.col("place") <= F.col("held") - least + meetings)


def _renamed(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("item", F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("place", "held", "size", "spare")])


def enough(threshold: float, a: str = "a", b: str = "b", meetings: int = MEETINGS) -> tuple[Column, Column]:
    """Whether a meeting counts, and how many meetings a similar pair has at least."""
    col = lambda side, name: F.col(f"{side}_{name}")
    needed = overlap_needed(threshold, col(a, "size"), col(b, "size")) - F.least(col(a, "spare"), col(b, "spare"))
    needed = F.greatest(needed, F.lit(1))
    both_early = (col(a, "place") <= col(a, "held") - needed + meetings) & (col(b, "place") <= col(b, "held") - needed + meetings)
    counts = both_early & (needed <= F.least(col(a, "held"), col(b, "held"))) & sizes_fit(threshold, col(a, "size"), col(b, "size"))
    return counts, F.least(needed, F.lit(meetings))


def meeting_pairs(rows: DataFrame, threshold: float, meetings: int = MEETINGS) -> DataFrame:
    """(a, b, a_size, b_size), a < b: every pair that shares listed items and can be alike enough, and few others.

    ``rows`` are those of ``ranked``.
    """
    some = early(rows, threshold, meetings)
    counts, least = enough(threshold, meetings=meetings)
    met = _renamed(some, "a").join(_renamed(some, "b"), "item").where(F.col("a") < F.col("b")).where(counts)
    return (
        met.groupBy("a", "b", "a_size", "b_size", least.cast("int").alias("least"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n >= least")
        .select("a", "b", "a_size", "b_size")
    )
