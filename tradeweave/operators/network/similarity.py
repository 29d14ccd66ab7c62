"""Entities with similar partner sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.hubs import HUB_DEGREE, Hubs, split_hubs
from tradeweave.functions.prefixes import meeting_pairs, ranked
from tradeweave.session import write_table


def _jaccard(shared, left, right):
    union = (F.col(left) + F.col(right) - shared).cast("double")
    return shared.cast("double") / union


def node_similarity(
    pairs: DataFrame, cutoff: float = 0.3, top_k: int = 5, hub_degree: int = HUB_DEGREE
) -> DataFrame:
    """(src, dst, similarity): the top_k most similar entities of each, Jaccard >= cutoff.

    ``pairs`` are distinct undirected (id, nbr) pairs.  Entities meet at the rarest of their
    partners, as many as a similar pair must have in common there; sizes travel
    with the rows, so most pairs are dropped before they are counted, and only what is
    left is compared in full.  They meet at partners of at most hub_degree
    only; see ``_through_hubs`` for the rest.
    """
    sizes = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    hubs = split_hubs(pairs, hub_degree)
    usual, profile = pairs, sizes.withColumn("spare", F.lit(0).cast("long"))
    if hubs is not None:
        usual = pairs.join(hubs.ids.select(F.col("hub").alias("nbr")), "nbr", "left_anti")
        # Hubs in common can make up for other partners.
        profile = sizes.join(hubs.classes.select("id", F.col("hubs").alias("spare")), "id", "left").fillna(0, ["spare"])
    met = write_table(meeting_pairs(ranked(usual.withColumnRenamed("nbr", "item"), profile), cutoff), "similar-candidates")
    shared = (
        met.join(pairs.select(F.col("id").alias("a"), "nbr"), "a")
        .join(pairs.select(F.col("id").alias("b"), "nbr"), ["b", "nbr"])
        .groupBy("a", "b", "a_size", "b_size")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    similar = shared.select("a", "b", _jaccard(F.col("shared"), "a_size", "b_size").alias("similarity")).where(F.col("similarity") >= cutoff)
    similar = write_table(similar, "similar-pairs")
    both = similar.select(F.col("a").alias("src"), F.col("b").alias("dst"), "similarity").unionByName(
        similar.select(F.col("b").alias("src"), F.col("a").alias("dst"), "similarity")
    )
    if hubs is not None:
        both = (
            both.unionByName(_through_hubs(hubs, sizes, cutoff, top_k))
            .groupBy("src", "dst")
            .agg(F.max("similarity").alias("similarity"))
        )
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst"))
    return both.withColumn("place", place).where(F.col("place") <= top_k).drop("place")


def _through_hubs(hubs: Hubs, sizes: DataFrame, cutoff: float, top_k: int) -> DataFrame:
    """Best partners by shared hubs alone, without pairing the entities of a hub.

    If two entities share nothing but hubs, their similarity depends only on
    their classes (hubs, size).  It is thus worked out per pair of classes, which
    meet at the rarest of their hubs like entities do at other partners, and
    each class passes on its best top_k + 1 members (one may be the entity
    itself) in (similarity, id) order.  For pairs that share more than hubs the
    value is a lower bound, and their true value comes from the other branch.  A
    partner left out here is outranked by top_k others, so nothing is lost.
    """
    keep = top_k + 1
    kind = F.concat_ws(":", "size", "hub_class").alias("id")
    members = write_table(hubs.classes.join(sizes, "id").select(F.col("id").alias("member"), "hub_class", "size", kind), "hub-members")
    in_class = F.row_number().over(Window.partitionBy("id").orderBy("member"))
    first = members.withColumn("place", in_class).where(F.col("place") <= keep).select(F.col("id").alias("other"), F.col("member").alias("dst"))
    classes = members.select("id", "hub_class", "size").distinct()
    spelled = write_table(classes.join(hubs.spelled, "hub_class").select("id", F.col("hub").alias("item")), "hub-kinds")
    met = meeting_pairs(ranked(spelled, classes.select("id", "size", F.lit(0).cast("long").alias("spare"))), cutoff)
    shared = (
        met.join(spelled.withColumnRenamed("id", "a"), "a")
        .join(spelled.withColumnRenamed("id", "b"), ["b", "item"])
        .groupBy("a", "b", "a_size", "b_size")
        .agg(F.count(F.lit(1)).alias("shared"))
        .select("a", "b", _jaccard(F.col("shared"), "a_size", "b_size").alias("similarity"))
        .where(F.col("similarity") >= cutoff)
    )
    shared = write_table(shared, "hub-similar")
    # A class also meets itself: all its hubs in common.
    own = classes.join(spelled.groupBy("id").agg(F.count(F.lit(1)).alias("hubs")), "id")
    own = own.select(F.col("id").alias("mine"), F.col("id").alias("other"), _jaccard(F.col("hubs"), "size", "size").alias("similarity")).where(F.col("similarity") >= cutoff)
    every = (
        shared.select(F.col("a").alias("mine"), F.col("b").alias("other"), "similarity")
        .unionByName(shared.select(F.col("b").alias("mine"), F.col("a").alias("other"), "similarity"))
        .unionByName(own)
    )
    rank = F.row_number().over(Window.partitionBy("mine").orderBy(F.col("similarity").desc(), "dst"))
    best = every.join(first, "other").withColumn("place", rank).where(F.col("place") <= keep)
    return (
        members.select(F.col("id").alias("mine"), F.col("member").alias("src"))
        .join(best.select("mine", "dst", "similarity"), "mine")
        .where(F.col("src") != F.col("dst"))
        .select("src", "dst", "similarity")
    )
