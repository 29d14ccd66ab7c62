"""Reports on match edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_top, largest_first, ratio, rounded
from tradeweave.operators.edges import neighbour_pairs, neighbours
from tradeweave.operators.resolution.scoring import MIN_CONFIDENCE

HIGH_CONFIDENCE = 0.70


def _named(matches: DataFrame, entities: DataFrame) -> DataFrame:
    rows = attach(matches, entities, "banked_id", {"name": "banked_name", "region": "banked_region"})
    return attach(rows, entities, "unbanked_id", {"name": "unbanked_name", "region": "unbanked_region"})


def _best(matches: DataFrame, by: str, n: int | None) -> DataFrame:
    ordered = matches.orderBy(largest_first(by), "banked_id", "unbanked_id")
    return ordered if n is None else ordered.limit(n)


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count(F.lit(1)).alias("total_matches"),
        rounded(F.avg(F.col("confidence").cast("decimal(18,4)")), 3).alias("avg_confidence"),
        rounded(F.min("confidence"), 3).alias("min_confidence"),
        rounded(F.max("confidence"), 3).alias("max_confidence"),
    )


def ranked_matches(matches: DataFrame, entities: DataFrame, n: int | None = None) -> DataFrame:
    rows = _named(matches if n is None else _best(matches, "confidence", n), entities).select(
        "banked_id", "banked_name", "unbanked_id", "unbanked_name",
        "confidence", "name_sim", "industry_sim", "region_sim", "trading_sim",
    )
    return rows.orderBy(largest_first("confidence"), "banked_id", "unbanked_id")


def high_confidence(
    matches: DataFrame, entities: DataFrame, min_conf: float = HIGH_CONFIDENCE, banked_id=None
) -> DataFrame:
    chosen = matches.where(F.col("confidence") >= min_conf)
    if banked_id is not None:
        chosen = chosen.where(F.col("banked_id") == F.lit(banked_id))
    return (
        _named(chosen, entities)
        .select(
            "banked_id", "banked_name", "banked_region", "unbanked_id", "unbanked_name",
            "unbanked_region", "confidence", "name_sim", "trading_sim",
        )
        .orderBy(largest_first("confidence"), "banked_id", "unbanked_id")
    )


def review_queue(
    matches: DataFrame, entities: DataFrame, low: float = MIN_CONFIDENCE, high: float = HIGH_CONFIDENCE
) -> DataFrame:
    chosen = matches.where((F.col("confidence") >= low) & (F.col("confidence") < high))
    return (
        _named(chosen, entities)
        .select(
            "banked_id", "banked_name", "unbanked_id", "unbanked_name",
            "confidence", "name_sim", "trading_sim",
        )
        .orderBy(largest_first("confidence"), "banked_id", "unbanked_id")
    )


def _driven(matches: DataFrame, entities: DataFrame, condition: Column, by: str, n: int) -> DataFrame:
    return (
        _named(_best(matches.where(condition), by, n), entities)
        .select(
            "banked_id", "banked_name", "unbanked_id", "unbanked_name",
            "confidence", "name_sim", "trading_sim",
        )
        .orderBy(largest_first(by), "banked_id", "unbanked_id")
    )


def name_driven(
    matches: DataFrame, entities: DataFrame, min_name: float = 0.80, max_trading: float = 0.10, n: int = 15
) -> DataFrame:
    condition = (F.col("name_sim") > min_name) & (F.col("trading_sim") < max_trading)
    return _driven(matches, entities, condition, "name_sim", n)


def structure_driven(
    matches: DataFrame, entities: DataFrame, min_trading: float = 0.15, n: int = 15
) -> DataFrame:
    return _driven(matches, entities, F.col("trading_sim") > min_trading, "trading_sim", n)


def all_signals_agree(
    matches: DataFrame, entities: DataFrame, min_name: float = 0.60, min_trading: float = 0.05, n: int = 15
) -> DataFrame:
    condition = (
        (F.col("name_sim") > min_name)
        & (F.col("industry_sim") == 1.0)
        & (F.col("region_sim") == 1.0)
        & (F.col("trading_sim") > min_trading)
    )
    return _driven(matches, entities, condition, "confidence", n)


def hidden_partners(
    matches: DataFrame,
    trades: DataFrame,
    entities: DataFrame,
    min_conf: float = HIGH_CONFIDENCE,
    count_by: str = "entity",
    sample: int = 5,
    partners: DataFrame | None = None,
) -> DataFrame:
    """Partners of the unbanked side that the banked side does not trade with.

    The banked side itself counts as such a partner when the two trade, since it
    is not its own partner.  Matches that reveal nobody stay, with a zero.
    """
    chosen = matches.where(F.col("confidence") >= min_conf).select("banked_id", "unbanked_id", "confidence")
    partners = neighbour_pairs(trades) if partners is None else partners
    revealed = (
        chosen.select("banked_id", "unbanked_id")
        .join(partners.select(F.col("id").alias("unbanked_id"), "nbr"), "unbanked_id")
        .join(partners.select(F.col("id").alias("banked_id"), "nbr"), ["banked_id", "nbr"], "left_anti")
    )
    revealed = attach(revealed, entities, "nbr", {"name": "partner_name"})
    keys = ["banked_id", "unbanked_id"]
    # Both branches below start from this one aggregation, which is computed once.
    names = revealed.groupBy(*keys, "partner_name").agg(F.count(F.lit(1)).alias("entities"))
    counted = {"entity": F.sum("entities"), "name": F.count(F.lit(1))}[count_by]
    counts = names.groupBy(*keys).agg(counted.alias("new_partners"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("partner_name"))
    samples = (
        names.withColumn("place", place)
        .where(F.col("place") <= sample)
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list("partner_name")), "; ").alias("sample_partners"))
    )
    return (
        _named(chosen.join(counts, keys, "left").join(samples, keys, "left"), entities)
        .select(
            "banked_id",
            "banked_name",
            "unbanked_id",
            "unbanked_name",
            "confidence",
            F.coalesce("new_partners", F.lit(0).cast("long")).alias("new_partners"),
            F.coalesce("sample_partners", F.lit("")).alias("sample_partners"),
        )
        .orderBy(largest_first("new_partners"), "banked_id", "unbanked_id")
    )


def revenue_at_risk(
    matches: DataFrame, trades: DataFrame, entities: DataFrame, min_conf: float = 0.60, n: int | None = 20
) -> DataFrame:
    """Volume in either direction of the unbanked side of each match."""
    chosen = matches.where(F.col("confidence") >= min_conf).select("banked_id", "unbanked_id", "confidence")
    volume = (
        neighbours(trades)
        .groupBy(F.col("id").alias("unbanked_id"))
        .agg(F.sum("amount").alias("volume"))
    )
    rows = chosen.join(volume, "unbanked_id", "left").withColumn("volume", F.coalesce("volume", F.lit(0)))
    if n is not None:
        rows = rows.orderBy(largest_first("volume"), "banked_id", "unbanked_id").limit(n)
    return (
        _named(rows, entities)
        .select(
            "banked_id", "banked_name", "unbanked_id", "unbanked_name", "confidence",
            rounded(F.col("volume"), 0).alias("hidden_volume"),
        )
        .orderBy(largest_first("hidden_volume"), "banked_id", "unbanked_id")
    )


def match_network(
    matches: DataFrame, trades: DataFrame, min_conf: float = HIGH_CONFIDENCE, k: int = 1, outer: bool = False
) -> DataFrame:
    """Edges around the k best pairs, tagged with the side of the pair they belong to.

    The inner form shows a pair only if both sides trade; ``outer`` shows every
    pair, with one empty row per side that does not.  Edges of the two sides are
    listed one after the other, never multiplied with each other.
    """
    best = broadcast_top(
        _best(matches.where(F.col("confidence") >= min_conf), "confidence", k).select(
            "banked_id", "unbanked_id", "confidence"
        ),
        k,
    )
    edges = neighbours(trades).select("id", F.col("nbr").alias("partner_id"), "outgoing", F.col("amount").cast("double").alias("amount"))
    sides = best.select("*", F.explode(F.array(
        F.struct(F.lit("banked").alias("side"), F.col("banked_id").alias("id")),
        F.struct(F.lit("unbanked").alias("side"), F.col("unbanked_id").alias("id")),
    )).alias("end")).select("banked_id", "unbanked_id", "confidence", "end.side", "end.id")
    if outer:
        return sides.join(edges, "id", "left").drop("id")
    shown = edges.join(broadcast_top(sides, k), "id").drop("id")
    both = shown.groupBy("banked_id", "unbanked_id").agg(F.countDistinct("side").alias("n")).where("n = 2")
    return shown.join(both.drop("n"), ["banked_id", "unbanked_id"], "left_semi")


def edges_of(trades: DataFrame, ids: Sequence) -> DataFrame:
    """Outgoing edges of the given entities."""
    return trades.where(F.col("src").isin(list(ids))).select("src", "dst", "tx_count")


def evaluate_matches(
    matches: DataFrame, truth: DataFrame, thresholds: Sequence[float] = (0.45, 0.60, 0.70, 0.80)
) -> DataFrame:
    """Precision and recall against known pairs at each confidence threshold."""
    known = truth.select("banked_id", "unbanked_id").distinct().withColumn("known", F.lit(True))
    both = matches.select("banked_id", "unbanked_id", "confidence").join(
        known, ["banked_id", "unbanked_id"], "full_outer"
    )
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    found = F.coalesce(F.col("confidence") >= F.col("threshold"), F.lit(False))
    is_known = F.coalesce("known", F.lit(False))
    return (
        both.withColumn("threshold", cuts)
        .groupBy("threshold")
        .agg(
            F.count_if(found & is_known).alias("true_matches"),
            F.count_if(found & ~is_known).alias("false_matches"),
            F.count_if(~found & is_known).alias("missed"),
        )
        .select(
            "*",
            rounded(ratio(F.col("true_matches"), F.col("true_matches") + F.col("false_matches")), 4).alias("precision"),
            rounded(ratio(F.col("true_matches"), F.col("true_matches") + F.col("missed")), 4).alias("recall"),
        )
        .orderBy("threshold")
    )
