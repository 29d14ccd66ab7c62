"""Unbanked entities as sales prospects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_top, keep_status, largest_first, rounded, with_status
from tradeweave.operators.edges import neighbours


def _from_banked(trades: DataFrame, entities: DataFrame) -> DataFrame:
    return trades.join(with_status(entities, "banked", "src"), "src", "left_semi")


def inbound_from_banked(trades: DataFrame, entities: DataFrame) -> DataFrame:
    """Payers, payments and amount that banked entities send to each unbanked one.

    The receiver's status is checked after the aggregation: a receiver with a
    large share of all edges is reduced on the map side before it is shuffled.
    Edges are unique per ordered pair, so the payer count is the edge count.
    """
    totals = (
        _from_banked(trades, entities)
        .groupBy("dst")
        .agg(
            F.count(F.lit(1)).alias("payers"),
            F.sum("tx_count").alias("tx_count"),
            F.sum("amount").alias("inbound"),
        )
    )
    return keep_status(totals, entities, "unbanked", "dst")


def top_unbanked(trades: DataFrame, entities: DataFrame, n: int = 25) -> DataFrame:
    best = inbound_from_banked(trades, entities).orderBy(largest_first("inbound"), "dst").limit(n)
    return (
        attach(best, entities, "dst", {"name": "name", "region": "region"})
        .select(
            F.col("dst").alias("entity_id"),
            "name",
            "region",
            "payers",
            "tx_count",
            rounded(F.col("inbound"), 2).alias("total_inbound"),
        )
        .orderBy(largest_first("total_inbound"), "entity_id")
    )


def _multi_payer(
    trades: DataFrame, entities: DataFrame, min_payers: int, n: int, count_by: str
) -> DataFrame:
    totals = inbound_from_banked(trades, entities)
    if count_by == "name":
        by_name = (
            attach(_from_banked(trades, entities), entities, "src", {"name": "payer_name"})
            .groupBy("dst")
            .agg(F.countDistinct("payer_name").alias("payers"))
        )
        totals = totals.drop("payers").join(by_name, "dst")
    elif count_by != "entity":
        raise ValueError(f"unknown payer count: {count_by}")
    best = (
        totals.where(F.col("payers") >= min_payers).orderBy(largest_first("inbound"), "dst").limit(n)
    )
    return attach(best, entities, "dst", {"name": "name", "region": "region"}).select(
        F.col("dst").alias("entity_id"),
        "name",
        "region",
        "payers",
        rounded(F.col("inbound"), 2).alias("total_inbound"),
    )


def _payers_of(targets: DataFrame, trades: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """Banked payers of a top-n list of targets, one row per edge."""
    ids = broadcast_top(targets.select(F.col("entity_id").alias("dst")), n)
    paid = _from_banked(trades.join(ids, "dst", "left_semi"), entities)
    return attach(paid, entities, "src", {"name": "payer_name"}).withColumnRenamed("dst", "entity_id")


def multi_payer_targets(
    trades: DataFrame, entities: DataFrame, min_payers: int = 3, n: int = 20, count_by: str = "entity"
) -> DataFrame:
    """Largest targets with several banked payers, one row per payer.

    The list of payers leaves as rows: a target may have more payers than one
    row, or one task, could hold.
    """
    targets = _multi_payer(trades, entities, min_payers, n, count_by)
    payers = _payers_of(targets, trades, entities, n)
    keys = ["entity_id", "payer_name"] if count_by == "name" else ["entity_id", "src", "payer_name"]
    listed = payers.select(*keys).distinct()
    return broadcast_top(targets, n).join(listed, "entity_id").drop("src")


def multi_payer_sample(
    trades: DataFrame,
    entities: DataFrame,
    min_payers: int = 3,
    n: int = 20,
    sample: int = 5,
    count_by: str = "name",
) -> DataFrame:
    """As multi_payer_targets, with only the first payer names in name order."""
    targets = _multi_payer(trades, entities, min_payers, n, count_by)
    names = _payers_of(targets, trades, entities, n).select("entity_id", "payer_name").distinct()
    place = F.row_number().over(Window.partitionBy("entity_id").orderBy("payer_name"))
    first = (
        names.withColumn("place", place)
        .where(F.col("place") <= sample)
        .groupBy("entity_id")
        .agg(F.array_join(F.array_sort(F.collect_list("payer_name")), "; ").alias("sample_payers"))
    )
    return targets.join(first, "entity_id").orderBy(largest_first("total_inbound"), "entity_id")


def unbanked_by_industry(
    trades: DataFrame, entities: DataFrame, industries: DataFrame, min_total: float = 1_000_000
) -> DataFrame:
    large = inbound_from_banked(trades, entities).where(F.col("inbound") > min_total)
    return (
        attach(large, entities, "dst", {"sic_code": "sic_code"})
        .groupBy("sic_code")
        .agg(F.count(F.lit(1)).alias("unbanked_count"), F.sum("inbound").alias("inbound"))
        .join(industries, "sic_code")
        .select(
            "sic_code",
            F.col("name").alias("industry"),
            "sector",
            "unbanked_count",
            rounded(F.col("inbound"), 2).alias("total_inbound"),
        )
        .orderBy(largest_first("total_inbound"), "sic_code")
    )


def _top_targets(trades: DataFrame, entities: DataFrame, n: int) -> DataFrame:
    """Ids of the n largest targets."""
    best = inbound_from_banked(trades, entities).orderBy(largest_first("inbound"), "dst").limit(n)
    return broadcast_top(best.select(F.col("dst").alias("entity_id")), n)


def top_target_network(trades: DataFrame, entities: DataFrame, n: int = 1) -> DataFrame:
    """All edges, in either direction, of the largest unbanked target."""
    target = _top_targets(trades, entities, n).withColumnRenamed("entity_id", "id")
    edges = neighbours(trades).join(target, "id", "left_semi")
    return attach(edges, entities, "nbr", {"name": "nbr_name", "status": "nbr_status"}).select(
        "id", "nbr", "nbr_name", "nbr_status", "outgoing",
        F.col("amount").cast("double").alias("amount"), "tx_count",
    )


def top_targets_with_payers(trades: DataFrame, entities: DataFrame, k: int = 5) -> DataFrame:
    targets = _top_targets(trades, entities, k)
    return (
        _payers_of(targets, trades, entities, k)
        .select(
            F.col("src").alias("payer_id"),
            "payer_name",
            "entity_id",
            F.col("amount").cast("double").alias("amount"),
            "tx_count",
        )
    )


def multi_payer_edges(trades: DataFrame, entities: DataFrame, min_payers: int = 4) -> DataFrame:
    """Edges into unbanked entities that have enough banked payers."""
    chosen = (
        inbound_from_banked(trades, entities).where(F.col("payers") >= min_payers).select("dst", "payers")
    )
    return (
        _from_banked(trades, entities)
        .join(chosen, "dst")
        .select("src", "dst", "payers", F.col("amount").cast("double").alias("amount"), "tx_count")
    )


def value_to_unbanked(trades: DataFrame, entities: DataFrame) -> DataFrame:
    return inbound_from_banked(trades, entities).agg(
        F.coalesce(F.sum("payers"), F.lit(0)).alias("relationships"),
        rounded(F.coalesce(F.sum("inbound"), F.lit(0)), 2).alias("total_value"),
    )
