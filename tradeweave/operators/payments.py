"""Payment behaviour reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_if_small, largest_first, ratio, rounded, with_status
from tradeweave.operators.edges import neighbours


def _name_both_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    edges = attach(edges, entities, "src", {"name": "src_name", "status": "src_status"})
    return attach(edges, entities, "dst", {"name": "dst_name", "status": "dst_status"})


def _edge_report(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return _name_both_ends(edges, entities).select(
        "src", "src_name", "src_status", "dst", "dst_name", "dst_status",
        "tx_count", F.col("amount").cast("double").alias("amount"), "avg_interval",
    )


def top_pairs(trades: DataFrame, entities: DataFrame, n: int = 20) -> DataFrame:
    """Pairs with most payments; names are looked up only for the n winners."""
    best = trades.orderBy(largest_first("tx_count"), "src", "dst").limit(n)
    return _edge_report(best, entities).orderBy(largest_first("tx_count"), "src", "dst")


def _sent_by(transactions: DataFrame, accounts: DataFrame, entity_id) -> DataFrame:
    owned = accounts.where(F.col("entity_id") == F.lit(entity_id)).select(
        F.col("account_id").alias("sender_account_id")
    )
    return transactions.join(broadcast_if_small(owned), "sender_account_id", "left_semi")


def channel_breakdown(transactions: DataFrame, accounts: DataFrame, entity_id) -> DataFrame:
    return (
        _sent_by(transactions, accounts, entity_id)
        .groupBy("channel")
        .agg(
            F.count(F.lit(1)).alias("tx_count"),
            F.sum("amount").alias("total"),
            F.min("date").alias("earliest"),
            F.max("date").alias("latest"),
        )
        .select(
            "channel",
            "tx_count",
            rounded(ratio(F.col("total"), F.col("tx_count")), 2).alias("avg_amount"),
            rounded(F.col("total"), 2).alias("total_amount"),
            "earliest",
            "latest",
        )
        .orderBy(largest_first("tx_count"), "channel")
    )


def monthly_trend(transactions: DataFrame, accounts: DataFrame, entity_id) -> DataFrame:
    return (
        _sent_by(transactions, accounts, entity_id)
        .groupBy(F.year("date").cast("long").alias("year"), F.month("date").cast("long").alias("month"))
        .agg(F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("total"))
        .select("year", "month", "tx_count", rounded(F.col("total"), 2).alias("total_amount"))
        .orderBy("year", "month")
    )


def _partners_by_amount(edges: DataFrame, entities: DataFrame, partner: str, n: int) -> DataFrame:
    best = edges.orderBy(largest_first("amount"), partner).limit(n)
    return (
        attach(best, entities, partner, {"name": "name", "status": "status"})
        .select(
            F.col(partner).alias("partner_id"),
            "name",
            "status",
            "tx_count",
            rounded(F.col("amount"), 2).alias("total_amount"),
            "avg_interval",
        )
        .orderBy(largest_first("total_amount"), "partner_id")
    )


def top_payees(trades: DataFrame, entities: DataFrame, entity_id, n: int = 15) -> DataFrame:
    return _partners_by_amount(trades.where(F.col("src") == F.lit(entity_id)), entities, "dst", n)


def top_payers(trades: DataFrame, entities: DataFrame, entity_id, n: int = 15) -> DataFrame:
    return _partners_by_amount(trades.where(F.col("dst") == F.lit(entity_id)), entities, "src", n)


def largest_relationship(trades: DataFrame, entities: DataFrame, n: int = 1) -> DataFrame:
    best = trades.orderBy(largest_first("amount"), "src", "dst").limit(n)
    return _edge_report(best, entities)


def active_pairs(trades: DataFrame, entities: DataFrame, min_tx: int = 30) -> DataFrame:
    """Edges with more than min_tx payments; the filter reaches the scan."""
    return _edge_report(trades.where(F.col("tx_count") > min_tx), entities)


def high_value_edges(
    trades: DataFrame, entities: DataFrame, min_amount: float = 50_000_000, n: int = 200
) -> DataFrame:
    """Edges above an amount seen from each banked end, largest first."""
    return (
        neighbours(trades.where(F.col("amount") > min_amount))
        .join(with_status(entities, "banked", "id"), "id", "left_semi")
        .orderBy(largest_first("amount"), "id", "nbr", "outgoing")
        .limit(n)
        .select("id", "nbr", "outgoing", F.col("amount").cast("double").alias("amount"), "tx_count")
    )
