"""Entity-to-entity trade edges derived from payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.schema import MONEY_SUM


def trade_totals(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Amount, count, first and last date per ordered pair of distinct entities.

    Payments are summed per pair of accounts before any join, so an account that
    sends a large share of all rows shrinks to its distinct partners while still
    on the map side; owners are then looked up on the reduced rows.
    """
    per_account_pair = transactions.groupBy("sender_account_id", "receiver_account_id").agg(
        F.sum("amount").alias("amount"),
        F.count(F.lit(1)).alias("tx_count"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    senders = accounts.select(F.col("account_id").alias("sender_account_id"), F.col("entity_id").alias("src"))
    receivers = accounts.select(F.col("account_id").alias("receiver_account_id"), F.col("entity_id").alias("dst"))
    return (
        per_account_pair.join(senders, "sender_account_id")
        .join(receivers, "receiver_account_id")
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(
            F.sum("amount").cast(MONEY_SUM).alias("amount"),
            F.sum("tx_count").alias("tx_count"),
            F.min("first_date").alias("first_date"),
            F.max("last_date").alias("last_date"),
        )
    )


def elapsed_interval(truncate: bool = False) -> Column:
    """Mean true days between payments; the gaps add up to last minus first date."""
    days = F.datediff("last_date", "first_date")
    gaps = F.col("tx_count") - 1
    mean = days.cast("double") / gaps.cast("double")
    if truncate:
        mean = F.floor(mean).cast("double")
    return F.when(F.col("tx_count") > 1, mean)


def trades_with(transactions: DataFrame, accounts: DataFrame, truncate: bool = False) -> DataFrame:
    """The working table of most reports, mean interval included, in one aggregation."""
    return trade_totals(transactions, accounts).select(
        "src", "dst", "amount", "tx_count", elapsed_interval(truncate).alias("avg_interval")
    )


def _days_after_whole_months(earlier: Column, later: Column) -> Column:
    """Day part left after the whole months between two ordered dates are removed."""
    months = (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    day_gap = F.dayofmonth(later) - F.dayofmonth(earlier)
    return F.when(day_gap >= 0, day_gap).otherwise(F.datediff(later, F.add_months(earlier, months - 1)))


def avg_interval(
    transactions: DataFrame, accounts: DataFrame, mode: str = "elapsed", truncate: bool = False
) -> DataFrame:
    """Mean gap per ordered pair with more than one payment.

    ``elapsed`` counts true days.  ``component`` counts only the day part left in
    each gap after whole months.  Payments of one day add no gap, so a pair is
    first reduced to its distinct dates: the ordered window of even the busiest
    pair is bounded by the calendar.
    """
    if mode == "elapsed":
        return (
            trade_totals(transactions, accounts)
            .where(F.col("tx_count") > 1)
            .select("src", "dst", elapsed_interval(truncate).alias("avg_interval"))
        )
    if mode != "component":
        raise ValueError(f"unknown interval mode: {mode}")
    per_day = transactions.groupBy("sender_account_id", "receiver_account_id", "date").agg(
        F.count(F.lit(1)).alias("n")
    )
    senders = accounts.select(F.col("account_id").alias("sender_account_id"), F.col("entity_id").alias("src"))
    receivers = accounts.select(F.col("account_id").alias("receiver_account_id"), F.col("entity_id").alias("dst"))
    per_day = (
        per_day.join(senders, "sender_account_id")
        .join(receivers, "receiver_account_id")
        .where(F.col("src") != F.col("dst"))
        .groupBy("src", "dst", "date")
        .agg(F.sum("n").alias("n"))
    )
    previous = F.lag("date").over(Window.partitionBy("src", "dst").orderBy("date"))
    gap = _days_after_whole_months(F.col("previous"), F.col("date"))
    mean = F.sum("gap").cast("double") / (F.sum("n") - 1).cast("double")
    if truncate:
        mean = F.floor(mean).cast("double")
    return (
        per_day.withColumn("previous", previous)
        .withColumn("gap", F.coalesce(gap, F.lit(0)))
        .groupBy("src", "dst")
        .agg(F.when(F.sum("n") > 1, mean).alias("avg_interval"))
        .where(F.col("avg_interval").isNotNull())
    )


def neighbours(trades: DataFrame) -> DataFrame:
    """Every edge seen from both ends.

    ``outgoing`` tells which end ``id`` is, so (id, nbr, outgoing) still names
    the stored edge; reciprocal edges stay two edges.
    """
    extra = [c for c in trades.columns if c not in ("src", "dst")]
    forward = trades.select(
        F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(True).alias("outgoing"), *extra
    )
    backward = trades.select(
        F.col("dst").alias("id"), F.col("src").alias("nbr"), F.lit(False).alias("outgoing"), *extra
    )
    return forward.unionByName(backward)


def neighbour_pairs(trades: DataFrame) -> DataFrame:
    """Distinct undirected (id, nbr) pairs, both orientations.

    Unordered pairs are made unique first and mirrored afterwards, which halves
    the rows that the distinct has to shuffle.
    """
    unordered = trades.select(
        F.least("src", "dst").alias("low"), F.greatest("src", "dst").alias("high")
    ).distinct()
    low, high = F.col("low"), F.col("high")
    return unordered.select(
        F.inline(F.array(F.struct(low.alias("id"), high.alias("nbr")), F.struct(high.alias("id"), low.alias("nbr"))))
    )
