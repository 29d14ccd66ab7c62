"""Collateral, concentration and stability scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, keep_status, largest_first, ratio, rounded, smallest_first
from tradeweave.operators.edges import neighbours


def _inflow_of_banked(trades: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct payers, payments and inflow per banked receiver.

    Status is checked after the aggregation has reduced busy receivers.
    """
    totals = trades.groupBy("dst").agg(
        F.count(F.lit(1)).alias("payers"),
        F.sum("tx_count").alias("tx_count"),
        F.sum("amount").alias("inflow"),
    )
    return keep_status(totals, entities, "banked", "dst")


def channel_diversity(transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """Distinct channels on which each entity receives, self-payments included."""
    used = transactions.select(F.col("receiver_account_id").alias("account_id"), "channel").distinct()
    return (
        used.join(accounts.select("account_id", "entity_id"), "account_id")
        .groupBy("entity_id")
        .agg(F.countDistinct("channel").alias("channels"))
    )


# Names of the grades, and the (payers, channels) that the first two need.
GRADES = ("LOW RISK", "MEDIUM RISK", "HIGHER RISK")
LOW_RISK, MEDIUM_RISK = (10, 3), (5, 2)


def collateral_grade(
    trades: DataFrame,
    transactions: DataFrame,
    accounts: DataFrame,
    entities: DataFrame,
    n: int | None = 30,
    low: tuple[int, int] = LOW_RISK,
    medium: tuple[int, int] = MEDIUM_RISK,
) -> DataFrame:
    """Grade by (distinct payers, channels); ``low`` and ``medium`` are the cuts."""
    scored = _inflow_of_banked(trades, entities).join(
        channel_diversity(transactions, accounts).withColumnRenamed("entity_id", "dst"), "dst"
    )
    if n is not None:
        scored = scored.orderBy(largest_first("inflow"), "dst").limit(n)
    reaches = lambda cut: (F.col("payers") >= cut[0]) & (F.col("channels") >= cut[1])
    grade = F.when(reaches(low), GRADES[0]).when(reaches(medium), GRADES[1]).otherwise(GRADES[2])
    return attach(
        scored, entities, "dst", {"name": "name", "segment": "segment", "risk_score": "risk_score"}
    ).select(
        F.col("dst").alias("entity_id"),
        "name",
        "segment",
        "risk_score",
        "payers",
        "channels",
        "tx_count",
        rounded(F.col("inflow"), 2).alias("total_inflow"),
        rounded(ratio(F.col("inflow"), F.col("tx_count")), 2).alias("avg_payment"),
        grade.alias("grade"),
    )


def concentration(trades: DataFrame, entities: DataFrame, n: int | None = 20) -> DataFrame:
    """Share of inflow that comes from the largest payer; ties go to the smallest id."""
    largest = F.min(F.struct((-F.col("amount")).alias("less"), F.col("src").alias("payer")))
    totals = trades.groupBy("dst").agg(F.sum("amount").alias("inflow"), largest.alias("top"))
    shares = keep_status(totals, entities, "banked", "dst").select(
        "dst",
        F.col("top.payer").alias("payer"),
        (-F.col("top.less")).alias("largest"),
        "inflow",
        rounded(ratio(-F.col("top.less") * 100, F.col("inflow")), 1).alias("concentration_pct"),
    )
    if n is not None:
        shares = shares.orderBy(largest_first("concentration_pct"), "dst").limit(n)
    shares = attach(shares, entities, "dst", {"name": "name"})
    shares = attach(shares, entities, "payer", {"name": "payer_name"})
    return shares.select(
        F.col("dst").alias("entity_id"),
        "name",
        F.col("payer").alias("payer_id"),
        "payer_name",
        rounded(F.col("largest"), 2).alias("largest_amount"),
        rounded(F.col("inflow"), 2).alias("total_inflow"),
        "concentration_pct",
    )


def stability(
    trades: DataFrame,
    entities: DataFrame,
    min_payers: int = 3,
    n: int | None = 20,
    highly_stable_below: float = 10.0,
    stable_below: float = 30.0,
) -> DataFrame:
    """Spread of the payment interval over payers that paid more than once."""
    spread = (
        trades.where(F.col("avg_interval").isNotNull())
        .groupBy("dst")
        .agg(
            F.count(F.lit(1)).alias("payers"),
            F.avg("avg_interval").alias("mean_days"),
            F.stddev_samp("avg_interval").alias("std_days"),
            F.sum("amount").alias("inflow"),
        )
        .where(F.col("payers") >= min_payers)
    )
    spread = keep_status(spread, entities, "banked", "dst").withColumn(
        "order_days", rounded(F.col("std_days"), 6)
    )
    if n is not None:
        spread = spread.orderBy(smallest_first("order_days"), "dst").limit(n)
    grade = (
        F.when(F.col("std_days") < highly_stable_below, "HIGHLY STABLE")
        .when(F.col("std_days") < stable_below, "STABLE")
        .otherwise("VARIABLE")
    )
    return attach(spread, entities, "dst", {"name": "name", "segment": "segment"}).select(
        F.col("dst").alias("entity_id"),
        "name",
        "segment",
        "payers",
        rounded(F.col("mean_days"), 1).alias("avg_interval_days"),
        rounded(F.col("std_days"), 1).alias("std_dev_days"),
        rounded(F.col("inflow"), 2).alias("total_inflow"),
        grade.alias("grade"),
    )


def customer_profile(
    entities: DataFrame,
    industries: DataFrame,
    accounts: DataFrame,
    holdings: DataFrame,
    products: DataFrame,
    trades: DataFrame,
    entity_id,
) -> DataFrame:
    """One row about one entity; every branch is counted on its own before joining."""
    me = F.lit(entity_id)
    owned = (
        accounts.where(F.col("entity_id") == me)
        .groupBy("entity_id")
        .agg(F.countDistinct("account_id").alias("accounts"))
    )
    held = (
        holdings.where(F.col("entity_id") == me)
        .join(products.select("product_id", F.col("name").alias("product")), "product_id")
        .groupBy("entity_id")
        .agg(
            F.countDistinct("product_id").alias("products"),
            F.array_join(F.array_sort(F.collect_set("product")), "; ").alias("product_names"),
        )
    )
    partners = (
        neighbours(trades)
        .where(F.col("id") == me)
        .groupBy(F.col("id").alias("entity_id"))
        .agg(F.countDistinct("nbr").alias("trading_partners"))
    )
    field = industries.select("sic_code", F.col("name").alias("industry"), "sector")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)
    return (
        entities.where(F.col("entity_id") == me)
        .join(field, "sic_code", "left")
        .join(owned, "entity_id", "left")
        .join(held, "entity_id", "left")
        .join(partners, "entity_id", "left")
        .select(
            "entity_id", "name", "segment", "region", "turnover", "risk_score", "industry", "sector",
            zero("accounts"), zero("products"),
            F.coalesce("product_names", F.lit("")).alias("product_names"),
            zero("trading_partners"),
        )
    )


def _edges_into_largest(trades: DataFrame, entities: DataFrame, condition) -> DataFrame:
    best = (
        _inflow_of_banked(trades, entities)
        .where(condition)
        .orderBy(largest_first("inflow"), "dst")
        .limit(1)
        .select("dst")
    )
    edges = trades.join(F.broadcast(best), "dst", "left_semi")
    edges = attach(edges, entities, "src", {"name": "src_name"})
    return attach(edges, entities, "dst", {"name": "dst_name"}).select(
        "src", "src_name", "dst", "dst_name", F.col("amount").cast("double").alias("amount"), "tx_count"
    )


def diversified_example(trades: DataFrame, entities: DataFrame, min_payers: int = 10) -> DataFrame:
    return _edges_into_largest(trades, entities, F.col("payers") >= min_payers)


def concentrated_example(
    trades: DataFrame, entities: DataFrame, max_payers: int = 2, min_total: float = 10_000_000
) -> DataFrame:
    return _edges_into_largest(
        trades, entities, (F.col("payers") <= max_payers) & (F.col("inflow") > min_total)
    )
