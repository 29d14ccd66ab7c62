"""Search phrases, overviews and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_top, largest_first
from tradeweave.operators.edges import neighbours


def _matching(entities: DataFrame, text: str) -> DataFrame:
    return entities.where(
        F.col("name").contains(text) | (F.col("entity_id").cast("string") == F.lit(text))
    )


def find_entities(entities: DataFrame, text: str, n: int = 10) -> DataFrame:
    """Entities whose name contains the text or whose id equals it."""
    return (
        _matching(entities, text)
        .orderBy("entity_id")
        .limit(n)
        .select("entity_id", "name", "region", "segment", "status")
    )


def partners_of(trades: DataFrame, entities: DataFrame, text: str) -> DataFrame:
    found = _matching(entities, text).select(F.col("entity_id").alias("id"), "name")
    edges = neighbours(trades).join(found, "id")
    return attach(edges, entities, "nbr", {"name": "partner_name"}).select(
        "id", "name", F.col("nbr").alias("partner_id"), "partner_name", "outgoing",
        F.col("amount").cast("double").alias("amount"), "tx_count",
    )


def products_for(entities: DataFrame, holdings: DataFrame, products: DataFrame, text: str) -> DataFrame:
    found = _matching(entities, text).select("entity_id", "name")
    return (
        holdings.join(found, "entity_id")
        .join(products.select("product_id", F.col("name").alias("product"), "pillar"), "product_id")
        .select("entity_id", "name", "product_id", "product", "pillar", "since")
    )


def deep_dive_rows(
    entities: DataFrame,
    industries: DataFrame,
    holdings: DataFrame,
    products: DataFrame,
    trades: DataFrame,
    text: str,
    n: int = 50,
) -> DataFrame:
    """First n combinations of a matched entity's industry, products and partner edges.

    In this order the first n rows come from the first n entities, and from the
    first n products and edges of each, so only those are ever combined.
    """
    found = broadcast_top(
        _matching(entities, text).select("entity_id", "name", "sic_code").orderBy("entity_id").limit(n), n
    )
    ids = broadcast_top(found.select("entity_id"), n)

    def first(rows: DataFrame, *order: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("entity_id").orderBy(*order))
        mine = rows.join(ids, "entity_id", "left_semi")
        return mine.withColumn("place", place).where(F.col("place") <= n).drop("place")

    field = industries.select("sic_code", F.col("name").alias("industry"))
    held = first(holdings, "product_id").join(
        products.select("product_id", F.col("name").alias("product")), "product_id"
    ).select("entity_id", "product_id", "product")
    edges = first(
        neighbours(trades).select(
            F.col("id").alias("entity_id"), F.col("nbr").alias("partner_id"), "outgoing",
            F.col("amount").cast("double").alias("amount"),
        ),
        "partner_id",
        "outgoing",
    )
    rows = (
        found.join(field, "sic_code", "left")
        .join(held, "entity_id", "left")
        .join(edges, "entity_id", "left")
        .orderBy(
            "entity_id",
            F.col("product_id").asc_nulls_last(),
            F.col("partner_id").asc_nulls_last(),
            "outgoing",
        )
        .limit(n)
    )
    return attach(rows, entities, "partner_id", {"name": "partner_name"}, "left").select(
        "entity_id", "name", "industry", "product", "partner_id", "partner_name", "outgoing", "amount"
    )


def filter_entities(
    entities: DataFrame,
    status: str | None = None,
    segment: str | None = None,
    region: str | None = None,
    n: int = 5,
) -> DataFrame:
    chosen = entities
    for name, value in (("status", status), ("segment", segment), ("region", region)):
        if value is not None:
            chosen = chosen.where(F.col(name) == value)
    return chosen.orderBy("entity_id").limit(n).select("entity_id", "name", "region", "segment", "status")


# Label and relationship names as users of the graph know them (fixed values).
NODE_LABELS = ("Customer", "Account", "Transaction", "Industry", "Product")
EDGE_TYPES = {
    "BELONGS_TO": ("Customer", "Industry"),
    "HAS_ACCOUNT": ("Customer", "Account"),
    "HOLDS_PRODUCT": ("Customer", "Product"),
    "SENT": ("Account", "Transaction"),
    "RECEIVED_BY": ("Transaction", "Account"),
    "TRADES_WITH": ("Customer", "Customer"),
    "POTENTIAL_MATCH": ("Customer", "Customer"),
    "SIMILAR_TO": ("Customer", "Customer"),
}


def _counted(df: DataFrame, kind: str, label: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(kind).alias("kind"), F.lit(label).alias("label"), "count"
    )


def graph_counts(nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per node label, then per relationship type, each largest first."""
    parts = [_counted(df, "node", label) for label, df in nodes.items()]
    parts += [_counted(df, "relationship", label) for label, df in edges.items()]
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)
    return counts.orderBy("kind", largest_first("count"), "label")


def graph_summary(nodes: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> DataFrame:
    """Totals of nodes and relationships followed by the counts behind them."""
    counts = graph_counts(nodes, edges)
    totals = counts.groupBy("kind").agg(F.sum("count").alias("count")).select(
        "kind", F.lit("(all)").alias("label"), "count"
    )
    return totals.unionByName(counts)


def sample_rows(df: DataFrame, order: list[str], n: int, edge_type: str | None = None) -> DataFrame:
    """First n rows in key order; edges also show their type and end labels."""
    rows = df.orderBy(*order).limit(n)
    if edge_type is None:
        return rows
    from_label, to_label = EDGE_TYPES[edge_type]
    return rows.select(
        F.lit(from_label).alias("from_label"),
        F.lit(edge_type).alias("rel_type"),
        F.lit(to_label).alias("to_label"),
        "*",
    )
