"""Table upkeep: keys, upserts, accumulation and clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.schema import MONEY_SUM


def check_unique(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their counts."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
    )


def upsert(current: DataFrame, updates: DataFrame, key: str | Sequence[str], set_cols: Sequence[str]) -> DataFrame:
    """Insert rows with a new key; for a known key replace the set columns only."""
    keys = [key] if isinstance(key, str) else list(key)
    fresh = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in set_cols], F.lit(True).alias("updated"))
    merged = current.join(fresh, keys, "full_outer")
    columns = [
        F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
        for c in current.columns
    ]
    return merged.select(*columns)


def accumulate_trades(trades: DataFrame, delta: DataFrame) -> DataFrame:
    """Add new totals to existing edges and create the edges that are missing."""
    columns = ["src", "dst", "amount", "tx_count"]
    return (
        trades.select(*columns)
        .unionByName(delta.select(*columns))
        .groupBy("src", "dst")
        .agg(F.sum("amount").cast(MONEY_SUM).alias("amount"), F.sum("tx_count").alias("tx_count"))
    )


def insert_if_absent(current: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append rows with a new key; existing rows stay untouched."""
    return current.unionByName(rows.join(current.select(*key), list(key), "left_anti").select(*rows.columns))


def link_entities(entities: DataFrame, ids: DataFrame, sic_code) -> tuple[DataFrame, DataFrame]:
    """Attach the listed entities to an industry; also returns how many exist.

    ``ids`` has one column, entity_id.
    """
    wanted = ids.select("entity_id").distinct()
    linked = entities.join(wanted.withColumn("linked", F.lit(True)), "entity_id", "left")
    kind = entities.schema["sic_code"].dataType
    updated = linked.select(
        *[
            F.when(F.col("linked"), F.lit(sic_code).cast(kind)).otherwise(F.col(c)).alias(c)
            if c == "sic_code"
            else F.col(c)
            for c in entities.columns
        ]
    )
    count = entities.join(wanted, "entity_id", "left_semi").agg(F.count(F.lit(1)).alias("customers_linked"))
    return updated, count


def delete_cascade(
    entities: DataFrame, edges: Mapping[str, tuple[DataFrame, Sequence[str]]], prefixes: Sequence[str]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Remove entities by id prefix and every edge that touches one of them.

    ``edges`` maps a name to (table, its entity id columns).
    """
    doomed = F.lit(False)
    for prefix in prefixes:
        doomed = doomed | F.col("entity_id").cast("string").startswith(prefix)
    gone = entities.where(doomed).select("entity_id")
    kept_edges = {}
    for name, (table, ends) in edges.items():
        for end in ends:
            table = table.join(gone.withColumnRenamed("entity_id", end), end, "left_anti")
        kept_edges[name] = table.select(*edges[name][0].columns)
    return entities.where(~doomed), kept_edges


def write_back(entities: DataFrame, *scores: DataFrame) -> DataFrame:
    """Attach algorithm results, each keyed by entity_id, to the entities."""
    for score in scores:
        entities = entities.join(score, "entity_id", "left")
    return entities
