"""Small column helpers used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Round half away from zero on the decimal value, returned as double."""
    return F.round(value.cast("decimal(28,8)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL when the denominator is zero."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom)


def largest_first(name: str) -> Column:
    """Descending order in which a missing value counts as the largest."""
    return F.col(name).desc_nulls_first()


def smallest_first(name: str) -> Column:
    """Ascending order in which a missing value counts as the largest."""
    return F.col(name).asc_nulls_last()


def attach(df: DataFrame, entities: DataFrame, key: str, fields: dict[str, str], how: str = "inner") -> DataFrame:
    """Look up entity attributes by id: ``fields`` maps attribute to output name."""
    side = entities.select(
        F.col("entity_id").alias(key),
        *[F.col(source).alias(target) for source, target in fields.items()],
    )
    return df.join(side, key, how)


def with_status(entities: DataFrame, status: str, key: str) -> DataFrame:
    """Ids of the entities that have a status, named ``key`` for a semi join."""
    return entities.where(F.col("status") == status).select(F.col("entity_id").alias(key))


def keep_status(totals: DataFrame, entities: DataFrame, status: str, key: str) -> DataFrame:
    """Keep per-entity totals whose entity has a status.

    Ids are unique, so this inner join equals a semi join; but the optimizer
    would move a semi join below the aggregation, where a receiver of a third of
    all edges would be shuffled unreduced.
    """
    return totals.join(with_status(entities, status, key), key)


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Spread rows evenly before a step that costs CPU rather than bytes.

    A fixed partition count keeps small but expensive inputs from being merged
    into a few tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


# Rows that may be sent to every executor once their number has been checked.
BROADCAST_ROWS = 100_000


def broadcast_top(df: DataFrame, n: int | None) -> DataFrame:
    """Mark df, of n rows at most, for broadcast unless the caller asked for very many rows."""
    return F.broadcast(df) if n is not None and n <= BROADCAST_ROWS else df


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast if a count, cut off above max_rows, shows it is small.

    For look-ups that start from one entity: they then read the large table once
    instead of shuffling it.  An entity too busy for that falls back to a
    shuffled join.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
