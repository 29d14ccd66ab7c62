"""CSV readers (A1-A6, A16) and literal rows.

A row whose parent is missing is not loaded.  Each child reader therefore
returns ``Loaded(accepted, rejected)``; both sides stay lazy DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave import schema


class Loaded(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def _csv(spark: SparkSession, path: str | Sequence[str], layout: str) -> DataFrame:
    """A quote inside a quoted cell is doubled, and a backslash is an ordinary character."""
    paths = path if isinstance(path, str) else list(path)
    return (
        spark.read.schema(layout)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(paths)
    )


def _text(name: str) -> Column:
    """An empty cell means the property is absent."""
    return F.nullif(F.col(name), F.lit(""))


def _number(name: str, kind: str = "double") -> Column:
    return F.col(name).try_cast(kind)


def _require(rows: DataFrame, *parents: tuple[DataFrame, str, str]) -> Loaded:
    """Keep rows all of whose parents exist; the rest are the rejects, once for each parent they lack.

    Keys that name the same parent are looked for together, so the rows are read once for all of them.
    """
    accepted = rows
    shared: list[tuple[DataFrame, str, list[str]]] = []
    for parent, parent_key, key in parents:
        accepted = accepted.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi")
        keys = next((k for p, column, k in shared if p is parent and column == parent_key), None)
        if keys is None:
            shared.append((parent, parent_key, [key]))
        else:
            keys.append(key)
    missing = [_lacking(rows, parent.select(F.col(parent_key).alias("_sought")), keys) for parent, parent_key, keys in shared]
    return Loaded(accepted.select(*rows.columns), reduce(DataFrame.unionByName, missing))


def _lacking(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The rows once for each key that is not among the ids, with ``missing_parent``."""
    if len(keys) == 1:
        sought = rows.withColumn("_sought", F.col(keys[0])).withColumn("_key", F.lit(1))
    else:
        # A number instead of the key's name: it is shuffled with every row.
        each = [F.struct(F.lit(i).alias("_key"), F.col(key).alias("_sought")) for i, key in enumerate(keys, 1)]
        sought = rows.select("*", F.inline(F.array(*each)))
    name = F.element_at(F.array(*[F.lit(key) for key in keys]), F.col("_key"))
    return sought.join(ids, "_sought", "left_anti").select(*rows.columns, name.alias("missing_parent"))


def read_industries(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schema.INDUSTRY_FILE).select(
        F.col("sicCode").alias("sic_code"), "name", "sector"
    )


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schema.PRODUCT_FILE).select(
        F.col("productId").alias("product_id"),
        "name",
        "pillar",
        _number("monthlyFee").alias("monthly_fee"),
    )


def read_entities(spark: SparkSession, banked: str, unbanked: str, industries: DataFrame) -> Loaded:
    """Banked and unbanked files as one table, told apart by ``status``.

    The unbanked file fills only id, name, region, status and industry.
    """
    full = _csv(spark, banked, schema.ENTITY_FILE).select(
        F.col("customerId").alias("entity_id"),
        "name",
        _text("registrationNumber").alias("registration_number"),
        _text("region").alias("region"),
        _text("segment").alias("segment"),
        "status",
        _number("turnover").alias("turnover"),
        _number("riskScore").alias("risk_score"),
        F.col("sicCode").alias("sic_code"),
    )
    short = _csv(spark, unbanked, schema.ENTITY_FILE).select(
        F.col("customerId").alias("entity_id"),
        "name",
        _text("region").alias("region"),
        "status",
        F.col("sicCode").alias("sic_code"),
    )
    rows = full.unionByName(short, allowMissingColumns=True).select(*schema.ENTITY_COLUMNS)
    return _require(rows, (industries, "sic_code", "sic_code"))


def read_accounts(spark: SparkSession, path: str, entities: DataFrame) -> Loaded:
    rows = _csv(spark, path, schema.ACCOUNT_FILE).select(
        F.col("accountId").alias("account_id"),
        F.col("customerId").alias("entity_id"),
        F.col("accountType").alias("account_type"),
        _number("openDate", "date").alias("open_date"),
        _number("balance").alias("balance"),
    )
    return _require(rows, (entities, "entity_id", "entity_id"))


def read_transactions(spark: SparkSession, paths: Sequence[str], accounts: DataFrame) -> Loaded:
    """All channel files in one scan; both accounts must exist."""
    rows = _csv(spark, paths, schema.TRANSACTION_FILE).select(
        F.col("transactionId").alias("transaction_id"),
        F.col("senderAccountId").alias("sender_account_id"),
        F.col("receiverAccountId").alias("receiver_account_id"),
        _number("amount", schema.MONEY).alias("amount"),
        "currency",
        _number("date", "date").alias("date"),
        "channel",
        "reference",
    )
    return _require(
        rows,
        (accounts, "account_id", "sender_account_id"),
        (accounts, "account_id", "receiver_account_id"),
    )


def read_holdings(spark: SparkSession, path: str, entities: DataFrame, products: DataFrame) -> Loaded:
    rows = _csv(spark, path, schema.HOLDING_FILE).select(
        F.col("customerId").alias("entity_id"),
        F.col("productId").alias("product_id"),
        _number("since", "date").alias("since"),
    )
    return _require(
        rows, (entities, "entity_id", "entity_id"), (products, "product_id", "product_id")
    )


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schema.TRUTH_FILE).select(
        F.col("bankedCustomerId").alias("banked_id"),
        F.col("unbankedEntityId").alias("unbanked_id"),
        F.col("bankedName").alias("banked_name"),
        F.col("unbankedVariantName").alias("unbanked_name"),
    )


def inline_rows(spark: SparkSession, rows: Sequence, layout: str) -> DataFrame:
    """A few literal rows as a table."""
    return spark.createDataFrame(list(rows), layout)
