"""The graph's tables as the CSV files a bank would hand over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave import schema
from tradeweave.session import new_folder

CHANNELS = ("EFT", "NAV", "SOF", "SWIFT")
#: Text repeats itself; this codec is quick, and Spark reads such files by their ending.
CSV_CODEC = "snappy"


def _write(df: DataFrame, headings: dict[str, str], name: str) -> str:
    path = new_folder(df.sparkSession, name)
    layout = df.select(*[F.col(column).alias(heading) for column, heading in headings.items()])
    layout.write.option("header", True).option("escape", '"').csv(path, compression=CSV_CODEC)
    return path


def industries_csv(industries: DataFrame) -> str:
    return _write(industries, schema.INDUSTRY_HEADINGS, "industries")


def products_csv(products: DataFrame) -> str:
    return _write(products, schema.PRODUCT_HEADINGS, "products")


def entities_csv(entities: DataFrame, status: str) -> str:
    return _write(entities.where(F.col("status") == status), schema.ENTITY_HEADINGS, f"entities-{status}")


def accounts_csv(accounts: DataFrame) -> str:
    return _write(accounts, schema.ACCOUNT_HEADINGS, "accounts")


def transactions_csv(transactions: DataFrame) -> list[str]:
    """One folder per channel, all of one layout."""
    return [_write(transactions.where(F.col("channel") == c), schema.TRANSACTION_HEADINGS, f"transactions-{c}") for c in CHANNELS]


def holdings_csv(holdings: DataFrame) -> str:
    return _write(holdings, schema.HOLDING_HEADINGS, "holdings")


def truth_csv(truth: DataFrame, entities: DataFrame) -> str:
    name_of = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    named = truth.join(name_of("banked"), "banked_id").join(name_of("unbanked"), "unbanked_id")
    return _write(named, schema.TRUTH_HEADINGS, "truth")
