"""A wholesale data mart (customer, supplier, part, orders, lineitem) seen as a payment graph.

Customers are banked entities and suppliers are unbanked ones; every order line
is one payment.  Some suppliers carry a customer's name with a legal suffix, so
that entity resolution has true pairs to find.  Only integer arithmetic is used
to assign ids, which keeps the mapping identical on every engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave import schema

# Fixed values of the mapping: day-to-day share of each channel out of 35 order
# keys, the share of payments (out of 100 part keys) that go to suppliers, the
# quantity up to which a payment flows back, and the legal suffixes of twins.
CHANNEL_CYCLE = 35
EFT_BELOW, NAV_BELOW, SOF_BELOW = 15, 25, 33
SUPPLIER_SHARE = 35
REVERSE_UP_TO = 7
LEGAL_SUFFIXES = (" (Group) Limited", " Limited", " Company")
SWIFT_CURRENCIES = ("ZAR", "USD", "EUR", "GBP")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def banked_id(key: Column) -> Column:
    return key * 2


def unbanked_id(key: Column) -> Column:
    return key * 2 + 1


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation")
    region = _table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation_key"), F.col("r_name").alias("region")
    )


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Part key to the two-word part name followed by its brand."""
    return _table(spark, folder, "part").select(
        F.col("p_partkey").alias("part_key"),
        F.concat_ws(" ", "p_name", F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("label"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer")
    supplier = _table(spark, folder, "supplier")
    labels = _labels(spark, folder)
    n_parts = _table(spark, folder, "part").count()

    named_customers = customer.withColumn("part_key", F.col("c_custkey") % n_parts).join(
        labels, "part_key"
    )
    full_name = F.concat_ws(" ", "label", F.lower("c_mktsegment"))
    banked = named_customers.select(
        banked_id(F.col("c_custkey")).alias("entity_id"),
        full_name.alias("name"),
        F.concat(F.lit("REG-"), F.col("c_custkey").cast("string")).alias("registration_number"),
        F.col("c_nationkey").alias("nation_key"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("banked").alias("status"),
        F.col("c_acctbal").alias("turnover"),
        ((F.col("c_custkey") * 37 % 99 + 1).cast("double") / 100.0).alias("risk_score"),
        (F.col("c_custkey") % 25).cast("int").alias("sic_code"),
    )

    key = F.col("s_suppkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in LEGAL_SUFFIXES]), (key % 3 + 1).cast("int"))
    own_industry = (key * 7 + 3) % 25
    twins = (
        supplier.where(key % 4 == 0)
        .join(named_customers, F.col("s_suppkey") == F.col("c_custkey"))
        .select(
            unbanked_id(key).alias("entity_id"),
            F.concat(full_name, suffix).alias("name"),
            F.when(key % 16 == 4, F.col("s_nationkey")).otherwise(F.col("c_nationkey")).alias("nation_key"),
            F.when(key % 16 == 8, own_industry).otherwise(key % 25).cast("int").alias("sic_code"),
        )
    )
    others = (
        supplier.where(key % 4 != 0)
        .withColumn("part_key", (key * 31 + 7) % n_parts)
        .join(labels, "part_key")
        .select(
            unbanked_id(key).alias("entity_id"),
            F.concat(F.col("label"), F.lit(" trading")).alias("name"),
            F.col("s_nationkey").alias("nation_key"),
            own_industry.cast("int").alias("sic_code"),
        )
    )
    unbanked = twins.unionByName(others).withColumn("status", F.lit("unbanked"))
    return (
        banked.unionByName(unbanked, allowMissingColumns=True)
        .join(_regions(spark, folder), "nation_key")
        .select(*schema.ENTITY_COLUMNS)
    )


def industries(spark: SparkSession, folder: str) -> DataFrame:
    code = F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2)).cast("int") - 1
    return (
        _table(spark, folder, "part")
        .select(code.alias("sic_code"), F.col("p_brand").alias("name"))
        .distinct()
        .withColumn("sector", F.concat(F.lit("Sector "), (F.col("sic_code") % 7).cast("string")))
    )


def _product_id() -> Column:
    return F.concat_ws("-", "p_type", F.substring("p_brand", 7, 9), (F.col("p_size") % 2).cast("string"))


def products(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("p_type")
    pillar = (
        F.when(kind.isin("ECONOMY", "STANDARD"), "transact")
        .when(kind.isin("PROMO", "SMALL"), "lend")
        .when(kind == "MEDIUM", "invest")
        .otherwise("insure")
    )
    return (
        _table(spark, folder, "part")
        .select(
            _product_id().alias("product_id"),
            F.concat_ws(" ", F.initcap(kind), F.substring("p_brand", 7, 9), F.when(F.col("p_size") % 2 == 0, "plan").otherwise("facility")).alias("name"),
            pillar.alias("pillar"),
            (F.length(kind) * 25).cast("double").alias("monthly_fee"),
        )
        .distinct()
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """One payment per order line: 8 of lineitem's columns and 2 of orders' are read.

    A payment is named by its order, line, part, supplier and day, so its id is the same in every run.
    """
    n_customers = _table(spark, folder, "customer").count()
    n_suppliers = _table(spark, folder, "supplier").count()
    line = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate",
    )
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")

    slot = F.col("l_orderkey") % CHANNEL_CYCLE
    channel = (
        F.when(slot < EFT_BELOW, "EFT").when(slot < NAV_BELOW, "NAV").when(slot < SOF_BELOW, "SOF").otherwise("SWIFT")
    )
    to_supplier = (F.col("o_custkey") * 3 + F.col("l_suppkey") % 4) % n_suppliers
    to_customer = (
        F.col("o_custkey") * 7 + 1 + F.col("l_linenumber").cast("long") * 11 + F.col("l_suppkey") % 3
    ) % n_customers
    to_twin = (to_customer < n_suppliers) & (to_customer % 4 == 0) & (F.col("l_partkey") % 2 == 0)
    payee = (
        F.when(F.col("l_partkey") % 100 < SUPPLIER_SHARE, unbanked_id(to_supplier))
        .when(to_twin, unbanked_id(to_customer))
        .otherwise(banked_id(to_customer))
    )
    paid = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_shipdate").cast("date").cast("string")).alias("transaction_id"),
        "l_orderkey",
        "l_partkey",
        banked_id(F.col("o_custkey")).alias("buyer"),
        payee.alias("payee"),
        F.col("l_extendedprice").cast(schema.MONEY).alias("amount"),
        F.col("l_shipdate").cast("date").alias("date"),
        channel.alias("channel"),
        F.col("l_returnflag").alias("reference"),
        ((F.col("l_quantity") <= REVERSE_UP_TO) & channel.isin("EFT", "SWIFT")).alias("reverse"),
    )
    sent = paid.select(
        "*",
        F.when(F.col("reverse"), F.col("payee")).otherwise(F.col("buyer")).alias("sender"),
        F.when(F.col("reverse"), F.col("buyer")).otherwise(F.col("payee")).alias("receiver"),
    )
    currency = F.when(
        F.col("channel") == "SWIFT",
        F.element_at(F.array(*[F.lit(c) for c in SWIFT_CURRENCIES]), (F.col("l_partkey") % 4 + 1).cast("int")),
    ).otherwise("ZAR")
    return sent.select(
        "transaction_id",
        _account("sender", "l_orderkey").alias("sender_account_id"),
        _account("receiver", "l_partkey").alias("receiver_account_id"),
        "amount",
        currency.alias("currency"),
        "date",
        "channel",
        "reference",
    )


def _account(entity: str, slot_key: str) -> Column:
    """Four account numbers per entity; an unbanked entity uses only the first."""
    owner = F.col(entity)
    per_owner = F.floor(owner / 2) % 3 + 1
    return owner * 4 + F.when(owner % 2 == 0, F.col(slot_key) % per_owner).otherwise(F.lit(0))


def accounts(spark: SparkSession, folder: str, payments: DataFrame) -> DataFrame:
    customer = _table(spark, folder, "customer")
    supplier = _table(spark, folder, "supplier")
    types = F.array(F.lit("cheque"), F.lit("savings"), F.lit("overdraft"))
    owned = customer.select(
        banked_id(F.col("c_custkey")).alias("entity_id"),
        F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("slot"),
        F.col("c_acctbal").alias("balance"),
    ).withColumn("account_type", F.element_at(types, F.col("slot") + 1))
    external = supplier.select(
        unbanked_id(F.col("s_suppkey")).alias("entity_id"),
        F.lit(0).alias("slot"),
        F.col("s_acctbal").alias("balance"),
        F.lit("external").alias("account_type"),
    )
    sides = payments.select(F.col("sender_account_id").alias("account_id"), "date").unionByName(
        payments.select(F.col("receiver_account_id").alias("account_id"), "date")
    )
    opened = sides.groupBy("account_id").agg(F.min("date").alias("open_date"))
    return (
        owned.unionByName(external)
        .withColumn("account_id", F.col("entity_id") * 4 + F.col("slot"))
        .join(opened, "account_id", "left")
        .select("account_id", "entity_id", "account_type", "open_date", "balance")
    )


def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """Products a customer holds: those of all its order lines."""
    line = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    part = _table(spark, folder, "part").select("p_partkey", _product_id().alias("product_id"))
    return (
        line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(banked_id(F.col("o_custkey")).alias("entity_id"), "product_id")
        .agg(F.min(F.col("l_shipdate").cast("date")).alias("since"))
    )


def known_twins(spark: SparkSession, folder: str) -> DataFrame:
    """The true (banked, unbanked) pairs behind the twin suppliers."""
    key = F.col("s_suppkey")
    return (
        _table(spark, folder, "supplier")
        .where(key % 4 == 0)
        .join(_table(spark, folder, "customer"), key == F.col("c_custkey"), "left_semi")
        .select(banked_id(key).alias("banked_id"), unbanked_id(key).alias("unbanked_id"))
    )
