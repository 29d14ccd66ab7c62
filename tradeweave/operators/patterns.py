"""Money-laundering patterns between accounts (M1, M2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.functions.columns import attach, broadcast_if_small, largest_first, ratio, rounded
from tradeweave.session import write_table

#: Legs of one account above which it is set aside or spread, and the share of links that makes another round of pruning worth its job.
BUSY = 10_000
WORTH_PRUNING = 0.1


def _with_owner(rows: DataFrame, accounts: DataFrame, entities: DataFrame, key: str, prefix: str) -> DataFrame:
    owners = accounts.select(F.col("account_id").alias(key), F.col("entity_id").alias(f"{prefix}_id"))
    return attach(
        rows.join(owners, key),
        entities,
        f"{prefix}_id",
        {"name": f"{prefix}_name", "risk_score": f"{prefix}_risk", "segment": f"{prefix}_segment", "region": f"{prefix}_region"},
    )


def account_fan_out(
    transactions: DataFrame, accounts: DataFrame, entities: DataFrame, min_dests: int = 4, n: int | None = 15
) -> DataFrame:
    """Accounts that pay many others.

    Rows are first summed per pair of accounts, which also makes the destinations
    distinct, so the second aggregation is a plain count.
    """
    spread = (
        transactions.where(F.col("sender_account_id") != F.col("receiver_account_id"))
        .groupBy("sender_account_id", "receiver_account_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
        .groupBy("sender_account_id")
        .agg(
            F.count(F.lit(1)).alias("destinations"),
            F.sum("n").alias("tx_count"),
            F.sum("amount").alias("sent"),
        )
        .where(F.col("destinations") >= min_dests)
    )
    if n is not None:
        spread = spread.orderBy(largest_first("destinations"), largest_first("sent"), "sender_account_id").limit(n)
    return _with_owner(spread, accounts, entities, "sender_account_id", "source").select(
        F.col("sender_account_id").alias("account_id"),
        "source_id",
        "source_name",
        "source_risk",
        "source_segment",
        "source_region",
        "destinations",
        "tx_count",
        rounded(F.col("sent"), 2).alias("total_sent"),
        rounded(ratio(F.col("sent"), F.col("destinations")), 2).alias("avg_per_destination"),
    )


def _leg_table(transactions: DataFrame) -> DataFrame:
    """Payments per ordered pair of accounts and day."""
    return (
        transactions.where(F.col("sender_account_id") != F.col("receiver_account_id"))
        .groupBy(F.col("sender_account_id").alias("payer"), F.col("receiver_account_id").alias("payee"), "date")
        .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    )


def _follow(first: DataFrame, second: DataFrame, keys: list[str], max_days: int, slots: DataFrame | None = None) -> DataFrame:
    """Pairs of a payment and a later one within max_days, joined on keys and day bucket.

    A bucket spans max_days + 1 days, so the second payment lies in the bucket of
    the first or in the next one; each first payment is offered to both.  ``slots`` names busy middles:
    their first payments are dealt out and their second ones copied to every slot.
    """
    width = max_days + 1
    day = F.unix_date("date")
    left = first.withColumn("bucket", F.explode(F.array(F.floor(day / width), F.floor(day / width) + 1)))
    right = second.select(
        *keys, *[c for c in second.columns if c not in (*keys, "date", "n", "amount")],
        F.col("date").alias("later"), F.col("n").alias("later_n"), F.floor(day / width).alias("bucket"),
    )
    on = [*keys, "bucket"]
    if slots is not None:
        left = left.join(slots, "mid", "left").withColumn("slot", F.pmod(F.xxhash64("source", "date"), F.coalesce("slots", F.lit(1))).cast("int")).drop("slots")
        right = right.join(slots, "mid", "left").withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
        on.append("slot")
    gap = F.datediff("later", "date")
    return left.join(right, on).where((gap >= 0) & (gap <= max_days))


def _prune(legs: DataFrame, min_mids: int, worth: float = WORTH_PRUNING) -> tuple[DataFrame, DataFrame]:
    """First and second legs that can belong to a route: (source, mid, ...) and (mid, dest, ...).

    A source needs min_mids middles that lead somewhere, a destination as many that
    are fed, and a middle a leg on either side.  What is dropped on one side can make
    the other side fall short, so this is repeated on the distinct links while a round drops
    at least the share ``worth`` of them; stopping early leaves legs that the join finds useless.
    """
    into = legs.select(F.col("payer").alias("source"), F.col("payee").alias("mid"), "date", "amount", "n")
    out = legs.select(F.col("payer").alias("mid"), F.col("payee").alias("dest"), "date", "amount", "n")
    first = write_table(into.select("source", "mid").distinct(), "first-links")
    second = first.select(F.col("source").alias("mid"), F.col("mid").alias("dest"))
    before, pruned = 2 * first.count(), False
    while before:
        sources = first.groupBy("source").agg(F.count(F.lit(1)).alias("mids")).where(F.col("mids") >= min_mids).select("source")
        dests = second.groupBy("dest").agg(F.count(F.lit(1)).alias("mids")).where(F.col("mids") >= min_mids).select("dest")
        kept_first = first.join(sources, "source", "left_semi").join(second.select("mid").distinct(), "mid", "left_semi")
        kept_second = second.join(dests, "dest", "left_semi").join(first.select("mid").distinct(), "mid", "left_semi")
        kept_first, kept_second = write_table(kept_first, "first-links"), write_table(kept_second, "second-links")
        left = kept_first.count() + kept_second.count()
        if before - left < worth * before:
            break
        first, second, before, pruned = kept_first, kept_second, left, True
    if not pruned:
        return into, out
    return into.join(first, ["source", "mid"], "left_semi"), out.join(second, ["mid", "dest"], "left_semi")


def layering_routes(
    transactions: DataFrame,
    max_days: int = 14,
    min_mids: int = 3,
    dedupe: bool = False,
    busy: int = BUSY,
) -> DataFrame:
    """(source, destination) accounts linked through at least min_mids others.

    The first leg is counted once for every matching second leg unless ``dedupe``.

    Legs that cannot belong to a route are dropped first.  A route needs min_mids
    intermediaries, so it passes at least one account outside any set of min_mids - 1
    accounts.  The busiest accounts, whose inflows times outflows would dominate the join, are
    therefore set aside if they have more than ``busy`` legs: routes are found through all other accounts and
    only then completed with the part that runs through the ones set aside.  Other
    accounts with more than ``busy`` legs are spread over slots.
    """
    # Read several times below, so written once.
    legs = write_table(_leg_table(transactions), "legs")
    into, out = _prune(legs, min_mids)

    load = into.select("mid", F.lit(1).alias("fed"), F.lit(0).alias("paid")).unionByName(out.select("mid", F.lit(0).alias("fed"), F.lit(1).alias("paid")))
    load = load.groupBy("mid").agg(F.sum("fed").alias("fed"), F.sum("paid").alias("paid"))
    # At most two legs in busy of all accounts.
    heavy = write_table(load.where((F.col("fed") + F.col("paid") > busy) & (F.col("fed") > 0) & (F.col("paid") > 0)), "busy-accounts")
    busiest, slots = None, None
    if not heavy.isEmpty():
        if min_mids > 1:
            order = (F.col("fed").cast("double") * F.col("paid").cast("double")).desc()
            busiest = F.broadcast(heavy.orderBy(order, "mid").limit(min_mids - 1).select("mid"))
        slots = broadcast_if_small(heavy.select("mid", F.ceil(F.col("fed") / busy).cast("int").alias("slots")))

    def totals(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(F.col("source") != F.col("dest"))
        if dedupe:
            return (
                pairs.groupBy("source", "dest", "mid", "date")
                .agg(F.max("amount").alias("routed"))
                .groupBy("source", "dest", "mid")
                .agg(F.sum("routed").alias("routed"))
            )
        return pairs.groupBy("source", "dest", "mid").agg(
            F.sum(F.col("amount") * F.col("later_n")).alias("routed")
        )

    def merge(per_mid: DataFrame) -> DataFrame:
        return per_mid.groupBy("source", "dest").agg(
            F.count(F.lit(1)).alias("intermediaries"), F.sum("routed").alias("routed")
        )

    if busiest is None:
        found = merge(totals(_follow(into, out, ["mid"], max_days, slots)))
    else:
        usual = merge(
            totals(_follow(into.join(busiest, "mid", "left_anti"), out.join(busiest, "mid", "left_anti"), ["mid"], max_days, slots))
        )
        # Each of the accounts set aside can add one intermediary at most, and a
        # route through fewer than one usual account cannot reach min_mids.
        usual = write_table(usual, "usual-routes")
        open_routes = usual.select("source", "dest")
        through_busy = _follow(
            into.join(busiest, "mid", "left_semi").join(open_routes, "source"),
            out.join(busiest, "mid", "left_semi"),
            ["mid", "dest"],
            max_days,
        )
        found = (
            usual.unionByName(merge(totals(through_busy)))
            .groupBy("source", "dest")
            .agg(F.sum("intermediaries").alias("intermediaries"), F.sum("routed").alias("routed"))
        )
    return found.where(F.col("intermediaries") >= min_mids)


def layering(
    transactions: DataFrame,
    accounts: DataFrame,
    entities: DataFrame,
    max_days: int = 14,
    min_mids: int = 3,
    n: int | None = 15,
    dedupe: bool = False,
) -> DataFrame:
    """Fan-out to intermediaries that all pay the same destination soon after."""
    routes = layering_routes(transactions, max_days, min_mids, dedupe)
    if n is not None:
        routes = routes.orderBy(
            largest_first("intermediaries"), largest_first("routed"), "source", "dest"
        ).limit(n)
    named = _with_owner(routes, accounts, entities, "source", "source_owner")
    named = _with_owner(named, accounts, entities, "dest", "dest_owner")
    return named.select(
        F.col("source").alias("source_account"),
        F.col("source_owner_name").alias("source_name"),
        F.col("source_owner_risk").alias("source_risk"),
        F.col("source_owner_segment").alias("source_segment"),
        F.col("dest").alias("dest_account"),
        F.col("dest_owner_name").alias("dest_name"),
        F.col("dest_owner_risk").alias("dest_risk"),
        F.col("dest_owner_segment").alias("dest_segment"),
        "intermediaries",
        rounded(F.col("routed"), 2).alias("total_routed"),
    )
