"""Every operator as a named query over one data folder.

Parameters differ from the defaults only where the defaults, which fit a small
bank's data, would return nothing here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeweave.operators import (
    credit,
    ecosystem,
    edges,
    maintenance,
    patterns,
    payments,
    products,
    prospects,
    search,
    stored,
)
from tradeweave.operators.network import paths
from tradeweave.operators.network import reports as network_reports
from tradeweave.operators.network.betweenness import betweenness
from tradeweave.operators.network.similarity import node_similarity
from tradeweave.operators.resolution import blocking, scoring, signals
from tradeweave.operators.resolution import reports as match_reports
from tradeweave.plans import exports
from tradeweave.plans.graph import PaymentGraph
from tradeweave.session import TABLE_CODEC, new_folder, write_table
from tradeweave.sources import files
from tradeweave.streaming.trades import compact, current_trades, stream_trades

TARGET = 0
PAIR = (0, 2)
PATH_ENDS = (0, 200)
SIMILAR_TARGET = 66
SECTOR = "Sector 3"
CUT_DATE = "1998-01-01"

Query = Callable[[PaymentGraph], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _double(*names: str) -> dict:
    return {n: F.col(n).cast("double") for n in names}


# --- Sources and upkeep -------------------------------------------------------


@query
def a1_read_industries(g):
    rows = files.read_industries(g.spark, exports.industries_csv(g.industries))
    return rows.withColumn("sic_code", F.col("sic_code").cast("int"))


@query
def a2_read_products(g):
    return files.read_products(g.spark, exports.products_csv(g.products))


def _read_entities(g):
    industries = files.read_industries(g.spark, exports.industries_csv(g.industries))
    return files.read_entities(
        g.spark, exports.entities_csv(g.entities, "banked"), exports.entities_csv(g.entities, "unbanked"), industries
    ).accepted


def _read_accounts(g):
    return files.read_accounts(g.spark, exports.accounts_csv(g.accounts), _read_entities(g)).accepted


@query
def a3_read_entities(g):
    return _read_entities(g)


@query
def a4_read_accounts(g):
    return _read_accounts(g)


@query
def a5_read_transactions(g):
    read = files.read_transactions(g.spark, exports.transactions_csv(g.transactions), _read_accounts(g))
    return read.accepted.withColumns(_double("amount"))


@query
def a5_transaction_rejects(g):
    """Payments that lack an account once the accounts of unbanked entities are left out."""
    known = g.accounts.where(F.col("account_type") != "external").withColumn("account_id", F.col("account_id").cast("string"))
    rejected = files.read_transactions(g.spark, exports.transactions_csv(g.transactions), known).rejected
    return rejected.groupBy("missing_parent", "channel").agg(F.count(F.lit(1)).alias("rejected"))


@query
def a6_read_holdings(g):
    catalogue = files.read_products(g.spark, exports.products_csv(g.products))
    return files.read_holdings(g.spark, exports.holdings_csv(g.holdings), _read_entities(g), catalogue).accepted


@query
def a7_check_unique(g):
    return maintenance.check_unique(g.entities, "name")


@query
def a7_check_unique_ids(g):
    """How many values of each table's id occur more than once."""
    tables = {"entity_id": g.entities, "account_id": g.accounts, "transaction_id": g.transactions, "product_id": g.products, "sic_code": g.industries}
    counted = [
        maintenance.check_unique(table, key).agg(F.lit(key).alias("key"), F.count(F.lit(1)).alias("repeated"))
        for key, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query
def a8_upsert(g):
    current = g.entities.where(F.col("status") == "banked")
    updates = g.entities.select(
        "entity_id", F.upper("name").alias("name"), (F.coalesce("turnover", F.lit(0.0)) + 1.0).alias("turnover")
    )
    return maintenance.upsert(current, updates, "entity_id", ["name", "turnover"]).select(
        "entity_id", "name", "region", "segment", "status", "turnover"
    )


@query
def a8_upsert_stored(g):
    """The same change on a stored table in buckets, then a deletion and an insertion that put rows back."""
    table = stored.StoredTable(g.spark, new_folder(g.spark, "stored"), "entity_id", buckets=8)
    columns = ["entity_id", "name", "region", "segment", "status", "turnover"]
    table.create(g.entities.where(F.col("status") == "banked").select(*columns))
    updates = g.entities.select(
        "entity_id", F.upper("name").alias("name"), (F.coalesce("turnover", F.lit(0.0)) + 1.0).alias("turnover")
    )
    table.upsert(updates, ["name", "turnover"])
    some = write_table(table.read().where(F.col("entity_id") % 3 == 0), "put-aside")
    table.delete(some.select("entity_id"))
    table.insert_if_absent(some)
    return table.read().select(*columns)


@query
def a9_accumulate_trades(g):
    cut = F.lit(CUT_DATE).cast("date")
    before = edges.trade_totals(g.transactions.where(F.col("date") < cut), g.accounts)
    after = edges.trade_totals(g.transactions.where(F.col("date") >= cut), g.accounts)
    return maintenance.accumulate_trades(before, after).withColumns(_double("amount"))


@query
def a10_insert_if_absent(g):
    current = g.trades.where(F.col("tx_count") > 1)
    rows = g.trades.withColumn("amount", F.lit(0).cast("decimal(28,2)")).withColumn("avg_interval", F.lit(12.0))
    return maintenance.insert_if_absent(current, rows, ["src", "dst"]).withColumns(_double("amount"))


@query
def a11_link_entities(g):
    linked, _ = maintenance.link_entities(g.entities, g.holdings, 24)
    return linked.select("entity_id", "name", "sic_code")


@query
def a11_linked_count(g):
    return maintenance.link_entities(g.entities, g.holdings, 24)[1]


@query
def a12_delete_cascade(g):
    tables = {"trades": (g.trades, ["src", "dst"]), "holdings": (g.holdings, ["entity_id"])}
    entities, kept = maintenance.delete_cascade(g.entities, tables, ["1", "22"])
    ends = kept["trades"].select(F.lit("trades").alias("kind"), F.col("src").alias("a"), F.col("dst").cast("string").alias("b"))
    held = kept["holdings"].select(F.lit("holdings").alias("kind"), F.col("entity_id").alias("a"), F.col("product_id").alias("b"))
    left = entities.select(F.lit("entities").alias("kind"), F.col("entity_id").alias("a"), F.col("name").alias("b"))
    return ends.unionByName(held).unionByName(left)


@query
def a13_rebuild_matches(g):
    path = new_folder(g.spark, "rebuilt")
    stored.replace_folder(g.matches.limit(0), path)
    stored.replace_folder(g.matches, path)
    return g.spark.read.schema(g.matches.schema).parquet(path)


@query
def a14_write_back(g):
    written = maintenance.write_back(g.entities, g.page_rank.scores)
    return written.select("entity_id", "name", F.round(F.col("page_rank").cast("decimal(28,8)"), 6).cast("double").alias("page_rank"))


@query
def a15_inline_rows(g):
    tiers = files.inline_rows(
        g.spark, [("HOUSEHOLD", "retail"), ("AUTOMOBILE", "trade"), ("MACHINERY", "trade")], "segment string, tier string"
    )
    return g.entities.join(tiers, "segment").groupBy("tier").agg(F.count(F.lit(1)).alias("entities"))


@query
def a16_read_ground_truth(g):
    return files.read_ground_truth(g.spark, exports.truth_csv(g.truth, g.entities))


# --- Edges --------------------------------------------------------------------


@query
def d1_trades_with(g):
    return edges.trades_with(g.transactions, g.accounts).select("src", "dst", F.col("amount").cast("double").alias("amount"), "tx_count")


@query
def d2_avg_interval(g):
    return edges.avg_interval(g.transactions, g.accounts)


@query
def d2_avg_interval_component(g):
    return edges.avg_interval(g.transactions, g.accounts, mode="component")


@query
def d2_avg_interval_truncated(g):
    return edges.avg_interval(g.transactions, g.accounts, truncate=True)


@query
def d3_neighbours(g):
    return edges.neighbours(g.trades).withColumns(_double("amount"))


# --- Payment behaviour --------------------------------------------------------


@query
def p1_top_pairs(g):
    return payments.top_pairs(g.trades, g.entities)


@query
def p2_channel_breakdown(g):
    return payments.channel_breakdown(g.transactions, g.accounts, TARGET)


@query
def p3_monthly_trend(g):
    return payments.monthly_trend(g.transactions, g.accounts, TARGET)


@query
def p4_top_payees(g):
    return payments.top_payees(g.trades, g.entities, TARGET)


@query
def p5_top_payers(g):
    return payments.top_payers(g.trades, g.entities, TARGET)


@query
def p6_largest_relationship(g):
    return payments.largest_relationship(g.trades, g.entities)


@query
def p7_active_pairs(g):
    return payments.active_pairs(g.trades, g.entities, min_tx=5)


@query
def p8_high_value_edges(g):
    return payments.high_value_edges(g.trades, g.entities, min_amount=300_000)


# --- Unbanked prospects -------------------------------------------------------


@query
def u1_top_unbanked(g):
    return prospects.top_unbanked(g.trades, g.entities)


@query
def u2_multi_payer_targets(g):
    return prospects.multi_payer_targets(g.trades, g.entities, min_payers=60)


@query
def u2_multi_payer_targets_by_name(g):
    return prospects.multi_payer_targets(g.trades, g.entities, min_payers=50, count_by="name")


@query
def u3_multi_payer_sample(g):
    return prospects.multi_payer_sample(g.trades, g.entities)


@query
def u4_unbanked_by_industry(g):
    return prospects.unbanked_by_industry(g.trades, g.entities, g.industries, min_total=10_000_000)


@query
def u5_top_target_network(g):
    return prospects.top_target_network(g.trades, g.entities)


@query
def u6_top_targets_with_payers(g):
    return prospects.top_targets_with_payers(g.trades, g.entities)


@query
def u7_multi_payer_edges(g):
    return prospects.multi_payer_edges(g.trades, g.entities, min_payers=60)


@query
def u8_value_to_unbanked(g):
    return prospects.value_to_unbanked(g.trades, g.entities)


# --- Ecosystem ----------------------------------------------------------------


def _walk_text(rows: DataFrame) -> DataFrame:
    return rows.select(
        "hops",
        F.array_join(F.transform("nodes", lambda n: n.cast("string")), "-").alias("nodes"),
        F.array_join(
            F.transform("edges", lambda e: F.concat_ws(">", e["src"].cast("string"), e["dst"].cast("string"))), ", "
        ).alias("edges"),
    )


@query
def e1_ecosystem_paths(g):
    return _walk_text(ecosystem.ecosystem_paths(g.trades, TARGET))


@query
def e1_ecosystem_paths_view(g):
    return _walk_text(ecosystem.ecosystem_paths(g.trades, TARGET, n=200))


@query
def e2_ecosystem_size(g):
    return ecosystem.ecosystem_size(g.trades, g.entities, partners=g.partner_pairs)


@query
def e2_ecosystem_size_hubs(g):
    """Most entities count as hubs, so most is counted through their bitmaps."""
    return ecosystem.ecosystem_size(g.trades, g.entities, hub_degree=30, partners=g.partner_pairs)


@query
def e3_shared_counterparties(g):
    return ecosystem.shared_counterparties(g.trades, g.entities, *PAIR)


@query
def e4_sector_network(g):
    return ecosystem.sector_network(g.trades, g.entities, g.industries, SECTOR)


@query
def e5_partner_context(g):
    return ecosystem.partner_context(g.trades, g.entities, g.industries, TARGET)


@query
def e6_shortest_path(g):
    return paths.shortest_path(g.trades, g.entities, *PATH_ENDS)


@query
def e6_shortest_path_far(g):
    return paths.shortest_path(g.trades, g.entities, 0, 8)


# --- Entity resolution --------------------------------------------------------


@query
def r1_block_candidates_preview(g):
    return blocking.block_candidates_preview(g.entities)


@query
def r2_block_candidates(g):
    return blocking.block_candidates(g.entities)


@query
def r3_name_similarity(g):
    rows = signals.name_similarity(g.candidates.select("banked_id", "unbanked_id"), g.entities)
    return rows.withColumn("name_sim", F.round(F.col("name_sim").cast("decimal(28,8)"), 6).cast("double"))


@query
def r4_industry_match(g):
    return signals.industry_match(g.candidates.select("banked_id", "unbanked_id"), g.entities)


@query
def r5_region_match(g):
    return signals.region_match(g.candidates.select("banked_id", "unbanked_id"), g.entities)


@query
def r6_trading_overlap(g):
    rows = signals.trading_overlap(g.candidates.select("banked_id", "unbanked_id"), g.trades, g.partner_pairs)
    return rows.withColumn("trading_sim", F.round(F.col("trading_sim").cast("decimal(28,8)"), 6).cast("double"))


@query
def r7_match_confidence(g):
    return scoring.match_entities(g.entities, g.trades, partners=g.partner_pairs)


@query
def r8_score_named_pair(g):
    return scoring.score_named_pair(g.entities, g.trades, 0, 1)


@query
def r8_score_named_pair_unfiltered(g):
    return scoring.score_named_pair(g.entities, g.trades, 2, 1, min_conf=None)


@query
def r9_match_summary(g):
    return match_reports.match_summary(g.matches)


@query
def r10_ranked_matches(g):
    return match_reports.ranked_matches(g.matches, g.entities)


@query
def r10_ranked_matches_top(g):
    return match_reports.ranked_matches(g.matches, g.entities, n=20)


@query
def r11_high_confidence(g):
    return match_reports.high_confidence(g.matches, g.entities)


@query
def r11_high_confidence_of_one(g):
    return match_reports.high_confidence(g.matches, g.entities, banked_id=96)


@query
def r12_review_queue(g):
    return match_reports.review_queue(g.matches, g.entities)


@query
def r13_name_driven(g):
    return match_reports.name_driven(g.matches, g.entities)


@query
def r14_structure_driven(g):
    return match_reports.structure_driven(g.matches, g.entities, min_trading=0.08)


@query
def r15_all_signals_agree(g):
    return match_reports.all_signals_agree(g.matches, g.entities)


@query
def r16_hidden_partners(g):
    return match_reports.hidden_partners(g.matches, g.trades, g.entities, partners=g.partner_pairs)


@query
def r16_hidden_partners_by_name(g):
    return match_reports.hidden_partners(g.matches, g.trades, g.entities, count_by="name", partners=g.partner_pairs)


@query
def r17_revenue_at_risk(g):
    return match_reports.revenue_at_risk(g.matches, g.trades, g.entities)


@query
def r18_match_network(g):
    return match_reports.match_network(g.matches, g.trades)


@query
def r18_match_network_outer(g):
    return match_reports.match_network(g.matches, g.trades, min_conf=0.65, k=10, outer=True)


@query
def r19_edges_of(g):
    return match_reports.edges_of(g.trades, [0, 1])


@query
def r20_evaluate_matches(g):
    return match_reports.evaluate_matches(g.matches, g.truth)


# --- Product fit and credit ---------------------------------------------------


@query
def x1_peer_recommendations_pct(g):
    return products.peer_recommendations_pct(g.entities, g.holdings, g.products, TARGET)


@query
def x2_peer_recommendations(g):
    return products.peer_recommendations(g.entities, g.holdings, g.products, TARGET)


@query
def x2_peer_recommendations_all(g):
    return products.peer_recommendations(g.entities, g.holdings, g.products)


@query
def x3_segment_penetration(g):
    return products.segment_penetration(g.entities, g.holdings, g.products)


@query
def x4_current_products(g):
    return products.current_products(g.holdings, g.products, TARGET)


@query
def x5_compare_with_peers(g):
    return products.compare_with_peers(g.entities, g.holdings, g.products, TARGET, k=4)


@query
def x6_similar_peer_products(g):
    return products.similar_peer_products(g.similar, g.entities, g.holdings, g.products, SIMILAR_TARGET)


@query
def c1_collateral_grade(g):
    return credit.collateral_grade(g.trades, g.transactions, g.accounts, g.entities)


@query
def c1_collateral_grade_all(g):
    return credit.collateral_grade(
        g.trades, g.transactions, g.accounts, g.entities, n=None, low=(18, 3), medium=(14, 2)
    )


@query
def c2_concentration(g):
    return credit.concentration(g.trades, g.entities)


@query
def c3_stability(g):
    return credit.stability(g.trades, g.entities)


@query
def c3_stability_all(g):
    return credit.stability(g.trades, g.entities, n=None, highly_stable_below=150.0, stable_below=300.0)


@query
def c4_customer_profile(g):
    return credit.customer_profile(g.entities, g.industries, g.accounts, g.holdings, g.products, g.trades, TARGET)


@query
def c5_diversified_example(g):
    return credit.diversified_example(g.trades, g.entities)


@query
def c6_concentrated_example(g):
    return credit.concentrated_example(g.trades, g.entities, max_payers=9, min_total=100_000)


# --- Graph algorithms ---------------------------------------------------------


@query
def g0_project_graph(g):
    return g.projection.edges.withColumns(_double("amount"))


@query
def g1_pagerank(g):
    return g.page_rank.scores.select(
        "entity_id", F.round(F.col("page_rank").cast("decimal(28,8)"), 6).cast("double").alias("page_rank")
    )


@query
def g2_louvain(g):
    return g.communities.members


@query
def g3_betweenness(g):
    return g.betweenness.select(
        "entity_id", F.round(F.col("betweenness").cast("decimal(28,8)"), 2).cast("double").alias("betweenness")
    )


@query
def g3_betweenness_pivots(g):
    """Estimated from a few sources, in batches."""
    found = betweenness(g.projection.nodes, g.partner_pairs, sources=48, batches=3)
    return found.select("entity_id", F.round(F.col("betweenness").cast("decimal(28,8)"), 2).cast("double").alias("betweenness"))


def _similarity(found):
    return found.withColumn("similarity", F.round(F.col("similarity").cast("decimal(28,8)"), 6).cast("double"))


@query
def g4_node_similarity(g):
    return _similarity(g.similar)


@query
def g4_node_similarity_hubs(g):
    """Most entities count as hubs, so most pairs are found through classes."""
    return _similarity(node_similarity(g.partner_pairs, hub_degree=30))


@query
def g5_communities_bridged(g):
    return network_reports.communities_bridged(g.trades, g.entities, g.scores)


@query
def g6_top_pagerank(g):
    return network_reports.top_pagerank(g.entities, g.page_rank.scores)


@query
def g6_top_unbanked_pagerank(g):
    return network_reports.top_pagerank(g.entities, g.page_rank.scores, status="unbanked", n=10)


@query
def g7_community_summary(g):
    return network_reports.community_summary(g.entities, g.communities.members)


@query
def g8_dominant_sector(g):
    return network_reports.dominant_sector(g.entities, g.industries, g.communities.members)


@query
def g9_top_brokers(g):
    return network_reports.top_brokers(g.entities, g.scores)


@query
def g10_top_similar_pairs(g):
    return network_reports.top_similar_pairs(g.similar, g.entities)


@query
def g11_pagerank_distribution(g):
    return network_reports.score_distribution(g.page_rank.scores, "page_rank")


@query
def g11_similarity_distribution(g):
    return network_reports.score_distribution(g.similar, "similarity")


@query
def g11_betweenness_distribution(g):
    return network_reports.score_distribution(g.betweenness, "betweenness", 2)


@query
def g11_modularities(g):
    """Modularity after each level of the communities."""
    return network_reports.level_qualities(g.spark, g.communities.modularities)


# --- Laundering patterns ------------------------------------------------------


@query
def m1_account_fan_out(g):
    return patterns.account_fan_out(g.transactions, g.accounts, g.entities)


@query
def m2_layering(g):
    return patterns.layering(g.transactions, g.accounts, g.entities, min_mids=2, n=None)


@query
def m2_layering_three(g):
    return patterns.layering(g.transactions, g.accounts, g.entities, n=None)


@query
def m2_layering_dedupe(g):
    return patterns.layering(g.transactions, g.accounts, g.entities, min_mids=2, dedupe=True)


# --- Search and summaries -----------------------------------------------------


@query
def s1_find_entities(g):
    return search.find_entities(g.entities, "bolt Brand 7")


@query
def s2_partners_of(g):
    return search.partners_of(g.trades, g.entities, "red bolt Brand 6 ")


@query
def s3_products_for(g):
    return search.products_for(g.entities, g.holdings, g.products, "bolt Brand 6")


@query
def s4_deep_dive_rows(g):
    return search.deep_dive_rows(g.entities, g.industries, g.holdings, g.products, g.trades, "bolt Brand 6")


@query
def s5_filter_entities(g):
    return search.filter_entities(g.entities, status="banked", segment="MACHINERY", region="ASIA")


@query
def s6_graph_counts(g):
    return search.graph_counts(g.node_tables, g.edge_tables)


@query
def s7_graph_summary(g):
    return search.graph_summary(g.node_tables, g.edge_tables)


@query
def s8_sample_nodes(g):
    return search.sample_rows(g.entities, ["entity_id"], 5)


@query
def s8_sample_edges(g):
    return search.sample_rows(g.trades, ["src", "dst"], 10, "TRADES_WITH").withColumns(_double("amount"))


# --- Streaming ----------------------------------------------------------------

#: Payments a file that arrives may hold, so that no task writes or reads more of them as the table grows.
ROWS_PER_ARRIVAL = 500_000


def write_arriving(payments: DataFrame, folder: str, deliveries: int, rows_per_file: int = ROWS_PER_ARRIVAL) -> int:
    """Add payments to a folder in order of date, as ``deliveries`` times as many files as returned.

    A busy day is split by transaction id.
    """
    share = max(-(-payments.count() // (deliveries * rows_per_file)), 1)
    dealt = payments.repartitionByRange(deliveries * share, "date", "transaction_id")
    dealt.write.mode("append").parquet(folder, compression=TABLE_CODEC)
    return share


@query
def st1_stream_trades(g):
    """Payments arrive as the files of the transactions table, a few per batch."""
    source = new_folder(g.spark, "arriving")
    share = write_arriving(g.transactions, source, 6)
    arriving = (
        g.spark.readStream.schema(g.transactions.schema).option("maxFilesPerTrigger", 2 * share).parquet(source)
    )
    totals = new_folder(g.spark, "totals")
    stream_trades(arriving, g.accounts, totals, new_folder(g.spark, "progress")).awaitTermination()
    return current_trades(g.spark, totals).withColumns(_double("amount"))


@query
def st1_stream_compacted(g):
    """Half of the payments arrive, the batches are folded into a base, and the stream goes on."""
    source, totals, progress = (new_folder(g.spark, name) for name in ("arriving", "totals", "progress"))
    cut = F.lit(CUT_DATE).cast("date")
    for half in (F.col("date") < cut, F.col("date") >= cut):
        share = write_arriving(g.transactions.where(half), source, 3)
        arriving = (
            g.spark.readStream.schema(g.transactions.schema).option("maxFilesPerTrigger", 2 * share).parquet(source)
        )
        stream_trades(arriving, g.accounts, totals, progress).awaitTermination()
        compact(g.spark, totals)
    return current_trades(g.spark, totals).withColumns(_double("amount"))
