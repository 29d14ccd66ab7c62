"""Payment, prospect, product, credit and search reports on hand-made rows."""

from decimal import Decimal

import pytest
from helpers import accounts, entities, rows, trades, transactions

from tradeweave.operators import credit, ecosystem, payments, products, prospects, search

BANKED = {i: {} for i in range(1, 6)}
UNBANKED = {i: {"status": "unbanked", "segment": None} for i in (11, 12)}


def test_missing_values_count_as_largest(spark):
    t = trades(spark, [(1, 2, 5), (1, 3, 7)]).selectExpr(
        "src", "dst", "if(dst = 3, null, amount) as amount", "tx_count", "avg_interval"
    )
    best = payments.largest_relationship(t, entities(spark, BANKED)).first()
    assert best.dst == 3


def test_prospects_count_banked_payers_only(spark):
    t = trades(spark, [(1, 11, 10, 2), (2, 11, 20, 1), (12, 11, 500, 9), (3, 12, 5, 1), (11, 1, 9, 1)])
    e = entities(spark, BANKED | UNBANKED)
    assert rows(prospects.top_unbanked(t, e), "entity_id", "payers", "tx_count", "total_inbound") == [
        (11, 2, 3, 30.0), (12, 1, 1, 5.0),
    ]
    value = prospects.value_to_unbanked(t, e).first()
    assert (value.relationships, value.total_value) == (3, 35.0)
    assert rows(prospects.multi_payer_targets(t, e, min_payers=2), "entity_id", "payer_name") == [(11, "e1"), (11, "e2")]
    assert rows(prospects.multi_payer_edges(t, e, min_payers=2), "src", "dst") == [(1, 11), (2, 11)]


def test_payers_of_one_name_are_one_name(spark):
    t = trades(spark, [(1, 11), (2, 11), (3, 11)])
    e = entities(spark, BANKED | {1: {"name": "same"}, 2: {"name": "same"}} | UNBANKED)
    assert prospects.multi_payer_targets(t, e, min_payers=3).count() == 3
    assert prospects.multi_payer_targets(t, e, min_payers=3, count_by="name").count() == 0
    sample = prospects.multi_payer_sample(t, e, min_payers=2, sample=1).first()
    assert (sample.payers, sample.sample_payers) == (2, "e3")


def test_no_edges_to_unbanked_gives_zero(spark):
    value = prospects.value_to_unbanked(trades(spark, [(1, 2)]), entities(spark, BANKED)).first()
    assert (value.relationships, value.total_value) == (0, 0.0)


def test_walks_reuse_no_edge_but_may_return(spark):
    t = trades(spark, [(1, 2), (2, 1), (2, 3)])
    walks = {tuple(r.nodes): r.hops for r in ecosystem.ecosystem_paths(t, 1).collect()}
    assert walks == {(1, 2): 1, (1, 2, 1): 2, (1, 2, 3): 2}
    assert ecosystem.ecosystem_paths(t, 1).count() == 2 + 2 + 2


def test_shared_counterparties_are_a_bag(spark):
    t = trades(spark, [(1, 3), (3, 1), (2, 3)])
    e = entities(spark, BANKED)
    assert ecosystem.shared_counterparties(t, e, 1, 2).count() == 2
    assert ecosystem.shared_counterparties(t, e, 1, 2, distinct=True).count() == 1


def test_edge_inside_a_sector_shows_twice(spark):
    sectors = spark.createDataFrame([(1, "i1", "A"), (2, "i2", "B")], "sic_code int, name string, sector string")
    e = entities(spark, {1: {}, 2: {}, 3: {"sic_code": 2}})
    found = ecosystem.sector_network(trades(spark, [(1, 2), (1, 3)]), e, sectors, "A")
    assert rows(found, "id", "nbr") == [(1, 2), (1, 3), (2, 1)]


@pytest.mark.parametrize("payers, channels, grade", [
    (10, 3, "LOW RISK"), (10, 2, "MEDIUM RISK"), (5, 2, "MEDIUM RISK"), (4, 4, "HIGHER RISK"), (12, 1, "HIGHER RISK"),
])
def test_collateral_grade(spark, payers, channels, grade):
    t = trades(spark, [(100 + i, 1, 10, 2) for i in range(payers)])
    e = entities(spark, {1: {}} | {100 + i: {} for i in range(payers)})
    names = ["EFT", "NAV", "SOF", "SWIFT"]
    # Channels of self-payments count as well.
    tx = transactions(spark, [(7, 7, "1", "2024-01-01", names[i]) for i in range(channels)])
    found = credit.collateral_grade(t, tx, accounts(spark, {7: 1}), e).first()
    assert (found.payers, found.channels, found.grade, found.avg_payment) == (payers, channels, grade, 5.0)


def test_concentration_ties_go_to_the_smallest_id(spark):
    found = credit.concentration(trades(spark, [(2, 1, 30), (3, 1, 30), (4, 1, 40 - 10), (5, 1, 10)]), entities(spark, BANKED)).first()
    assert (found.payer_id, found.concentration_pct, found.total_inflow) == (2, 30.0, 100.0)


@pytest.mark.parametrize("spread, grade", [(9.99, "HIGHLY STABLE"), (10.0, "STABLE"), (30.0, "VARIABLE")])
def test_stability_grade(spark, spread, grade):
    # Three payers around a mean of 100 whose sample deviation is exactly the spread.
    edges = [(2, 1, 10, 3, 100.0 - spread), (3, 1, 10, 3, 100.0), (4, 1, 10, 3, 100.0 + spread), (5, 1, 500, 1, None)]
    found = credit.stability(trades(spark, edges), entities(spark, BANKED)).first()
    assert (found.payers, found.grade, found.avg_interval_days, found.total_inflow) == (3, grade, 100.0, 30.0)


PRODUCTS = [("p1", "Loan", "lend", 1.0), ("p2", "Card", "transact", 2.0), ("p3", "Cover", "insure", 3.0)]


def product_tables(spark, held):
    catalogue = spark.createDataFrame(PRODUCTS, "product_id string, name string, pillar string, monthly_fee double")
    holdings = spark.createDataFrame([(e, p, None) for e, p in held], "entity_id long, product_id string, since date")
    return catalogue, holdings


def test_recommendations_ignore_own_products_and_other_industries(spark):
    e = entities(spark, {1: {}, 2: {}, 3: {}, 4: {"sic_code": 2}, 11: {"status": "unbanked"}})
    catalogue, held = product_tables(spark, [(1, "p1"), (2, "p1"), (2, "p2"), (3, "p2"), (4, "p3"), (11, "p3")])
    found = products.peer_recommendations_pct(e, held, catalogue, 1)
    assert rows(found, "product_id", "peers_holding", "peer_adoption_pct") == [("p2", 2, 50.0)]
    batch = products.peer_recommendations(e, held, catalogue)
    assert rows(batch, "entity_id", "product_id", "peers_holding") == [(1, "p2", 2), (3, "p1", 2)]


def test_similar_peers_without_products(spark):
    e = entities(spark, {1: {}, 2: {}, 3: {}})
    catalogue, held = product_tables(spark, [(1, "p1"), (2, "p1"), (2, "p2")])
    similar = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (3, 1, 0.4)], "src long, dst long, similarity double")
    found = products.similar_peer_products(similar, e, held, catalogue, 1)
    assert rows(found, "entity_id", "target_products", "peer_products", "recommended") == [
        (2, "Loan", "Card; Loan", "Card"), (3, "Loan", "", ""),
    ]


def test_profile_of_an_entity_with_nothing(spark):
    e = entities(spark, {1: {"sic_code": 9}})
    catalogue, held = product_tables(spark, [(2, "p1")])
    sectors = spark.createDataFrame([(1, "i1", "A")], "sic_code int, name string, sector string")
    row = credit.customer_profile(e, sectors, accounts(spark, {5: 2}), held, catalogue, trades(spark, [(2, 3)]), 1).first()
    assert (row.industry, row.accounts, row.products, row.product_names, row.trading_partners) == (None, 0, 0, "", 0)


def test_search_by_text_or_id(spark):
    e = entities(spark, {1: {"name": "North Mill"}, 2: {"name": "South Mill"}, 3: {}})
    assert rows(search.find_entities(e, "Mill"), "entity_id") == [(1,), (2,)]
    assert rows(search.find_entities(e, "3"), "entity_id") == [(3,)]
    found = search.partners_of(trades(spark, [(1, 3), (3, 1)]), e, "North")
    assert rows(found, "partner_id", "outgoing") == [(3, False), (3, True)]


def test_counts_and_samples(spark):
    t = trades(spark, [(1, 2), (2, 1)])
    counts = search.graph_summary({"Customer": entities(spark, BANKED)}, {"TRADES_WITH": t})
    assert rows(counts, "kind", "label", "count") == [
        ("node", "(all)", 5), ("node", "Customer", 5), ("relationship", "(all)", 2), ("relationship", "TRADES_WITH", 2),
    ]
    one = search.sample_rows(t, ["src"], 1, "TRADES_WITH").first()
    assert (one.from_label, one.rel_type, one.to_label, one.src, one.amount) == (
        "Customer", "TRADES_WITH", "Customer", 1, Decimal("100.00"),
    )
