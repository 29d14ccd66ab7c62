from decimal import Decimal

import pytest
from helpers import accounts, rows, trades, transactions

from tradeweave.operators import edges

OWNERS = {1: 10, 2: 10, 3: 20, 4: 30}


def test_trades_sum_over_accounts_and_drop_self_payments(spark):
    tx = transactions(spark, [
        (1, 3, "10.10", "2024-01-01"), (2, 3, "0.20", "2024-01-11"), (3, 1, "5", "2024-02-01"), (1, 2, "99", "2024-01-01"),
    ])
    found = edges.trades_with(tx, accounts(spark, OWNERS))
    assert rows(found, "src", "dst", "amount", "tx_count") == [
        (10, 20, Decimal("10.30"), 2), (20, 10, Decimal("5.00"), 1),
    ]
    assert {r.src: r.avg_interval for r in found.collect()} == {10: 10.0, 20: None}


@pytest.mark.parametrize("mode, truncate, expected", [
    ("elapsed", False, 64.0), ("component", False, 4.0), ("elapsed", True, 64.0),
])
def test_interval_modes(spark, mode, truncate, expected):
    tx = transactions(spark, [(1, 3, "1", "2024-01-01"), (1, 3, "1", "2024-03-05")])
    found = edges.avg_interval(tx, accounts(spark, OWNERS), mode, truncate).collect()
    assert [r.avg_interval for r in found] == [expected]


def test_component_interval_over_month_ends_and_repeated_days(spark):
    days = ["2024-01-31", "2024-02-29", "2024-02-29", "2024-03-30"]
    tx = transactions(spark, [(1, 3, "1", d) for d in days])
    # 29 days, 0 days, and one month with 1 day.
    assert edges.avg_interval(tx, accounts(spark, OWNERS), "component").first().avg_interval == 30 / 3
    assert edges.avg_interval(tx, accounts(spark, OWNERS), "component", True).first().avg_interval == 10.0


def test_truncated_interval(spark):
    tx = transactions(spark, [(1, 3, "1", d) for d in ("2024-01-01", "2024-01-02", "2024-01-04")])
    assert edges.avg_interval(tx, accounts(spark, OWNERS)).first().avg_interval == 1.5
    assert edges.avg_interval(tx, accounts(spark, OWNERS), truncate=True).first().avg_interval == 1.0


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        edges.avg_interval(transactions(spark, [(1, 3, "1", "2024-01-01")]), accounts(spark, OWNERS), "months")


def test_neighbours_keep_reciprocal_edges(spark):
    t = trades(spark, [(1, 2), (2, 1), (2, 3)])
    assert rows(edges.neighbours(t), "id", "nbr", "outgoing") == [
        (1, 2, False), (1, 2, True), (2, 1, False), (2, 1, True), (2, 3, True), (3, 2, False),
    ]
    assert rows(edges.neighbour_pairs(t), "id", "nbr") == [(1, 2), (2, 1), (2, 3), (3, 2)]
