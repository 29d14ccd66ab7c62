import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from helpers import accounts, entities, rows, transactions

from tradeweave.operators import patterns


def test_layering_window(spark):
    first = [(1, m, "10", "2024-03-10") for m in (2, 3, 4, 5)]
    second = [(2, 9, "1", "2024-03-10"), (3, 9, "1", "2024-03-24"), (4, 9, "1", "2024-03-25"), (5, 9, "1", "2024-03-09")]
    found = patterns.layering_routes(transactions(spark, first + second), min_mids=2)
    assert rows(found, "source", "dest", "intermediaries", "routed") == [(1, 9, 2, 20)]


def test_inflow_counts_once_per_matching_outflow(spark):
    tx = transactions(spark, [(1, 2, "10", "2024-03-10"), (2, 9, "1", "2024-03-11"), (2, 9, "1", "2024-03-12")])
    assert patterns.layering_routes(tx, min_mids=1).first().routed == 20
    assert patterns.layering_routes(tx, min_mids=1, dedupe=True).first().routed == 10


@pytest.mark.parametrize("min_mids, busy", [(1, 20), (2, 10_000), (2, 40), (3, 15)])
@pytest.mark.parametrize("dedupe", [False, True])
def test_layering_with_busy_accounts(spark, min_mids, dedupe, busy):
    """Most payments run through two accounts; nothing may be lost or counted twice."""
    pick = random.Random(min_mids)
    start = date(2024, 1, 1)
    payments = []
    for _ in range(400):
        a, b = pick.randrange(12), pick.choice([0, 1, pick.randrange(12)])
        if pick.random() < 0.5:
            a, b = b, a
        payments.append((a, b, str(pick.randrange(1, 9)), (start + timedelta(days=pick.randrange(60))).isoformat()))
    mids, total, seen = defaultdict(set), defaultdict(int), defaultdict(set)
    for i, (s, m, amount, d1) in enumerate(payments):
        for m2, d, _, d2 in payments:
            gap = (date.fromisoformat(d2) - date.fromisoformat(d1)).days
            if m == m2 and len({s, m, d}) == 3 and 0 <= gap <= 14:
                mids[s, d].add(m)
                if not dedupe or i not in seen[s, d]:
                    total[s, d] += int(amount)
                seen[s, d].add(i)
    want = sorted((s, d, len(m), total[s, d]) for (s, d), m in mids.items() if len(m) >= min_mids)
    found = patterns.layering_routes(transactions(spark, payments), min_mids=min_mids, dedupe=dedupe, busy=busy)
    assert rows(found, "source", "dest", "intermediaries", "routed") == want


def test_fan_out_drops_payments_to_the_same_account_only(spark):
    tx = transactions(spark, [(1, d, "3", "2024-01-01") for d in (1, 2, 3, 4, 5, 5)])
    owners = accounts(spark, {1: 10, 2: 10, 3: 20, 4: 20, 5: 30})
    people = entities(spark, {10: {}, 20: {}, 30: {}})
    found = patterns.account_fan_out(tx, owners, people).first()
    assert (found.destinations, found.tx_count, found.total_sent, found.avg_per_destination) == (4, 5, 15.0, 3.75)
    assert patterns.account_fan_out(tx, owners, people, min_dests=5).count() == 0


def test_pruning_keeps_what_routes_need(spark):
    """A chain of accounts unravels from its end; the route through three middles stays whole."""
    route = [(1, m, "10", "2024-03-10") for m in (2, 3, 4)] + [(m, 9, "1", "2024-03-11") for m in (2, 3, 4)]
    chain = [(i, i + 1, "1", "2024-03-10") for i in range(20, 40)]
    legs = patterns._leg_table(transactions(spark, route + chain))
    first, second = patterns._prune(legs, 3)
    assert rows(first, "source", "mid") == [(1, 2), (1, 3), (1, 4)] and rows(second, "mid", "dest") == [(2, 9), (3, 9), (4, 9)]
    assert rows(patterns.layering_routes(transactions(spark, route + chain)), "source", "dest", "intermediaries") == [(1, 9, 3)]
    assert patterns.layering_routes(transactions(spark, chain)).count() == 0
    assert patterns.layering_routes(transactions(spark, chain).limit(0)).count() == 0
