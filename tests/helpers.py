"""Small hand-made graphs."""

from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

TRADES = "src long, dst long, amount decimal(28,2), tx_count long, avg_interval double"
ENTITIES = (
    "entity_id long, name string, registration_number string, region string, segment string, "
    "status string, turnover double, risk_score double, sic_code int"
)
ACCOUNTS = "account_id long, entity_id long, account_type string, open_date date, balance double"
TRANSACTIONS = (
    "sender_account_id long, receiver_account_id long, amount decimal(18,2), currency string, date date, "
    "channel string, reference string"
)


def trades(spark, edges):
    """edges: (src, dst[, amount[, tx_count[, avg_interval]]])."""
    rows = []
    for edge in edges:
        src, dst, amount, n, gap = (*edge, *(100, 1, None)[len(edge) - 2 :])
        rows.append((src, dst, Decimal(amount), n, gap))
    return spark.createDataFrame(rows, TRADES)


def entities(spark, rows):
    """rows: id -> dict of attributes; banked by default."""
    out = []
    for key, given in rows.items():
        one = dict(name=f"e{key}", registration_number=None, region="R", segment="S", status="banked",
                   turnover=None, risk_score=None, sic_code=1) | given
        out.append((key, one["name"], one["registration_number"], one["region"], one["segment"], one["status"],
                    one["turnover"], one["risk_score"], one["sic_code"]))
    return spark.createDataFrame(out, ENTITIES)


def accounts(spark, owners):
    """owners: account id -> entity id."""
    return spark.createDataFrame([(a, e, "cheque", None, 0.0) for a, e in owners.items()], ACCOUNTS)


def transactions(spark, rows):
    """rows: (sender account, receiver account, amount, iso date[, channel])."""
    out = []
    for row in rows:
        s, d, amount, day, channel = (*row, *("EFT",)[len(row) - 4 :])
        out.append((s, d, Decimal(amount), "ZAR", date.fromisoformat(day), channel, "x"))
    return spark.createDataFrame(out, TRANSACTIONS)


def random_edges(n, m, seed, hubs=()):
    """m distinct ordered pairs over n nodes, plus an edge from each hub to most nodes."""
    pick = random.Random(seed)
    found = set()
    while len(found) < m:
        a, b = pick.randrange(n), pick.randrange(n)
        if a != b:
            found.add((a, b))
    for hub in hubs:
        for other in range(n):
            if other != hub and pick.random() < 0.7:
                found.add((hub, other) if pick.random() < 0.5 else (other, hub))
    return sorted(found)


def partner_sets(edges):
    sets = {}
    for a, b, *_ in edges:
        sets.setdefault(a, set()).add(b)
        sets.setdefault(b, set()).add(a)
    return sets


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
