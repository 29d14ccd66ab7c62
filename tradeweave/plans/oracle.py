"""Independent SQL for the queries of the catalog, over the raw tables only.

Each statement starts with the shared views it needs, written out here a second
time from the definition of the mapping rather than from the Spark code.
"""

from __future__ import annotations


def r(value: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


# name -> (views it reads, definition)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sizes": ((), "SELECT (SELECT count(*) FROM customer) AS nc, (SELECT count(*) FROM supplier) AS ns, (SELECT count(*) FROM part) AS np"),
    "labels": ((), "SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', ' ') AS label FROM part"),
    "regions": ((), "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "customer_names": (
        ("sizes", "labels"),
        "SELECT c.*, label || ' ' || lower(c_mktsegment) AS full_name FROM customer c CROSS JOIN sizes "
        "JOIN labels ON p_partkey = c_custkey % np",
    ),
    "entities": (
        ("customer_names", "regions"),
        """
        SELECT c_custkey * 2 AS entity_id, full_name AS name, 'REG-' || c_custkey AS registration_number,
               r_name AS region, c_mktsegment AS segment, 'banked' AS status, c_acctbal AS turnover,
               CAST(c_custkey * 37 % 99 + 1 AS DOUBLE) / CAST(100 AS DOUBLE) AS risk_score, CAST(c_custkey % 25 AS INTEGER) AS sic_code
        FROM customer_names JOIN regions ON c_nationkey = n_nationkey
        UNION ALL
        SELECT s_suppkey * 2 + 1,
               full_name || CASE s_suppkey % 3 WHEN 0 THEN ' (Group) Limited' WHEN 1 THEN ' Limited' ELSE ' Company' END,
               NULL, r_name, NULL, 'unbanked', NULL, NULL,
               CAST(CASE WHEN s_suppkey % 16 = 8 THEN (s_suppkey * 7 + 3) % 25 ELSE s_suppkey % 25 END AS INTEGER)
        FROM supplier JOIN customer_names ON c_custkey = s_suppkey
        JOIN regions ON n_nationkey = CASE WHEN s_suppkey % 16 = 4 THEN s_nationkey ELSE c_nationkey END
        WHERE s_suppkey % 4 = 0
        UNION ALL
        SELECT s_suppkey * 2 + 1, label || ' trading', NULL, r_name, NULL, 'unbanked', NULL, NULL,
               CAST((s_suppkey * 7 + 3) % 25 AS INTEGER)
        FROM supplier CROSS JOIN sizes JOIN labels ON p_partkey = (s_suppkey * 31 + 7) % np
        JOIN regions ON n_nationkey = s_nationkey
        WHERE s_suppkey % 4 <> 0
        """,
    ),
    "industries": (
        (),
        "SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) - 1 AS sic_code, p_brand AS name, "
        "'Sector ' || ((CAST(substr(p_brand, 7) AS INTEGER) - 1) % 7) AS sector FROM part",
    ),
    "products": (
        (),
        """
        SELECT DISTINCT p_type || '-' || substr(p_brand, 7) || '-' || (p_size % 2) AS product_id,
               upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' ' || substr(p_brand, 7) || CASE WHEN p_size % 2 = 0 THEN ' plan' ELSE ' facility' END AS name,
               CASE p_type WHEN 'ECONOMY' THEN 'transact' WHEN 'STANDARD' THEN 'transact' WHEN 'PROMO' THEN 'lend'
                    WHEN 'SMALL' THEN 'lend' WHEN 'MEDIUM' THEN 'invest' ELSE 'insure' END AS pillar,
               CAST(length(p_type) * 25 AS DOUBLE) AS monthly_fee
        FROM part
        """,
    ),
    "raw_payments": (
        ("sizes",),
        """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS transaction_id,
               l_orderkey, l_partkey, o_custkey, l_quantity, l_returnflag,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_orderkey % 35 < 15 THEN 'EFT' WHEN l_orderkey % 35 < 25 THEN 'NAV'
                    WHEN l_orderkey % 35 < 33 THEN 'SOF' ELSE 'SWIFT' END AS channel,
               (o_custkey * 3 + l_suppkey % 4) % ns AS to_supplier,
               (o_custkey * 7 + 1 + l_linenumber * 11 + l_suppkey % 3) % nc AS to_customer, ns
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey CROSS JOIN sizes
        """,
    ),
    "directed": (
        ("raw_payments",),
        """
        SELECT *, o_custkey * 2 AS buyer,
               CASE WHEN l_partkey % 100 < 35 THEN to_supplier * 2 + 1
                    WHEN to_customer < ns AND to_customer % 4 = 0 AND l_partkey % 2 = 0 THEN to_customer * 2 + 1
                    ELSE to_customer * 2 END AS payee,
               l_quantity <= 7 AND channel IN ('EFT', 'SWIFT') AS back
        FROM raw_payments
        """,
    ),
    "payments": (
        ("directed",),
        """
        SELECT CASE WHEN back THEN payee ELSE buyer END AS sender, CASE WHEN back THEN buyer ELSE payee END AS receiver,
               transaction_id, l_orderkey, l_partkey, amount, date, channel, l_returnflag AS reference,
               CASE WHEN channel <> 'SWIFT' THEN 'ZAR' ELSE ['ZAR','USD','EUR','GBP'][CAST(l_partkey % 4 AS INTEGER) + 1] END AS currency
        FROM directed
        """,
    ),
    "transactions": (
        ("payments",),
        """
        SELECT sender * 4 + CASE WHEN sender % 2 = 1 THEN 0 ELSE l_orderkey % (1 + (sender // 2) % 3) END AS sender_account_id,
               receiver * 4 + CASE WHEN receiver % 2 = 1 THEN 0 ELSE l_partkey % (1 + (receiver // 2) % 3) END AS receiver_account_id,
               transaction_id, sender, receiver, amount, currency, date, channel, reference
        FROM payments
        """,
    ),
    "accounts": (
        ("transactions",),
        """
        SELECT owned.*, open_date FROM (
          SELECT c_custkey * 8 + slot AS account_id, c_custkey * 2 AS entity_id,
                 CASE slot WHEN 0 THEN 'cheque' WHEN 1 THEN 'savings' ELSE 'overdraft' END AS account_type, c_acctbal AS balance
          FROM customer, (SELECT unnest([0, 1, 2]) AS slot) WHERE slot <= c_custkey % 3
          UNION ALL
          SELECT (s_suppkey * 2 + 1) * 4, s_suppkey * 2 + 1, 'external', s_acctbal FROM supplier) owned
        LEFT JOIN (SELECT account_id, min(date) AS open_date FROM (
            SELECT sender_account_id AS account_id, date FROM transactions
            UNION ALL SELECT receiver_account_id, date FROM transactions) GROUP BY 1) USING (account_id)
        """,
    ),
    "holdings": (
        (),
        """
        SELECT o_custkey * 2 AS entity_id, p_type || '-' || substr(p_brand, 7) || '-' || (p_size % 2) AS product_id, min(CAST(l_shipdate AS DATE)) AS since
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        GROUP BY 1, 2
        """,
    ),
    "trades": (
        ("payments",),
        """
        SELECT sender AS src, receiver AS dst, sum(amount) AS amount, count(*) AS tx_count,
               CASE WHEN count(*) > 1 THEN CAST(date_diff('day', min(date), max(date)) AS DOUBLE) / CAST(count(*) - 1 AS DOUBLE) END AS avg_interval
        FROM payments WHERE sender <> receiver GROUP BY 1, 2
        """,
    ),
    "neighbours": (
        ("trades",),
        "SELECT src AS id, dst AS nbr, true AS outgoing, amount, tx_count, avg_interval FROM trades "
        "UNION ALL SELECT dst, src, false, amount, tx_count, avg_interval FROM trades",
    ),
    "pairs": (("neighbours",), "SELECT DISTINCT id, nbr FROM neighbours"),
    "inbound": (
        ("trades", "entities"),
        """
        SELECT dst, count(*) AS payers, sum(tx_count) AS tx_count, sum(amount) AS inbound
        FROM trades JOIN entities b ON src = b.entity_id AND b.status = 'banked'
        JOIN entities u ON dst = u.entity_id AND u.status = 'unbanked' GROUP BY dst
        """,
    ),
    "inflow": (
        ("trades", "entities"),
        "SELECT dst, count(*) AS payers, sum(tx_count) AS tx_count, sum(amount) AS inflow FROM trades "
        "JOIN entities ON dst = entity_id AND status = 'banked' GROUP BY dst",
    ),
    # Blocking: words, their document counts and fuzzy word pairs.
    "banked_words": (
        ("entities",),
        "SELECT DISTINCT entity_id AS banked_id, w.word FROM entities, "
        "unnest(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) AS w(word) WHERE status = 'banked' AND w.word <> ''",
    ),
    "plain_names": (
        ("entities",),
        "SELECT entity_id, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM entities",
    ),
    "word_counts": (("banked_words",), "SELECT word, count(*) AS names FROM banked_words GROUP BY word"),
    "n_banked": (("entities",), "SELECT CAST(count(*) AS DOUBLE) AS n FROM entities WHERE status = 'banked'"),
    "phrases": (
        ("entities",),
        "SELECT entity_id AS unbanked_id, string_split(lower(replace(replace(name, '(', ''), ')', '')), ' ') AS parts "
        "FROM entities WHERE status = 'unbanked'",
    ),
    "query_words": (
        ("phrases",),
        "SELECT unbanked_id, 1 AS pos, parts[1] AS query FROM phrases WHERE parts[1] <> '' "
        "UNION ALL SELECT unbanked_id, 2, parts[2] FROM phrases WHERE parts[2] <> ''",
    ),
    "word_matches": (
        ("query_words", "word_counts", "n_banked"),
        """
        SELECT query, word, ln(1 + (n - names + 0.5) / (names + 0.5))
               * (CAST(1 AS DOUBLE) - CAST(levenshtein(query, word) AS DOUBLE) / CAST(least(length(query), length(word)) AS DOUBLE)) AS weight
        FROM (SELECT DISTINCT query FROM query_words), word_counts, n_banked WHERE levenshtein(query, word) <= 2
        """,
    ),
    "word_hits": (
        ("query_words", "word_matches", "banked_words"),
        """
        SELECT unbanked_id, pos, banked_id, max(weight) AS weight
        FROM query_words JOIN word_matches m USING (query) JOIN banked_words b ON b.word = m.word
        WHERE weight > 0 GROUP BY 1, 2, 3
        """,
    ),
    "candidates": (
        ("word_hits", "plain_names"),
        f"SELECT unbanked_id, banked_id, {r('sum(weight)', 6)} AS block_score FROM word_hits "
        "JOIN plain_names u ON u.entity_id = unbanked_id JOIN plain_names b ON b.entity_id = banked_id "
        "GROUP BY 1, 2 HAVING sum(weight) > CAST(3 AS DOUBLE) OR bool_or(u.plain = b.plain)",
    ),
    "degrees": (("pairs",), "SELECT id, count(*) AS n FROM pairs GROUP BY id"),
    "overlap_of": (
        ("candidates", "pairs", "degrees"),
        """
        SELECT c.unbanked_id, c.banked_id, coalesce(CAST(s.shared AS DOUBLE), 0)
               / (CAST(du.n AS DOUBLE) + CAST(db.n AS DOUBLE) - coalesce(CAST(s.shared AS DOUBLE), 0)) AS trading_sim
        FROM candidates c JOIN degrees du ON du.id = unbanked_id JOIN degrees db ON db.id = banked_id
        LEFT JOIN (SELECT unbanked_id, banked_id, count(*) AS shared FROM candidates
                   JOIN pairs pu ON pu.id = unbanked_id JOIN pairs pb ON pb.id = banked_id AND pb.nbr = pu.nbr GROUP BY 1, 2) s
               ON s.unbanked_id = c.unbanked_id AND s.banked_id = c.banked_id
        """,
    ),
    "signals": (
        ("overlap_of", "entities"),
        """
        SELECT banked_id, unbanked_id, jaro_winkler_similarity(lower(u.name), lower(b.name)) AS name_sim,
               CASE WHEN u.sic_code = b.sic_code THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS industry_sim,
               CASE WHEN u.region = b.region THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS region_sim, trading_sim
        FROM overlap_of JOIN entities u ON u.entity_id = unbanked_id JOIN entities b ON b.entity_id = banked_id
        """,
    ),
    "scored": (
        ("signals",),
        "SELECT *, CAST(0.40 AS DOUBLE) * name_sim + CAST(0.20 AS DOUBLE) * industry_sim + CAST(0.15 AS DOUBLE) * region_sim "
        "+ CAST(0.25 AS DOUBLE) * trading_sim AS exact FROM signals",
    ),
    "matches": (
        ("scored",),
        f"SELECT banked_id, unbanked_id, {r('exact', 4)} AS confidence, {r('name_sim', 4)} AS name_sim, industry_sim, region_sim, "
        f"{r('trading_sim', 4)} AS trading_sim FROM scored WHERE exact >= CAST(0.45 AS DOUBLE)",
    ),
    "named_matches": (
        ("matches", "entities"),
        "SELECT m.*, b.name AS banked_name, b.region AS banked_region, u.name AS unbanked_name, u.region AS unbanked_region "
        "FROM matches m JOIN entities b ON b.entity_id = banked_id JOIN entities u ON u.entity_id = unbanked_id",
    ),
    "truth": (
        (),
        "SELECT s_suppkey * 2 AS banked_id, s_suppkey * 2 + 1 AS unbanked_id FROM supplier WHERE s_suppkey % 4 = 0 "
        "AND s_suppkey IN (SELECT c_custkey FROM customer)",
    ),
    "similar_pairs": (
        ("pairs", "degrees"),
        """
        SELECT a.id AS src, b.id AS dst, CAST(count(*) AS DOUBLE) / CAST(any_value(da.n) + any_value(db.n) - count(*) AS DOUBLE) AS similarity
        FROM pairs a JOIN pairs b ON a.nbr = b.nbr AND a.id <> b.id JOIN degrees da ON da.id = a.id JOIN degrees db ON db.id = b.id
        GROUP BY 1, 2 HAVING CAST(count(*) AS DOUBLE) / CAST(any_value(da.n) + any_value(db.n) - count(*) AS DOUBLE) >= CAST(0.3 AS DOUBLE)
        """,
    ),
    "alike": (
        ("similar_pairs",),
        "SELECT src, dst, similarity FROM similar_pairs QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5",
    ),
    "legs": (
        ("transactions",),
        "SELECT sender_account_id AS s, receiver_account_id AS d, amount, date FROM transactions WHERE sender_account_id <> receiver_account_id",
    ),
    "owners": (
        ("accounts", "entities"),
        "SELECT account_id, e.* FROM accounts JOIN entities e USING (entity_id)",
    ),
    "shares": (
        ("neighbours",),
        "SELECT id AS src, nbr AS dst, CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY id) AS DOUBLE) AS share FROM neighbours",
    ),
    "rank_0": (("entities", "shares"), "SELECT entity_id AS id, CAST(1 AS DOUBLE) - CAST(0.85 AS DOUBLE) AS rank FROM entities"),
    "node_counts": (
        ("entities", "accounts", "transactions", "industries", "products"),
        """
        SELECT 'node' AS kind, 'Customer' AS label, count(*) AS count FROM entities
        UNION ALL SELECT 'node', 'Account', count(*) FROM accounts UNION ALL SELECT 'node', 'Transaction', count(*) FROM transactions
        UNION ALL SELECT 'node', 'Industry', count(*) FROM industries UNION ALL SELECT 'node', 'Product', count(*) FROM products
        """,
    ),
    "counts": (
        ("node_counts", "holdings", "trades", "matches", "alike"),
        """
        SELECT * FROM node_counts
        UNION ALL SELECT 'relationship', 'BELONGS_TO', count(sic_code) FROM entities
        UNION ALL SELECT 'relationship', 'HAS_ACCOUNT', count(*) FROM accounts
        UNION ALL SELECT 'relationship', 'HOLDS_PRODUCT', count(*) FROM holdings
        UNION ALL SELECT 'relationship', 'SENT', count(*) FROM transactions
        UNION ALL SELECT 'relationship', 'RECEIVED_BY', count(*) FROM transactions
        UNION ALL SELECT 'relationship', 'TRADES_WITH', count(*) FROM trades
        UNION ALL SELECT 'relationship', 'POTENTIAL_MATCH', count(*) FROM matches
        UNION ALL SELECT 'relationship', 'SIMILAR_TO', count(*) FROM alike
        """,
    ),
}
for _i in range(1, 21):
    VIEWS[f"rank_{_i}"] = (
        (f"rank_{_i - 1}",),
        f"SELECT p.id, (CAST(1 AS DOUBLE) - CAST(0.85 AS DOUBLE)) + CAST(0.85 AS DOUBLE) * coalesce(a.arrived, 0) AS rank FROM rank_{_i - 1} p "
        f"LEFT JOIN (SELECT dst, sum(q.rank * share) AS arrived FROM rank_{_i - 1} q JOIN shares ON q.id = src GROUP BY dst) a ON a.dst = p.id",
    )
# Shortest paths out of every entity, or out of a few, one view per level, and dependencies back.
LEVELS = 6
PIVOTS = 48


def _walks(prefix: str, start: str) -> None:
    VIEWS[f"{prefix}level_0"] = (("pairs", "entities"), f"SELECT entity_id AS s, entity_id AS v, CAST(1 AS DOUBLE) AS paths FROM {start}")
    for i in range(1, LEVELS + 1):
        seen = f"SELECT s, v FROM {prefix}level_{i - 1}" + (f" UNION ALL SELECT s, v FROM {prefix}level_{i - 2}" if i > 1 else "")
        VIEWS[f"{prefix}level_{i}"] = (
            (f"{prefix}level_{i - 1}",),
            f"SELECT f.s, nbr AS v, sum(paths) AS paths FROM {prefix}level_{i - 1} f JOIN pairs ON id = f.v "
            f"WHERE true GROUP BY 1, 2 HAVING (f.s, nbr) NOT IN ({seen})",
        )
    VIEWS[f"{prefix}flow_{LEVELS}"] = ((f"{prefix}level_{LEVELS}",), f"SELECT s, v, paths, CAST(0 AS DOUBLE) AS dependency FROM {prefix}level_{LEVELS}")
    for i in range(LEVELS - 1, 0, -1):
        VIEWS[f"{prefix}flow_{i}"] = (
            (f"{prefix}flow_{i + 1}",),
            f"SELECT l.s, l.v, l.paths, l.paths * coalesce(c.c, 0) AS dependency FROM {prefix}level_{i} l LEFT JOIN (SELECT s, nbr AS v, "
            f"sum((CAST(1 AS DOUBLE) + dependency) / paths) AS c FROM {prefix}flow_{i + 1} JOIN pairs ON id = v GROUP BY 1, 2) c ON c.s = l.s AND c.v = l.v",
        )
    every = " UNION ALL ".join(f"SELECT v, dependency FROM {prefix}flow_{i}" for i in range(1, LEVELS + 1))
    VIEWS[f"{prefix}between"] = (
        (f"{prefix}flow_1",),
        f"SELECT entity_id, coalesce(b, 0) / 2 AS betweenness FROM entities LEFT JOIN (SELECT v, sum(dependency) AS b FROM ({every}) GROUP BY v) ON v = entity_id",
    )


_walks("", "entities")
_walks("p_", f"(SELECT entity_id FROM entities ORDER BY md5(entity_id || ':0'), entity_id LIMIT {PIVOTS})")

# Communities: a recursion over the rounds of each level, then its quality and whether the level is kept.
SWEEPS, COMMUNITY_LEVELS, TOLERANCE = 15, 5, "CAST(0.0001 AS DOUBLE)"
QUALITY = (
    "(SELECT sum(inside / total - (a / total) * (a / total)) FROM (SELECT CAST(sum(CASE WHEN src = dst THEN weight ELSE 0 END) AS DOUBLE) AS inside, "
    "CAST(sum(weight) AS DOUBLE) AS a FROM {edges} GROUP BY src) CROSS JOIN com_total)"
)
VIEWS["com_0_edges"] = (("neighbours",), "SELECT id AS src, nbr AS dst, sum(amount) AS weight FROM neighbours GROUP BY 1, 2 HAVING sum(amount) > 0")
VIEWS["com_total"] = (("com_0_edges",), "SELECT CAST(sum(weight) AS DOUBLE) AS total FROM com_0_edges")
VIEWS["com_0_quality"] = (("com_total",), f"SELECT {QUALITY.format(edges='com_0_edges')} AS q, true AS ok")
VIEWS["com_0_members"] = (("entities",), "SELECT entity_id, entity_id AS community_id FROM entities")
for _k in range(COMMUNITY_LEVELS):
    VIEWS[f"com_{_k}_ends"] = (
        (f"com_{_k}_edges", "com_total"),
        f"""
        WITH RECURSIVE s AS (
          SELECT 0 AS turn, src AS id, sum(weight) AS strength, src AS community FROM com_{_k}_edges GROUP BY src
          UNION ALL
          SELECT turn + 1, n.id, strength, coalesce(joined, community)
          FROM s n LEFT JOIN (
            SELECT id, target AS joined FROM (
              SELECT *, row_number() OVER (PARTITION BY id ORDER BY gain DESC, target) AS place, max(CASE WHEN target = community THEN gain END) OVER (PARTITION BY id) AS own_gain
              FROM (
                SELECT n.id, n.community, n.strength, l.target, nt.tot, total,
                       CAST(link AS DOUBLE) - CAST(n.strength AS DOUBLE) * CAST(lt.tot - CASE WHEN l.target = n.community THEN n.strength ELSE 0 END AS DOUBLE) / total AS gain
                FROM (SELECT e.src AS id, o.community AS target, sum(weight) AS link FROM com_{_k}_edges e JOIN s o ON o.id = e.dst WHERE e.src <> e.dst GROUP BY 1, 2) l
                JOIN s n ON n.id = l.id
                JOIN (SELECT community, sum(strength) AS tot FROM s GROUP BY 1) lt ON lt.community = l.target
                JOIN (SELECT community, sum(strength) AS tot FROM s GROUP BY 1) nt ON nt.community = n.community
                CROSS JOIN com_total
                WHERE ascii(md5(n.id || ':{_k}:' || (n.turn // 2))) % 2 = n.turn % 2
              )
            ) WHERE place = 1
              AND gain > coalesce(own_gain, -CAST(strength AS DOUBLE) * CAST(tot - strength AS DOUBLE) / total) + CAST(0.000000001 AS DOUBLE) * total
          ) m ON m.id = n.id
          WHERE turn < {2 * SWEEPS}
        )
        SELECT id, community FROM s WHERE turn = {2 * SWEEPS}
        """,
    )
    VIEWS[f"com_{_k + 1}_edges"] = (
        (f"com_{_k}_ends",),
        f"SELECT a.community AS src, b.community AS dst, sum(weight) AS weight FROM com_{_k}_edges JOIN com_{_k}_ends a ON a.id = src JOIN com_{_k}_ends b ON b.id = dst GROUP BY 1, 2",
    )
    VIEWS[f"com_{_k + 1}_quality"] = (
        (f"com_{_k + 1}_edges", f"com_{_k}_quality"),
        f"SELECT x AS q, ok AND x - q >= {TOLERANCE} AS ok FROM (SELECT {QUALITY.format(edges=f'com_{_k + 1}_edges')} AS x) CROSS JOIN com_{_k}_quality",
    )
    VIEWS[f"com_{_k + 1}_members"] = (
        (f"com_{_k}_members", f"com_{_k + 1}_quality"),
        f"SELECT entity_id, CASE WHEN ok THEN coalesce(community, community_id) ELSE community_id END AS community_id "
        f"FROM com_{_k}_members LEFT JOIN com_{_k}_ends ON id = community_id CROSS JOIN com_{_k + 1}_quality",
    )
VIEWS["communities"] = ((f"com_{COMMUNITY_LEVELS}_members",), f"SELECT * FROM com_{COMMUNITY_LEVELS}_members")


def _collect(name: str, seen: dict[str, str]) -> None:
    needs, definition = VIEWS[name]
    for need in needs:
        if need not in seen:
            _collect(need, seen)
    seen.setdefault(name, definition)


def sql(body: str, *views: str) -> str:
    chosen: dict[str, str] = {}
    for view in views:
        _collect(view, chosen)
    if not chosen:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({d})" for n, d in chosen.items()) + "\n" + body


ENTITY_TEXT = (
    "SELECT CAST(entity_id AS VARCHAR) AS entity_id, name, registration_number, region, segment, status, turnover, "
    "risk_score, CAST(sic_code AS VARCHAR) AS sic_code FROM entities"
)
EDGE_NAMES = (
    "SELECT src, a.name AS src_name, a.status AS src_status, dst, b.name AS dst_name, b.status AS dst_status, tx_count, "
    "CAST(amount AS DOUBLE) AS amount, avg_interval FROM trades JOIN entities a ON src = a.entity_id JOIN entities b ON dst = b.entity_id"
)
SENT_BY_TARGET = "FROM transactions JOIN accounts ON sender_account_id = account_id WHERE entity_id = 0"
FINAL_TRADES = "SELECT src, dst, CAST(amount AS DOUBLE) AS amount, tx_count, avg_interval FROM trades"


def _partners(end: str, fixed: str) -> str:
    return (
        f"SELECT {end} AS partner_id, name, status, tx_count, {r('amount', 2)} AS total_amount, avg_interval FROM trades "
        f"JOIN entities ON {end} = entity_id WHERE {fixed} = 0 ORDER BY amount DESC, {end} LIMIT 15"
    )


def _multi_payer(count_by_name: bool, min_payers: int) -> str:
    payers = "count(DISTINCT b.name)" if count_by_name else "count(*)"
    return (
        f"SELECT dst, {payers} AS payers, sum(amount) AS inbound FROM trades JOIN entities b ON src = b.entity_id AND b.status = 'banked' "
        f"JOIN entities u ON dst = u.entity_id AND u.status = 'unbanked' GROUP BY dst HAVING {payers} >= {min_payers} ORDER BY inbound DESC, dst LIMIT 20"
    )


def _payer_rows(count_by_name: bool, min_payers: int) -> str:
    distinct = "DISTINCT" if count_by_name else ""
    return (
        f"SELECT {distinct} t.dst AS entity_id, u.name, u.region, t.payers, {r('t.inbound', 2)} AS total_inbound, p.name AS payer_name "
        f"FROM ({_multi_payer(count_by_name, min_payers)}) t JOIN entities u ON u.entity_id = t.dst "
        "JOIN trades e ON e.dst = t.dst JOIN entities p ON p.entity_id = e.src AND p.status = 'banked'"
    )


E1 = """
SELECT CAST(1 AS BIGINT) AS hops, id || '-' || nbr AS nodes,
       CASE WHEN outgoing THEN id || '>' || nbr ELSE nbr || '>' || id END AS edges, [id, nbr] AS k,
       [CASE WHEN outgoing THEN [id, nbr] ELSE [nbr, id] END] AS e
FROM neighbours WHERE id = 0
UNION ALL
SELECT 2, a.id || '-' || a.nbr || '-' || b.nbr,
       CASE WHEN a.outgoing THEN a.id || '>' || a.nbr ELSE a.nbr || '>' || a.id END || ', ' ||
       CASE WHEN b.outgoing THEN b.id || '>' || b.nbr ELSE b.nbr || '>' || b.id END, [a.id, a.nbr, b.nbr],
       [CASE WHEN a.outgoing THEN [a.id, a.nbr] ELSE [a.nbr, a.id] END, CASE WHEN b.outgoing THEN [b.id, b.nbr] ELSE [b.nbr, b.id] END]
FROM neighbours a JOIN neighbours b ON b.id = a.nbr
WHERE a.id = 0 AND NOT (b.nbr = a.id AND a.outgoing <> b.outgoing)
"""


def _peer_holders(extra: str) -> str:
    return (
        "SELECT t.entity_id, p.product_id, p.name AS product, p.pillar, count(DISTINCT e.entity_id) AS peers_holding"
        f"{extra} FROM entities t JOIN entities e ON e.sic_code = t.sic_code AND e.status = 'banked' AND e.entity_id <> t.entity_id "
        "JOIN holdings h ON h.entity_id = e.entity_id JOIN products p ON p.product_id = h.product_id "
        "WHERE (t.entity_id, p.product_id) NOT IN (SELECT entity_id, product_id FROM holdings) AND "
    )


GRADE = "CASE WHEN payers >= {0} AND channels >= {1} THEN 'LOW RISK' WHEN payers >= {2} AND channels >= {3} THEN 'MEDIUM RISK' ELSE 'HIGHER RISK' END"


def _collateral(cuts: tuple[int, int, int, int], tail: str) -> str:
    return (
        "SELECT entity_id, name, segment, risk_score, payers, channels, CAST(tx_count AS BIGINT) AS tx_count, "
        f"{r('inflow', 2)} AS total_inflow, {r('CAST(inflow AS DOUBLE) / CAST(tx_count AS DOUBLE)', 2)} AS avg_payment, "
        f"{GRADE.format(*cuts)} AS grade FROM inflow JOIN entities ON dst = entity_id "
        "JOIN (SELECT receiver, count(DISTINCT channel) AS channels FROM transactions GROUP BY 1) ON receiver = dst " + tail
    )


def _stability(high: int, mid: int, tail: str) -> str:
    return (
        f"SELECT entity_id, name, segment, payers, {r('mean_days', 1)} AS avg_interval_days, {r('std_days', 1)} AS std_dev_days, "
        f"{r('inflow', 2)} AS total_inflow, CASE WHEN std_days < {high} THEN 'HIGHLY STABLE' WHEN std_days < {mid} THEN 'STABLE' ELSE 'VARIABLE' END AS grade "
        "FROM (SELECT dst, count(*) AS payers, avg(avg_interval) AS mean_days, stddev_samp(avg_interval) AS std_days, sum(amount) AS inflow "
        "FROM trades WHERE avg_interval IS NOT NULL GROUP BY dst HAVING count(*) >= 3) JOIN entities ON dst = entity_id AND status = 'banked' " + tail
    )


def _into_largest(condition: str) -> str:
    return (
        "SELECT src, a.name AS src_name, dst, b.name AS dst_name, CAST(amount AS DOUBLE) AS amount, tx_count FROM trades "
        "JOIN entities a ON src = a.entity_id JOIN entities b ON dst = b.entity_id "
        f"WHERE dst = (SELECT dst FROM inflow WHERE {condition} ORDER BY inflow DESC, dst LIMIT 1)"
    )


def _named_match(columns: str, tail: str) -> str:
    return f"SELECT banked_id, banked_name, unbanked_id, unbanked_name, {columns} FROM named_matches {tail}"


DRIVEN = "confidence, name_sim, trading_sim"
MATCH_TIES = "DESC, banked_id, unbanked_id"


def _hidden(counted: str) -> str:
    return (
        "SELECT m.banked_id, m.banked_name, m.unbanked_id, m.unbanked_name, m.confidence, coalesce(k.new_partners, 0) AS new_partners, "
        "coalesce(k.sample_partners, '') AS sample_partners FROM named_matches m LEFT JOIN ("
        f"SELECT banked_id, unbanked_id, count(DISTINCT {counted}) AS new_partners, "
        "array_to_string(list_sort(list(DISTINCT e.name))[1:5], '; ') AS sample_partners FROM matches JOIN pairs ON id = unbanked_id "
        "JOIN entities e ON e.entity_id = nbr WHERE (banked_id, nbr) NOT IN (SELECT id, nbr FROM pairs) GROUP BY 1, 2) k "
        "ON k.banked_id = m.banked_id AND k.unbanked_id = m.unbanked_id WHERE m.confidence >= 0.7"
    )


def _network(pick: str, join: str) -> str:
    return (
        "SELECT banked_id, unbanked_id, confidence, side, nbr AS partner_id, outgoing, CAST(amount AS DOUBLE) AS amount FROM ("
        f"SELECT banked_id, unbanked_id, confidence, unnest(['banked', 'unbanked']) AS side, unnest([banked_id, unbanked_id]) AS pid FROM ({pick})) "
        f"{join} JOIN neighbours ON id = pid"
    )


def _named_pair(banked: int, unbanked: int, condition: str) -> str:
    return f"""
    SELECT banked_id, unbanked_id, {r('exact', 4)} AS confidence, {r('name_sim', 4)} AS name_sim, industry_sim, region_sim, {r('trading_sim', 4)} AS trading_sim
    FROM (SELECT *, CAST(0.40 AS DOUBLE) * name_sim + CAST(0.20 AS DOUBLE) * industry_sim + CAST(0.15 AS DOUBLE) * region_sim
                 + CAST(0.25 AS DOUBLE) * trading_sim AS exact FROM (
      SELECT b.entity_id AS banked_id, u.entity_id AS unbanked_id, jaro_winkler_similarity(lower(u.name), lower(b.name)) AS name_sim,
        CASE WHEN u.sic_code = b.sic_code THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS industry_sim,
        CASE WHEN u.region = b.region THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS region_sim,
        CAST((SELECT count(*) FROM pairs x JOIN pairs y ON x.nbr = y.nbr WHERE x.id = {unbanked} AND y.id = {banked}) AS DOUBLE)
        / CAST((SELECT count(DISTINCT nbr) FROM pairs WHERE id IN ({unbanked}, {banked})) AS DOUBLE) AS trading_sim
      FROM entities u, entities b WHERE u.entity_id = {unbanked} AND b.entity_id = {banked})) {condition}
    """


def _layering(routed: str) -> str:
    return f"""
    SELECT r.s AS source_account, a.name AS source_name, a.risk_score AS source_risk, a.segment AS source_segment,
           r.d AS dest_account, b.name AS dest_name, b.risk_score AS dest_risk, b.segment AS dest_segment, intermediaries, {r('routed', 2)} AS total_routed
    FROM ({routed}) r JOIN owners a ON a.account_id = r.s JOIN owners b ON b.account_id = r.d
    """


LAYER_PAIRS = (
    "FROM legs t1 JOIN legs t2 ON t1.d = t2.s WHERE t1.s <> t2.d AND t1.date <= t2.date AND date_diff('day', t1.date, t2.date) <= 14"
)
SEARCH = "position('{0}' IN name) > 0 OR CAST(entity_id AS VARCHAR) = '{0}'"

PATH = """
, walk_0 AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS parent),
walk_1 AS MATERIALIZED (SELECT nbr AS id, min(p.id) AS parent FROM pairs p JOIN walk_0 w ON p.id = w.id WHERE nbr NOT IN (SELECT id FROM walk_0) GROUP BY 1),
walk_2 AS MATERIALIZED (SELECT nbr AS id, min(p.id) AS parent FROM pairs p JOIN walk_1 w ON p.id = w.id
  WHERE nbr NOT IN (SELECT id FROM walk_0 UNION SELECT id FROM walk_1) GROUP BY 1),
walk_3 AS MATERIALIZED (SELECT nbr AS id, min(p.id) AS parent FROM pairs p JOIN walk_2 w ON p.id = w.id
  WHERE nbr NOT IN (SELECT id FROM walk_0 UNION SELECT id FROM walk_1 UNION SELECT id FROM walk_2) GROUP BY 1),
found AS (
  SELECT 1 AS hops, [w1.parent, w1.id] AS nodes FROM walk_1 w1 WHERE w1.id = {b}
  UNION ALL SELECT 2, [w1.parent, w1.id, w2.id] FROM walk_2 w2 JOIN walk_1 w1 ON w1.id = w2.parent WHERE w2.id = {b}
  UNION ALL SELECT 3, [w1.parent, w1.id, w2.id, w3.id] FROM walk_3 w3 JOIN walk_2 w2 ON w2.id = w3.parent JOIN walk_1 w1 ON w1.id = w2.parent WHERE w3.id = {b})
SELECT CAST(hops AS BIGINT) AS hops, CAST(i AS BIGINT) AS step, nodes[i + 1] AS entity_id, name
FROM found, unnest([0, 1, 2, 3]) AS s(i) JOIN entities ON entity_id = nodes[i + 1] WHERE i <= hops
"""

COMPONENT_DAYS = """
CASE WHEN day(date) >= day(prev) THEN day(date) - day(prev)
     ELSE date_diff('day', CAST(prev + to_months(CAST((year(date) - year(prev)) * 12 + month(date) - month(prev) - 1 AS INTEGER)) AS DATE), date) END
"""

ORACLES: dict[str, str] = {
    "a1_read_industries": sql("SELECT * FROM industries", "industries"),
    "a2_read_products": sql("SELECT * FROM products", "products"),
    "a3_read_entities": sql(ENTITY_TEXT, "entities"),
    "a4_read_accounts": sql(
        "SELECT CAST(account_id AS VARCHAR) AS account_id, CAST(entity_id AS VARCHAR) AS entity_id, account_type, open_date, balance FROM accounts", "accounts"
    ),
    "a5_read_transactions": sql(
        "SELECT transaction_id, CAST(sender_account_id AS VARCHAR) AS sender_account_id, CAST(receiver_account_id AS VARCHAR) AS receiver_account_id, "
        "CAST(amount AS DOUBLE) AS amount, currency, date, channel, reference FROM transactions",
        "transactions",
    ),
    "a5_transaction_rejects": sql(
        "SELECT 'sender_account_id' AS missing_parent, channel, count(*) AS rejected FROM transactions WHERE sender % 2 = 1 GROUP BY 2 "
        "UNION ALL SELECT 'receiver_account_id', channel, count(*) FROM transactions WHERE receiver % 2 = 1 GROUP BY 2",
        "transactions",
    ),
    "a6_read_holdings": sql("SELECT CAST(entity_id AS VARCHAR) AS entity_id, product_id, since FROM holdings", "holdings"),
    "a7_check_unique": sql("SELECT name, count(*) AS count FROM entities GROUP BY 1 HAVING count(*) > 1", "entities"),
    "a7_check_unique_ids": sql(
        " UNION ALL ".join(
            f"SELECT '{key}' AS key, count(*) AS repeated FROM (SELECT {key} FROM {table} GROUP BY 1 HAVING count(*) > 1)"
            for table, key in (("entities", "entity_id"), ("accounts", "account_id"), ("transactions", "transaction_id"), ("products", "product_id"), ("industries", "sic_code"))
        ),
        "entities", "accounts", "transactions", "products", "industries",
    ),
    "a8_upsert": sql(
        "SELECT entity_id, upper(name) AS name, CASE WHEN status = 'banked' THEN region END AS region, segment, "
        "CASE WHEN status = 'banked' THEN status END AS status, coalesce(turnover, 0) + CAST(1 AS DOUBLE) AS turnover FROM entities",
        "entities",
    ),
    "a9_accumulate_trades": sql("SELECT src, dst, CAST(amount AS DOUBLE) AS amount, tx_count FROM trades", "trades"),
    "a10_insert_if_absent": sql(
        "SELECT src, dst, CASE WHEN tx_count > 1 THEN CAST(amount AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS amount, tx_count, "
        "CASE WHEN tx_count > 1 THEN avg_interval ELSE CAST(12 AS DOUBLE) END AS avg_interval FROM trades",
        "trades",
    ),
    "a11_link_entities": sql(
        "SELECT entity_id, name, CASE WHEN entity_id IN (SELECT entity_id FROM holdings) THEN 24 ELSE sic_code END AS sic_code FROM entities",
        "entities", "holdings",
    ),
    "a11_linked_count": sql("SELECT count(DISTINCT entity_id) AS customers_linked FROM holdings", "holdings"),
    "a12_delete_cascade": sql(
        "SELECT 'trades' AS kind, src AS a, CAST(dst AS VARCHAR) AS b FROM trades "
        "WHERE NOT regexp_matches(CAST(src AS VARCHAR), '^(1|22)') AND NOT regexp_matches(CAST(dst AS VARCHAR), '^(1|22)') "
        "UNION ALL SELECT 'holdings', entity_id, product_id FROM holdings WHERE NOT regexp_matches(CAST(entity_id AS VARCHAR), '^(1|22)') "
        "UNION ALL SELECT 'entities', entity_id, name FROM entities WHERE NOT regexp_matches(CAST(entity_id AS VARCHAR), '^(1|22)')",
        "trades", "holdings", "entities",
    ),
    "a13_rebuild_matches": sql("SELECT * FROM matches", "matches"),
    "a14_write_back": sql(f"SELECT entity_id, name, {r('rank', 6)} AS page_rank FROM entities LEFT JOIN rank_20 ON id = entity_id", "rank_20"),
    "a15_inline_rows": sql(
        "SELECT tier, count(*) AS entities FROM entities JOIN (VALUES ('HOUSEHOLD', 'retail'), ('AUTOMOBILE', 'trade'), ('MACHINERY', 'trade')) v(segment, tier) "
        "USING (segment) GROUP BY 1",
        "entities",
    ),
    "a16_read_ground_truth": sql(
        "SELECT CAST(banked_id AS VARCHAR) AS banked_id, CAST(unbanked_id AS VARCHAR) AS unbanked_id, b.name AS banked_name, u.name AS unbanked_name "
        "FROM truth JOIN entities b ON b.entity_id = banked_id JOIN entities u ON u.entity_id = unbanked_id",
        "truth", "entities",
    ),
    "d1_trades_with": sql("SELECT src, dst, CAST(amount AS DOUBLE) AS amount, tx_count FROM trades", "trades"),
    "d2_avg_interval": sql("SELECT src, dst, avg_interval FROM trades WHERE tx_count > 1", "trades"),
    "d2_avg_interval_component": sql(
        f"SELECT src, dst, CAST(sum(gap) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_interval FROM (SELECT src, dst, {COMPONENT_DAYS} AS gap FROM ("
        "SELECT sender AS src, receiver AS dst, date, lag(date) OVER (PARTITION BY sender, receiver ORDER BY date) AS prev FROM payments WHERE sender <> receiver) "
        "WHERE prev IS NOT NULL) GROUP BY 1, 2",
        "payments",
    ),
    "d2_avg_interval_truncated": sql("SELECT src, dst, floor(avg_interval) AS avg_interval FROM trades WHERE tx_count > 1", "trades"),
    "d3_neighbours": sql("SELECT id, nbr, outgoing, CAST(amount AS DOUBLE) AS amount, tx_count, avg_interval FROM neighbours", "neighbours"),
    "p1_top_pairs": sql(EDGE_NAMES + " ORDER BY tx_count DESC, src, dst LIMIT 20", "trades", "entities"),
    "p2_channel_breakdown": sql(
        f"SELECT channel, count(*) AS tx_count, {r('CAST(sum(amount) AS DOUBLE) / CAST(count(*) AS DOUBLE)', 2)} AS avg_amount, "
        f"{r('sum(amount)', 2)} AS total_amount, min(date) AS earliest, max(date) AS latest {SENT_BY_TARGET} GROUP BY 1",
        "transactions", "accounts",
    ),
    "p3_monthly_trend": sql(
        f"SELECT year(date) AS year, month(date) AS month, count(*) AS tx_count, {r('sum(amount)', 2)} AS total_amount {SENT_BY_TARGET} GROUP BY 1, 2",
        "transactions", "accounts",
    ),
    "p4_top_payees": sql(_partners("dst", "src"), "trades", "entities"),
    "p5_top_payers": sql(_partners("src", "dst"), "trades", "entities"),
    "p6_largest_relationship": sql(EDGE_NAMES + " ORDER BY trades.amount DESC, src, dst LIMIT 1", "trades", "entities"),
    "p7_active_pairs": sql(EDGE_NAMES + " WHERE tx_count > 5", "trades", "entities"),
    "p8_high_value_edges": sql(
        "SELECT id, nbr, outgoing, CAST(n.amount AS DOUBLE) AS amount, tx_count FROM neighbours n JOIN entities ON id = entity_id AND status = 'banked' "
        "WHERE n.amount > 300000 ORDER BY n.amount DESC, id, nbr, outgoing LIMIT 200",
        "neighbours", "entities",
    ),
    "u1_top_unbanked": sql(
        f"SELECT entity_id, name, region, payers, CAST(tx_count AS BIGINT) AS tx_count, {r('inbound', 2)} AS total_inbound FROM inbound "
        "JOIN entities ON dst = entity_id ORDER BY inbound DESC, dst LIMIT 25",
        "inbound",
    ),
    "u2_multi_payer_targets": sql(_payer_rows(False, 60), "trades", "entities"),
    "u2_multi_payer_targets_by_name": sql(_payer_rows(True, 50), "trades", "entities"),
    "u3_multi_payer_sample": sql(
        "SELECT entity_id, name, region, payers, total_inbound, array_to_string(list_sort(list(payer_name))[1:5], '; ') AS sample_payers "
        f"FROM ({_payer_rows(True, 3)}) GROUP BY 1, 2, 3, 4, 5",
        "trades", "entities",
    ),
    "u4_unbanked_by_industry": sql(
        f"SELECT sic_code, i.name AS industry, sector, count(*) AS unbanked_count, {r('sum(inbound)', 2)} AS total_inbound FROM inbound "
        "JOIN entities ON dst = entity_id JOIN industries i USING (sic_code) WHERE inbound > 10000000 GROUP BY 1, 2, 3",
        "inbound", "industries",
    ),
    "u5_top_target_network": sql(
        "SELECT id, nbr, name AS nbr_name, status AS nbr_status, outgoing, CAST(amount AS DOUBLE) AS amount, tx_count FROM neighbours "
        "JOIN entities ON nbr = entity_id WHERE id = (SELECT dst FROM inbound ORDER BY inbound DESC, dst LIMIT 1)",
        "neighbours", "inbound",
    ),
    "u6_top_targets_with_payers": sql(
        "SELECT src AS payer_id, name AS payer_name, dst AS entity_id, CAST(amount AS DOUBLE) AS amount, tx_count FROM trades "
        "JOIN entities ON src = entities.entity_id AND status = 'banked' WHERE dst IN (SELECT dst FROM inbound ORDER BY inbound DESC, dst LIMIT 5)",
        "inbound",
    ),
    "u7_multi_payer_edges": sql(
        "SELECT src, dst, payers, CAST(amount AS DOUBLE) AS amount, t.tx_count FROM trades t JOIN inbound USING (dst) "
        "JOIN entities ON src = entity_id AND status = 'banked' WHERE payers >= 60",
        "inbound",
    ),
    "u8_value_to_unbanked": sql(f"SELECT CAST(sum(payers) AS BIGINT) AS relationships, {r('sum(inbound)', 2)} AS total_value FROM inbound", "inbound"),
    "e1_ecosystem_paths": sql(f"SELECT hops, nodes, edges FROM ({E1})", "neighbours"),
    "e1_ecosystem_paths_view": sql(f"SELECT hops, nodes, edges FROM ({E1}) ORDER BY hops, k, e LIMIT 200", "neighbours"),
    "e2_ecosystem_size": sql(
        "SELECT entity_id, name, segment, region, ecosystem_size FROM (SELECT c AS entity_id, count(*) AS ecosystem_size FROM ("
        "SELECT id AS c, nbr AS o FROM pairs UNION SELECT a.id, b.nbr FROM pairs a JOIN pairs b ON b.id = a.nbr WHERE a.id <> b.nbr) GROUP BY 1) "
        "JOIN entities USING (entity_id) WHERE status = 'banked' ORDER BY ecosystem_size DESC, entity_id LIMIT 20",
        "pairs", "entities",
    ),
    "e3_shared_counterparties": sql(
        "SELECT e.entity_id, name, status, region FROM neighbours a JOIN neighbours b ON a.nbr = b.nbr JOIN entities e ON e.entity_id = a.nbr "
        "WHERE a.id = 0 AND b.id = 2",
        "neighbours", "entities",
    ),
    "e4_sector_network": sql(
        f"SELECT id, a.name, nbr, b.name AS nbr_name, outgoing, {r('amount', 2)} AS total_amount, tx_count FROM neighbours "
        "JOIN entities a ON id = a.entity_id JOIN entities b ON nbr = b.entity_id JOIN industries i ON i.sic_code = a.sic_code "
        "WHERE sector = 'Sector 3' ORDER BY amount DESC, id, nbr, outgoing LIMIT 50",
        "neighbours", "entities", "industries",
    ),
    "e5_partner_context": sql(
        "SELECT id, c.name, i.name AS industry, nbr AS partner_id, p.name AS partner_name, j.name AS partner_industry, outgoing, "
        "CAST(amount AS DOUBLE) AS amount, tx_count FROM neighbours JOIN entities c ON id = c.entity_id JOIN industries i ON i.sic_code = c.sic_code "
        "JOIN entities p ON nbr = p.entity_id LEFT JOIN industries j ON j.sic_code = p.sic_code WHERE id = 0 "
        "ORDER BY neighbours.amount DESC, nbr, outgoing LIMIT 50",
        "neighbours", "entities", "industries",
    ),
    "e6_shortest_path": sql("", "pairs", "entities") + PATH.format(b=200),
    "e6_shortest_path_far": sql("", "pairs", "entities") + PATH.format(b=8),
    "r1_block_candidates_preview": sql(
        f"SELECT unbanked_id, u.name AS unbanked_name, banked_id, b.name AS banked_name, {r(r('weight', 6), 3)} AS block_score FROM word_hits "
        "JOIN entities u ON u.entity_id = unbanked_id JOIN entities b ON b.entity_id = banked_id WHERE pos = 1 AND weight > CAST(1.5 AS DOUBLE) "
        f"ORDER BY {r('weight', 6)} DESC, unbanked_id, banked_id LIMIT 50",
        "word_hits",
    ),
    "r2_block_candidates": sql("SELECT * FROM candidates", "candidates"),
    "r3_name_similarity": sql(f"SELECT banked_id, unbanked_id, {r('name_sim', 6)} AS name_sim FROM signals", "signals"),
    "r4_industry_match": sql("SELECT banked_id, unbanked_id, industry_sim FROM signals", "signals"),
    "r5_region_match": sql("SELECT banked_id, unbanked_id, region_sim FROM signals", "signals"),
    "r6_trading_overlap": sql(f"SELECT banked_id, unbanked_id, {r('trading_sim', 6)} AS trading_sim FROM signals", "signals"),
    "r7_match_confidence": sql("SELECT * FROM matches", "matches"),
    "r8_score_named_pair": sql(_named_pair(0, 1, "WHERE exact >= CAST(0.45 AS DOUBLE)"), "pairs", "entities"),
    "r8_score_named_pair_unfiltered": sql(_named_pair(2, 1, ""), "pairs", "entities"),
    "r9_match_summary": sql(
        f"SELECT count(*) AS total_matches, {r('avg(confidence)', 3)} AS avg_confidence, {r('min(confidence)', 3)} AS min_confidence, "
        f"{r('max(confidence)', 3)} AS max_confidence FROM matches",
        "matches",
    ),
    "r10_ranked_matches": sql(_named_match("confidence, name_sim, industry_sim, region_sim, trading_sim", ""), "named_matches"),
    "r10_ranked_matches_top": sql(
        _named_match("confidence, name_sim, industry_sim, region_sim, trading_sim", f"ORDER BY confidence {MATCH_TIES} LIMIT 20"), "named_matches"
    ),
    "r11_high_confidence": sql(
        _named_match("banked_region, unbanked_region, confidence, name_sim, trading_sim", "WHERE confidence >= 0.7"), "named_matches"
    ),
    "r11_high_confidence_of_one": sql(
        _named_match("banked_region, unbanked_region, confidence, name_sim, trading_sim", "WHERE confidence >= 0.7 AND banked_id = 96"), "named_matches"
    ),
    "r12_review_queue": sql(_named_match(DRIVEN, "WHERE confidence >= 0.45 AND confidence < 0.7"), "named_matches"),
    "r13_name_driven": sql(
        _named_match(DRIVEN, f"WHERE name_sim > 0.8 AND trading_sim < 0.1 ORDER BY name_sim {MATCH_TIES} LIMIT 15"), "named_matches"
    ),
    "r14_structure_driven": sql(
        _named_match(DRIVEN, f"WHERE trading_sim > 0.08 ORDER BY trading_sim {MATCH_TIES} LIMIT 15"), "named_matches"
    ),
    "r15_all_signals_agree": sql(
        _named_match(DRIVEN, "WHERE name_sim > 0.6 AND industry_sim = 1 AND region_sim = 1 AND trading_sim > 0.05 "
                     f"ORDER BY confidence {MATCH_TIES} LIMIT 15"),
        "named_matches",
    ),
    "r16_hidden_partners": sql(_hidden("nbr"), "named_matches", "pairs"),
    "r16_hidden_partners_by_name": sql(_hidden("e.name"), "named_matches", "pairs"),
    "r17_revenue_at_risk": sql(
        f"SELECT banked_id, banked_name, unbanked_id, unbanked_name, confidence, {r('coalesce(v, 0)', 0)} AS hidden_volume FROM named_matches "
        "LEFT JOIN (SELECT id, sum(amount) AS v FROM neighbours GROUP BY 1) ON id = unbanked_id WHERE confidence >= 0.6 "
        "ORDER BY coalesce(v, 0) DESC, banked_id, unbanked_id LIMIT 20",
        "named_matches", "neighbours",
    ),
    "r18_match_network": sql(
        _network(f"SELECT * FROM matches WHERE confidence >= 0.7 ORDER BY confidence {MATCH_TIES} LIMIT 1", ""), "matches", "neighbours"
    ),
    "r18_match_network_outer": sql(
        _network(f"SELECT * FROM matches WHERE confidence >= 0.65 ORDER BY confidence {MATCH_TIES} LIMIT 10", "LEFT"), "matches", "neighbours"
    ),
    "r19_edges_of": sql("SELECT src, dst, tx_count FROM trades WHERE src IN (0, 1)", "trades"),
    "r20_evaluate_matches": sql(
        f"SELECT threshold, tp AS true_matches, fp AS false_matches, n - tp AS missed, {r('CAST(tp AS DOUBLE) / CAST(nullif(tp + fp, 0) AS DOUBLE)', 4)} AS precision, "
        f"{r('CAST(tp AS DOUBLE) / CAST(n AS DOUBLE)', 4)} AS recall FROM (SELECT threshold, count(*) FILTER (WHERE t.banked_id IS NOT NULL AND confidence >= threshold) AS tp, "
        "count(*) FILTER (WHERE t.banked_id IS NULL AND confidence >= threshold) AS fp, (SELECT count(*) FROM truth) AS n "
        "FROM matches m LEFT JOIN truth t ON t.banked_id = m.banked_id AND t.unbanked_id = m.unbanked_id, "
        "(SELECT unnest([CAST(0.45 AS DOUBLE), 0.6, 0.7, 0.8]) AS threshold) GROUP BY 1)",
        "matches", "truth",
    ),
    "x1_peer_recommendations_pct": sql(
        f"SELECT * EXCLUDE (members), {r('CAST(peers_holding * 100 AS DOUBLE) / CAST(members AS DOUBLE)', 1)} AS peer_adoption_pct FROM ("
        + _peer_holders(", (SELECT count(*) FROM entities x WHERE x.sic_code = any_value(t.sic_code)) AS members")
        + "t.entity_id = 0 GROUP BY 1, 2, 3, 4)",
        "entities", "holdings", "products",
    ),
    "x2_peer_recommendations": sql(_peer_holders("") + "t.entity_id = 0 GROUP BY 1, 2, 3, 4", "entities", "holdings", "products"),
    "x2_peer_recommendations_all": sql(_peer_holders("") + "t.status = 'banked' GROUP BY 1, 2, 3, 4", "entities", "holdings", "products"),
    "x3_segment_penetration": sql(
        f"SELECT *, {r('CAST(holders * 100 AS DOUBLE) / CAST(segment_total AS DOUBLE)', 1)} AS penetration_pct FROM ("
        "SELECT e.segment, p.product_id, p.name AS product, p.pillar, count(DISTINCT e.entity_id) AS holders, any_value(n) AS segment_total "
        "FROM entities e JOIN holdings h USING (entity_id) JOIN products p USING (product_id) "
        "JOIN (SELECT segment, count(*) AS n FROM entities WHERE status = 'banked' GROUP BY 1) s ON s.segment = e.segment GROUP BY 1, 2, 3, 4)",
        "entities", "holdings", "products",
    ),
    "x4_current_products": sql(
        "SELECT product_id, name AS product, pillar, monthly_fee, since FROM holdings JOIN products USING (product_id) WHERE entity_id = 0", "holdings", "products"
    ),
    "x5_compare_with_peers": sql(
        "SELECT side, s.entity_id, s.name, product_id, p.name AS product, pillar FROM (SELECT 'target' AS side, entity_id, name FROM entities WHERE entity_id = 0 "
        "UNION ALL (SELECT 'peer', entity_id, name FROM entities WHERE status = 'banked' AND entity_id <> 0 AND sic_code = 0 "
        "ORDER BY md5(entity_id || ':0'), entity_id LIMIT 4)) s JOIN holdings h ON h.entity_id = s.entity_id JOIN products p USING (product_id)",
        "entities", "holdings", "products",
    ),
    "x6_similar_peer_products": sql(
        f"SELECT e.entity_id, e.name, {r('similarity', 3)} AS similarity, array_to_string(list_sort(own), '; ') AS target_products, "
        "array_to_string(list_sort(coalesce(theirs, [])), '; ') AS peer_products, "
        "array_to_string(list_sort(list_filter(coalesce(theirs, []), lambda x: NOT list_contains(own, x))), '; ') AS recommended "
        "FROM (SELECT DISTINCT CASE WHEN src = {t} THEN dst ELSE src END AS peer, similarity FROM alike WHERE src = {t} OR dst = {t}) "
        "JOIN entities e ON e.entity_id = peer CROSS JOIN (SELECT coalesce(list(DISTINCT name), []) AS own FROM holdings JOIN products USING (product_id) WHERE entity_id = {t}) "
        "LEFT JOIN (SELECT entity_id AS pid, list(DISTINCT name) AS theirs FROM holdings JOIN products USING (product_id) GROUP BY 1) ON pid = peer".replace("{t}", "66"),
        "alike", "entities", "holdings", "products",
    ),
    "c1_collateral_grade": sql(_collateral((10, 3, 5, 2), "ORDER BY inflow DESC, dst LIMIT 30"), "inflow", "transactions"),
    "c1_collateral_grade_all": sql(_collateral((18, 3, 14, 2), ""), "inflow", "transactions"),
    "c2_concentration": sql(
        "SELECT entity_id, e.name, payer_id, p.name AS payer_name, "
        f"{r('largest', 2)} AS largest_amount, {r('inflow', 2)} AS total_inflow, {r('CAST(largest * 100 AS DOUBLE) / CAST(inflow AS DOUBLE)', 1)} AS concentration_pct "
        "FROM (SELECT dst, src AS payer_id, amount AS largest, sum(amount) OVER (PARTITION BY dst) AS inflow FROM trades "
        "QUALIFY row_number() OVER (PARTITION BY dst ORDER BY amount DESC, src) = 1) JOIN entities e ON dst = e.entity_id AND e.status = 'banked' "
        "JOIN (SELECT entity_id AS pid, name FROM entities) p ON pid = payer_id ORDER BY concentration_pct DESC, dst LIMIT 20",
        "trades", "entities",
    ),
    "c3_stability": sql(_stability(10, 30, f"ORDER BY {r('std_days', 6)}, dst LIMIT 20"), "trades", "entities"),
    "c3_stability_all": sql(_stability(150, 300, ""), "trades", "entities"),
    "c4_customer_profile": sql(
        "SELECT e.entity_id, e.name, segment, region, turnover, risk_score, i.name AS industry, sector, "
        "(SELECT count(*) FROM accounts WHERE entity_id = 0) AS accounts, (SELECT count(*) FROM holdings WHERE entity_id = 0) AS products, "
        "(SELECT coalesce(array_to_string(list_sort(list(DISTINCT name)), '; '), '') FROM holdings JOIN products USING (product_id) WHERE entity_id = 0) AS product_names, "
        "(SELECT count(DISTINCT nbr) FROM neighbours WHERE id = 0) AS trading_partners FROM entities e LEFT JOIN industries i USING (sic_code) WHERE e.entity_id = 0",
        "entities", "industries", "accounts", "holdings", "products", "neighbours",
    ),
    "c5_diversified_example": sql(_into_largest("payers >= 10"), "inflow"),
    "c6_concentrated_example": sql(_into_largest("payers <= 9 AND inflow > 100000"), "inflow"),
    "g0_project_graph": sql("SELECT id AS src, nbr AS dst, CAST(amount AS DOUBLE) AS amount, tx_count FROM neighbours", "neighbours"),
    "g1_pagerank": sql(f"SELECT id AS entity_id, {r('rank', 6)} AS page_rank FROM rank_20", "rank_20"),
    "g2_louvain": sql("SELECT * FROM communities", "communities"),
    "g3_betweenness": sql(f"SELECT entity_id, {r('betweenness', 2)} AS betweenness FROM between", "between"),
    "g3_betweenness_pivots": sql(
        f"SELECT entity_id, {r(f'betweenness * (SELECT CAST(count(*) AS DOUBLE) FROM entities) / {PIVOTS}', 2)} AS betweenness FROM p_between", "p_between"
    ),
    "g4_node_similarity": sql(f"SELECT src, dst, {r('similarity', 6)} AS similarity FROM alike", "alike"),
    "g4_node_similarity_hubs": sql(f"SELECT src, dst, {r('similarity', 6)} AS similarity FROM alike", "alike"),
    "g5_communities_bridged": sql(
        f"SELECT entity_id, name, status, own_community, connected_community, communities_bridged, {r('betweenness', 2)} AS betweenness FROM ("
        "SELECT b.entity_id, community_id AS own_community, betweenness, spans AS communities_bridged FROM between b JOIN communities USING (entity_id) "
        "JOIN (SELECT id, count(DISTINCT c.community_id) AS spans FROM neighbours JOIN communities c ON c.entity_id = nbr GROUP BY 1 HAVING count(DISTINCT c.community_id) >= 2) ON id = b.entity_id "
        f"ORDER BY spans DESC, {r('betweenness', 2)} DESC, b.entity_id LIMIT 15) "
        "JOIN (SELECT DISTINCT id AS entity_id, community_id AS connected_community FROM neighbours JOIN communities ON entity_id = nbr) USING (entity_id) JOIN entities USING (entity_id)",
        "between", "communities", "neighbours",
    ),
    "g7_community_summary": sql(
        "SELECT community_id, count(*) AS size, count(*) FILTER (status = 'banked') AS banked, count(*) FILTER (status = 'unbanked') AS unbanked, "
        f"{r("CAST(count(*) FILTER (status = 'unbanked') * 100 AS DOUBLE) / CAST(count(*) AS DOUBLE)", 1)} AS unbanked_pct "
        "FROM communities JOIN entities USING (entity_id) GROUP BY 1 ORDER BY size DESC, community_id LIMIT 15",
        "communities",
    ),
    "g8_dominant_sector": sql(
        "SELECT community_id, sector AS dominant_sector, n AS entity_count FROM (SELECT community_id, sector, count(*) AS n FROM communities JOIN entities USING (entity_id) "
        "JOIN industries USING (sic_code) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY community_id ORDER BY n DESC, sector) = 1 "
        "ORDER BY n DESC, community_id LIMIT 15",
        "communities", "industries",
    ),
    "g9_top_brokers": sql(
        f"SELECT entity_id, name, status, community_id, {r('betweenness', 2)} AS betweenness, {r('rank', 6)} AS page_rank FROM between JOIN entities USING (entity_id) "
        f"JOIN communities USING (entity_id) JOIN rank_20 ON rank_20.id = entity_id ORDER BY {r('betweenness', 2)} DESC, entity_id LIMIT 15",
        "between", "communities", "rank_20",
    ),
    "g6_top_pagerank": sql(
        f"SELECT entity_id, name, status, region, {r('rank', 6)} AS page_rank FROM rank_20 JOIN entities ON id = entity_id ORDER BY page_rank DESC, entity_id LIMIT 15", "rank_20"
    ),
    "g6_top_unbanked_pagerank": sql(
        f"SELECT entity_id, name, status, region, {r('rank', 6)} AS page_rank FROM rank_20 JOIN entities ON id = entity_id WHERE status = 'unbanked' "
        "ORDER BY page_rank DESC, entity_id LIMIT 10",
        "rank_20",
    ),
    "g10_top_similar_pairs": sql(
        "SELECT src, a.name AS src_name, a.segment AS src_segment, dst, b.name AS dst_name, b.segment AS dst_segment, "
        f"{r('s.similarity', 3)} AS similarity FROM alike s JOIN entities a ON src = a.entity_id JOIN entities b ON dst = b.entity_id "
        "WHERE a.status = 'banked' AND b.status = 'banked' ORDER BY s.similarity DESC, src, dst LIMIT 20",
        "alike", "entities",
    ),
    "m1_account_fan_out": sql(
        "SELECT a.account_id, a.entity_id AS source_id, name AS source_name, risk_score AS source_risk, segment AS source_segment, region AS source_region, "
        f"destinations, tx_count, {r('sent', 2)} AS total_sent, {r('CAST(sent AS DOUBLE) / CAST(destinations AS DOUBLE)', 2)} AS avg_per_destination FROM ("
        "SELECT s, count(DISTINCT d) AS destinations, count(*) AS tx_count, sum(amount) AS sent FROM legs GROUP BY s HAVING count(DISTINCT d) >= 4 "
        "ORDER BY destinations DESC, sent DESC, s LIMIT 15) JOIN owners a ON a.account_id = s",
        "legs", "owners",
    ),
    "m2_layering": sql(
        _layering(f"SELECT t1.s, t2.d, count(DISTINCT t1.d) AS intermediaries, sum(t1.amount) AS routed {LAYER_PAIRS} GROUP BY 1, 2 HAVING count(DISTINCT t1.d) >= 2"),
        "legs", "owners",
    ),
    "m2_layering_three": sql(
        _layering(f"SELECT t1.s, t2.d, count(DISTINCT t1.d) AS intermediaries, sum(t1.amount) AS routed {LAYER_PAIRS} GROUP BY 1, 2 HAVING count(DISTINCT t1.d) >= 3"),
        "legs", "owners",
    ),
    "m2_layering_dedupe": sql(
        _layering(
            "SELECT s, d, count(DISTINCT mid) AS intermediaries, sum(amount) AS routed FROM ("
            f"SELECT DISTINCT t1.s, t2.d, t1.d AS mid, t1.rid, t1.amount {LAYER_PAIRS.replace('legs t1', '(SELECT *, row_number() OVER () AS rid FROM legs) t1')}"
            ") GROUP BY 1, 2 HAVING count(DISTINCT mid) >= 2 ORDER BY intermediaries DESC, routed DESC, s, d LIMIT 15"
        ),
        "legs", "owners",
    ),
    "s1_find_entities": sql(
        f"SELECT entity_id, name, region, segment, status FROM entities WHERE {SEARCH.format('bolt Brand 7')} ORDER BY entity_id LIMIT 10", "entities"
    ),
    "s2_partners_of": sql(
        "SELECT id, e.name, nbr AS partner_id, p.name AS partner_name, outgoing, CAST(amount AS DOUBLE) AS amount, tx_count "
        f"FROM (SELECT * FROM entities WHERE {SEARCH.format('red bolt Brand 6 ')}) e JOIN neighbours ON id = e.entity_id JOIN entities p ON nbr = p.entity_id",
        "entities", "neighbours",
    ),
    "s3_products_for": sql(
        "SELECT e.entity_id, e.name, product_id, p.name AS product, pillar, since "
        f"FROM (SELECT * FROM entities WHERE {SEARCH.format('bolt Brand 6')}) e JOIN holdings USING (entity_id) JOIN products p USING (product_id)",
        "entities", "holdings", "products",
    ),
    "s4_deep_dive_rows": sql(
        "SELECT e.entity_id, e.name, i.name AS industry, p.name AS product, nbr AS partner_id, q.name AS partner_name, outgoing, CAST(amount AS DOUBLE) AS amount "
        f"FROM (SELECT * FROM entities WHERE {SEARCH.format('bolt Brand 6')}) e LEFT JOIN industries i USING (sic_code) "
        "LEFT JOIN holdings h ON h.entity_id = e.entity_id LEFT JOIN products p ON p.product_id = h.product_id LEFT JOIN neighbours ON id = e.entity_id "
        "LEFT JOIN entities q ON q.entity_id = nbr ORDER BY e.entity_id, h.product_id NULLS LAST, nbr NULLS LAST, outgoing LIMIT 50",
        "entities", "industries", "holdings", "products", "neighbours",
    ),
    "s5_filter_entities": sql(
        "SELECT entity_id, name, region, segment, status FROM entities WHERE status = 'banked' AND segment = 'MACHINERY' AND region = 'ASIA' ORDER BY entity_id LIMIT 5", "entities"
    ),
    "s6_graph_counts": sql("SELECT * FROM counts", "counts"),
    "s7_graph_summary": sql("SELECT kind, '(all)' AS label, CAST(sum(count) AS BIGINT) AS count FROM counts GROUP BY 1 UNION ALL SELECT * FROM counts", "counts"),
    "s8_sample_nodes": sql("SELECT * FROM entities ORDER BY entity_id LIMIT 5", "entities"),
    "s8_sample_edges": sql(
        "SELECT 'Customer' AS from_label, 'TRADES_WITH' AS rel_type, 'Customer' AS to_label, src, dst, CAST(amount AS DOUBLE) AS amount, tx_count, avg_interval "
        "FROM trades ORDER BY src, dst LIMIT 10",
        "trades",
    ),
    "st1_stream_trades": sql(FINAL_TRADES, "trades"),
}


def _distribution(view: str, col: str, digits: int = 6) -> str:
    value = r(col, digits)
    shares = ", ".join(f"quantile_disc(value, {q}) AS {n}" for n, q in (("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)))
    return sql(
        f"SELECT count(*) AS n, min(value) AS min, max(value) AS max, {r('avg(value)', 4)} AS mean, {shares} FROM (SELECT {value} AS value FROM {view})", view
    )


ORACLES["g11_pagerank_distribution"] = _distribution("rank_20", "rank")
ORACLES["g11_betweenness_distribution"] = _distribution("between", "betweenness", 2)
ORACLES["g11_modularities"] = sql(
    " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS level, {r('q', 6)} AS modularity FROM com_{k}_quality WHERE ok" for k in range(1, COMMUNITY_LEVELS + 1)),
    f"com_{COMMUNITY_LEVELS}_quality",
)
ORACLES["a8_upsert_stored"] = ORACLES["a8_upsert"]
ORACLES["e2_ecosystem_size_hubs"] = ORACLES["e2_ecosystem_size"]
ORACLES["st1_stream_compacted"] = ORACLES["st1_stream_trades"]
ORACLES["g11_similarity_distribution"] = _distribution("alike", "similarity")
