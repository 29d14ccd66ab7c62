import math
import random

import duckdb
import pytest
from helpers import entities, partner_sets, random_edges, rows, trades
from pyspark.sql import functions as F

from tradeweave.functions.names import fuzzy_vocabulary, jaro_winkler_arrays
from tradeweave.operators.edges import neighbour_pairs
from tradeweave.operators.maintenance import delete_cascade, insert_if_absent, link_entities
from tradeweave.operators.resolution import blocking, reports, scoring, signals
from tradeweave.plans.graph import open_graph
from tradeweave.sources.files import inline_rows


def random_words(n, seed, letters="abcd", longest=9):
    pick = random.Random(seed)
    return ["".join(pick.choice(letters) for _ in range(pick.randrange(1, longest))) for _ in range(n)]


def test_jaro_winkler_agrees_with_sql():
    first, second = random_words(3000, 1, "abc de", 30), random_words(3000, 2, "abc de", 30)
    first[:3], second[:3] = ["same name", "x", "x" * 500], ["same name", "y", "x" * 400 + "y"]
    db = duckdb.connect()
    want = [db.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0] for a, b in zip(first, second)]
    assert jaro_winkler_arrays(first, second) == pytest.approx(want, abs=1e-12)


def test_jaro_winkler_scales_and_empty_names():
    a, b = ["metal works", "", "", "abc"], ["metal works (pty) ltd", "", "abc", "xyz"]
    standard = jaro_winkler_arrays(a, b)
    capped = jaro_winkler_arrays(a, b, "capped")
    plain = jaro_winkler_arrays(a, b, "none")
    assert standard[0] > capped[0] > plain[0]
    assert list(standard[1:]) == [1.0, 0.0, 0.0]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("max_edits", [0, 1, 2])
def test_fuzzy_vocabulary_finds_every_pair(spark, max_edits):
    left, right = set(random_words(60, 3)), set(random_words(80, 4))
    want = sorted(
        (a, b, edit_distance(a, b)) for a in left for b in right if edit_distance(a, b) <= max_edits
    )
    frame = lambda words: inline_rows(spark, [(w,) for w in words], "token string")
    found = fuzzy_vocabulary(frame(left), frame(right), max_edits)
    assert rows(found, "left_token", "right_token", "edits") == want


@pytest.mark.parametrize("n_tokens, min_score", [(2, 1.2), (2, 2.2), (1, 0.2)])
def test_blocking_scores_every_passing_pair(spark, n_tokens, min_score):
    pick = random.Random(5)
    common, rare = ["steel", "group"], random_words(25, 6, "klmno", 7)
    make = lambda: " ".join([pick.choice(common), pick.choice(rare), pick.choice(common + rare)])
    people = {i: {"name": make().title()} for i in range(40)}
    people |= {100 + i: {"name": f"({make()}) Ltd", "status": "unbanked"} for i in range(15)}
    banked = {i: set(p["name"].lower().split()) for i, p in people.items() if i < 100}
    df = {}
    for words in banked.values():
        for w in words:
            df[w] = df.get(w, 0) + 1
    want = []
    for u in range(100, 115):
        words = people[u]["name"].replace("(", "").replace(")", "").lower().split(" ")[:n_tokens]
        for b, have in banked.items():
            score = 0.0
            for q in words:
                close = [
                    math.log(1 + (len(banked) - df[w] + 0.5) / (df[w] + 0.5)) * (1 - edit_distance(q, w) / min(len(q), len(w)))
                    for w in have if edit_distance(q, w) <= 2
                ]
                score += max([0.0, *close])
            if score > min_score:
                want.append((u, b, pytest.approx(score, abs=2e-6)))
    found = blocking.block_candidates(entities(spark, people), n_tokens=n_tokens, min_score=min_score)
    assert want and rows(found, "unbanked_id", "banked_id", "block_score") == sorted(want)


def test_equal_names_are_candidates_however_common(spark):
    people = {1: {"name": "Alpha Foods"}, 2: {"name": "Alpha Foods"}, 9: {"name": "ALPHA  FOODS", "status": "unbanked"}}
    found = blocking.block_candidates(entities(spark, people))
    assert rows(found, "unbanked_id", "banked_id") == [(9, 1), (9, 2)]
    one = blocking.block_candidates(entities(spark, {1: {"name": "Alpha"}, 9: {"name": "Alpha", "status": "unbanked"}}))
    assert rows(one, "unbanked_id", "banked_id") == [(9, 1)]


def test_blocking_score_keeps_as_the_table_grows(spark):
    """A thousand times the names with the same word shares: every true pair keeps its score."""
    words = random_words(40, 12, "pqrst", 8)
    names = [f"{words[i % 40]} {words[(7 * i + 3) % 40]}" for i in range(40)]
    twins = spark.createDataFrame([(10_000_001 + i, f"{n} ltd", "unbanked") for i, n in enumerate(names[:5])], "entity_id long, name string, status string")
    small = spark.createDataFrame([(i, n, "banked") for i, n in enumerate(names)], "entity_id long, name string, status string")
    large = small.selectExpr("explode(sequence(0, 999)) AS k", "*").selectExpr("entity_id + 40 * k AS entity_id", "name", "status")
    few = blocking.block_candidates(small.unionByName(twins), min_score=3.0)
    many = blocking.block_candidates(large.unionByName(twins), min_score=3.0).selectExpr("unbanked_id", "banked_id % 40 AS banked_id").distinct()
    truth = {(10_000_001 + i, i) for i in range(5)}
    assert truth <= set(rows(few, "unbanked_id", "banked_id")) and truth <= set(rows(many, "unbanked_id", "banked_id"))


def demo(spark):
    people = entities(spark, {
        1: {"name": "Aurora Demo Metal Works", "region": "North"},
        2: {"name": "Aurora Demo Metal Works (Pty) Ltd", "region": "North", "status": "unbanked"},
        3: {}, 4: {}, 5: {},
    })
    edges = trades(spark, [(1, p, 250000, 8, 12.0) for p in (3, 4, 5)] + [(2, p, 180000, 6, 15.0) for p in (3, 4, 5)])
    return people, edges


def test_demo_pair(spark):
    people, edges = demo(spark)
    found = scoring.match_entities(people, edges, min_score=0.0).first()
    name = jaro_winkler_arrays(["aurora demo metal works (pty) ltd"], ["aurora demo metal works"])[0]
    assert (found.banked_id, found.unbanked_id, found.trading_sim) == (1, 2, 1.0)
    assert found.confidence == round(0.60 + 0.40 * name, 4)
    direct = scoring.score_named_pair(people, edges, 1, 2).first()
    assert direct == found
    assert rows(reports.edges_of(edges, [1, 2]), "src", "dst") == [(a, b) for a in (1, 2) for b in (3, 4, 5)]


def test_demo_links(spark):
    people, edges = demo(spark)
    linked, count = link_entities(people, inline_rows(spark, [(i,) for i in (1, 2, 3, 4, 5, 77)], "entity_id long"), 9998)
    assert count.first().customers_linked == 5
    assert linked.where("sic_code = 9998").count() == 5
    again = insert_if_absent(edges, edges.selectExpr("src", "dst", "cast(0 as decimal(28,2)) amount", "tx_count", "avg_interval"), ["src", "dst"])
    assert rows(again, "src", "dst", "amount") == rows(edges, "src", "dst", "amount")
    left, kept = delete_cascade(people, {"trades": (edges, ["src", "dst"])}, ["1", "3"])
    assert rows(left, "entity_id") == [(2,), (4,), (5,)]
    assert rows(kept["trades"], "src", "dst") == [(2, 4), (2, 5)]


def test_unknown_attributes_do_not_match(spark):
    people = entities(spark, {1: {"sic_code": None, "region": None}, 2: {"status": "unbanked", "sic_code": None, "region": None}})
    pair = inline_rows(spark, [(1, 2)], "banked_id long, unbanked_id long")
    assert signals.industry_match(pair, people).first().industry_sim == 0.0
    assert signals.region_match(pair, people).first().region_sim == 0.0
    unfiltered = scoring.score_named_pair(people, trades(spark, [(3, 4)]), 1, 2, min_conf=None).first()
    assert (unfiltered.industry_sim, unfiltered.region_sim, unfiltered.trading_sim) == (0.0, 0.0, 0.0)


def test_overlap_with_a_hub(spark):
    edges = random_edges(20, 15, 8, hubs=(0, 1))
    sets = partner_sets(edges)
    pairs = [(a, b) for a in range(10) for b in range(10, 20)] + [(0, 1), (50, 51)]
    found = signals.trading_overlap(inline_rows(spark, pairs, "banked_id long, unbanked_id long"), trades(spark, edges))
    none = set()
    want = []
    for a, b in pairs:
        joint = sets.get(a, none) | sets.get(b, none)
        want.append((a, b, len(sets.get(a, none) & sets.get(b, none)) / len(joint) if joint else 0.0))
    assert rows(found, "banked_id", "unbanked_id", "trading_sim") == sorted(want)


def test_confidence_edges(spark):
    # Only the name counts here, so confidence = name_sim.
    weights = {"name_sim": 1.0, "industry_sim": 0.0, "region_sim": 0.0, "trading_sim": 0.0}
    values = [0.44999, 0.45, 0.69994, 0.69996, 0.70]
    given = inline_rows(spark, [(i, 9, v, 0.0, 0.0, 0.0) for i, v in enumerate(values)],
                        "banked_id long, unbanked_id long, name_sim double, industry_sim double, region_sim double, trading_sim double")
    found = scoring.match_confidence(given, weights)
    assert rows(found, "banked_id", "confidence") == [(1, 0.45), (2, 0.6999), (3, 0.7), (4, 0.7)]
    people = entities(spark, {i: {} for i in range(5)} | {9: {"status": "unbanked"}})
    assert rows(reports.high_confidence(found, people), "banked_id") == [(3,), (4,)]
    assert rows(reports.review_queue(found, people), "banked_id") == [(1,), (2,)]


MATCH = "banked_id long, unbanked_id long, confidence double, name_sim double, industry_sim double, region_sim double, trading_sim double"


def test_business_impact(spark):
    people = entities(spark, {1: {}, 2: {}, 3: {}, 4: {}} | {9: {"status": "unbanked"}, 8: {"status": "unbanked"}})
    matches = inline_rows(spark, [(1, 9, 0.9, 1.0, 1.0, 1.0, 0.1), (2, 8, 0.8, 1.0, 1.0, 1.0, 0.0)], MATCH)
    # 9 trades with 1 itself, with 2 (also a partner of 1) and twice with 3; 8 does not trade.
    edges = trades(spark, [(9, 1, 5), (9, 2, 7), (9, 3, 11), (3, 9, 13), (1, 2, 1)])
    hidden = reports.hidden_partners(matches, edges, people)
    assert rows(hidden, "banked_id", "new_partners", "sample_partners") == [(1, 2, "e1; e3"), (2, 0, "")]
    assert rows(reports.revenue_at_risk(matches, edges, people), "unbanked_id", "hidden_volume") == [(8, 0.0), (9, 36.0)]
    assert reports.match_network(matches, edges, k=2).select("unbanked_id").distinct().count() == 1
    outer = reports.match_network(matches, edges, k=2, outer=True)
    assert outer.where("unbanked_id = 8 and side = 'unbanked'").first().partner_id is None


def test_evaluation(spark):
    matches = inline_rows(spark, [(1, 9, 0.9, 1.0, 1.0, 1.0, 0.1), (2, 8, 0.5, 1.0, 1.0, 1.0, 0.0)], MATCH)
    truth = inline_rows(spark, [(1, 9), (3, 7)], "banked_id long, unbanked_id long")
    found = reports.evaluate_matches(matches, truth, [0.45, 0.95])
    assert rows(found, "threshold", "true_matches", "false_matches", "missed") == [(0.45, 1, 1, 1), (0.95, 0, 0, 2)]
    assert found.orderBy("threshold").first().precision == 0.5
    assert found.where("threshold = 0.95").first().precision is None


def test_match_pruning_loses_nothing(spark):
    pick = random.Random(11)
    words = random_words(6, 12, "pqrst", 8)
    people = {i: {"name": " ".join(pick.sample(words, 2)), "region": pick.choice("XY"), "sic_code": pick.randrange(3)} for i in range(30)}
    people |= {100 + i: {"name": " ".join(pick.sample(words, 2)), "region": pick.choice("XY"), "sic_code": pick.randrange(3), "status": "unbanked"} for i in range(10)}
    edges = trades(spark, [(a if a < 30 else a + 70, b if b < 30 else b + 70) for a, b in random_edges(40, 120, 13)])
    table = entities(spark, people)
    candidates = blocking.block_candidates(table, min_score=0.1)
    full = scoring.score_pairs(candidates, table, edges, min_conf=None)
    kept = scoring.score_pairs(candidates, table, edges)
    assert rows(kept, "banked_id", "unbanked_id", "confidence") == [
        r for r in rows(full, "banked_id", "unbanked_id", "confidence") if r[2] >= 0.45
    ]


@pytest.mark.parametrize("weights, min_conf", [
    (scoring.WEIGHTS, 0.45), (scoring.WEIGHTS, 0.3), (scoring.WEIGHTS, 0.7), (scoring.WEIGHTS, 0.9),
    ({"name_sim": 0.2, "industry_sim": 0.1, "region_sim": 0.1, "trading_sim": 0.6}, 0.5),
])
def test_attainable_candidates_lose_no_match(spark, weights, min_conf):
    """Whatever else a pair needs, matches are those of all name candidates, and no pair outside those is made."""
    pick = random.Random(17)
    words = random_words(5, 12, "pqrst", 8) + ["-", "A-B"]
    name = lambda: " ".join(pick.sample(words, pick.choice([1, 2, 2, 3])))
    make = lambda status: {"name": pick.choice([name(), name(), None]), "region": pick.choice(["X", "Y", "Z", None]), "sic_code": pick.choice([1, 2, 3, None]), "status": status}
    table = entities(spark, {i: make("banked") for i in range(40)} | {100 + i: make("unbanked") for i in range(20)})
    edges = trades(spark, [(a if a < 40 else a + 60, b if b < 40 else b + 60) for a, b in random_edges(60, 200, 19, hubs=(0, 45))])
    every = blocking.block_candidates(table, min_score=0.1)
    found = blocking.attainable_candidates(table, neighbour_pairs(edges), weights, min_conf, min_score=0.1)
    assert set(rows(found, "unbanked_id", "banked_id")) <= set(rows(every, "unbanked_id", "banked_id"))
    want = scoring.score_pairs(every, table, edges, weights, None)
    columns = ("banked_id", "unbanked_id", "confidence", "name_sim", "trading_sim")
    exact = {(r.banked_id, r.unbanked_id): sum(weights[k] * r[k] for k in weights) for r in want.collect() if r.name_sim is not None}
    kept = [r for r in rows(want.where("name_sim IS NOT NULL"), *columns) if exact[r[0], r[1]] >= min_conf - 1e-3]
    got = rows(scoring.match_entities(table, edges, weights, min_conf, min_score=0.1), *columns)
    assert set(got) <= set(kept) and {r for r in kept if exact[r[0], r[1]] >= min_conf + 1e-3} <= set(got)


def test_names_are_scored_once_and_bounded(spark):
    pick = random.Random(23)
    names = ["".join(pick.choice("abC ") for _ in range(pick.randrange(0, 9))) for _ in range(40)] + ["", "martha", "marhta", "abcdefgh"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names[::3]] + [(None, "x"), ("x", None)], "a string, b string")
    scored = signals.score_names(pairs, F.col("a"), F.col("b")).withColumn("bound", signals.name_bound(F.col("a"), F.col("b"))).collect()
    assert len(scored) == len(names) * len(names[::3]) + 2
    for r in scored:
        if r.a is None or r.b is None:
            assert r.name_sim is None
        else:
            assert r.name_sim == pytest.approx(jaro_winkler_arrays([r.a], [r.b])[0]) and r.name_sim <= r.bound + 1e-9


def test_rows_made_from_lists_are_not_broadcast(spark):
    """The planner takes a list for one word; words and pairs of words of all names must not go through the driver."""
    banked = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"])], "banked_id long, words array<string>")
    asked = spark.createDataFrame([("a", "b")], "word0 string, word1 string")
    plan = asked.join(blocking._word_pairs(banked), ["word0", "word1"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_planner_expects_compressed_files(spark):
    """A session that says more keeps its value."""
    name = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1.0")
        open_graph(spark, "/nowhere")
        assert float(spark.conf.get(name)) >= 20
        spark.conf.set(name, "50.0")
        open_graph(spark, "/nowhere")
        assert float(spark.conf.get(name)) == 50
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("members, twice, min_conf", [(3, (), 0.45), (2, (3, 8, 104), 0.3)])
def test_matches_of_kinds_are_those_of_their_entities(spark, monkeypatch, members, twice, min_conf):
    """Also where kinds fill several lists, and where several rows have an id."""
    monkeypatch.setattr(scoring, "MEMBERS", members)
    pick = random.Random(29)
    names = ["alpha steel", "Alpha Steel", "alpha steel works", "beta steel", "beta mills ltd", None]
    make = lambda status: {"name": pick.choice(names), "region": pick.choice(["X", "Y", None]), "sic_code": pick.choice([1, 2, None]), "status": status}
    people = {i: make("banked") for i in range(50)} | {100 + i: make("unbanked") for i in range(20)}
    table = entities(spark, people)
    if twice:
        table = table.unionByName(entities(spark, {i: people[i] | {"name": "alpha steel works", "region": "Y"} for i in twice}))
    edges = trades(spark, [(a if a < 50 else a + 50, b if b < 50 else b + 50) for a, b in random_edges(70, 150, 31, hubs=(0,))])
    partners = neighbour_pairs(edges)
    pairs = blocking.attainable_candidates(table, partners, scoring.WEIGHTS, min_conf, min_score=0.1)
    want = scoring.score_pairs(pairs, table, edges, min_conf=min_conf)
    columns = ("banked_id", "unbanked_id", "confidence", "name_sim", "industry_sim", "region_sim", "trading_sim")
    got = rows(scoring.match_entities(table, edges, min_conf=min_conf, min_score=0.1), *columns)
    assert len(got) > 50 and got == rows(want, *columns)


def test_equal_kinds_are_scored_once(spark, monkeypatch):
    """Six hundred pairs of entities are two pairs of names."""
    scored = []
    monkeypatch.setattr(scoring, "score_names", lambda found, *a: scored.append(found.count()) or signals.score_names(found, *a))
    table = entities(spark, {i: {"name": "alpha steel"} for i in range(30)} | {100 + i: {"name": ["alpha steel ltd", "alpha steel co"][i % 2], "status": "unbanked"} for i in range(20)})
    found = scoring.match_entities(table, trades(spark, [(0, 100), (1, 0), (1, 101)]), min_score=0.0)
    assert found.count() == 600 and sum(scored) == 2
