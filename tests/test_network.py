import itertools
from collections import defaultdict, deque

import pytest
from helpers import entities, partner_sets, random_edges, rows, trades

from tradeweave.functions.hubs import split_hubs
from tradeweave.operators.ecosystem import two_hop_counts
from tradeweave.operators.edges import neighbour_pairs
from tradeweave.operators.network import reports
from tradeweave.operators.network.betweenness import betweenness
from tradeweave.operators.network.louvain import louvain, modularity
from tradeweave.operators.network.pagerank import pagerank
from tradeweave.operators.network.paths import shortest_path
from tradeweave.operators.network.projection import project_graph
from tradeweave.operators.network.similarity import node_similarity

N = 24
GRAPHS = [random_edges(N, 30, 1), random_edges(N, 20, 2, hubs=(0,)), random_edges(N, 12, 3, hubs=(0, 5, 9))]


@pytest.mark.parametrize("edges", GRAPHS)
@pytest.mark.parametrize("hub_degree", [3, 1000])
def test_two_hop_counts(spark, edges, hub_degree):
    sets = partner_sets(edges)
    want = []
    for node in sets:
        reach = sets[node].union(*(sets[m] for m in sets[node])) - {node}
        want.append((node, len(reach)))
    starts = entities(spark, {i: {} for i in range(N)}).selectExpr("entity_id as id")
    assert rows(two_hop_counts(trades(spark, edges), starts, hub_degree), "id", "ecosystem_size") == sorted(want)


@pytest.mark.parametrize("edges", [*GRAPHS, [(0, i) for i in range(1, N)] + [(1, 2), (30, 31)]])
@pytest.mark.parametrize("hub_degree, cutoff, top_k", [(2, 0.3, 5), (4, 0.2, 2), (1000, 0.3, 5)])
def test_node_similarity(spark, edges, hub_degree, cutoff, top_k):
    sets = partner_sets(edges)
    want = []
    for a in sets:
        scored = []
        for b in sets:
            value = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if a != b and value >= cutoff:
                scored.append((-value, b))
        want += [(a, b, -v) for v, b in sorted(scored)[:top_k]]
    found = node_similarity(neighbour_pairs(trades(spark, edges)), cutoff, top_k, hub_degree)
    assert rows(found, "src", "dst", "similarity") == sorted(want)


@pytest.mark.parametrize("edges", GRAPHS[1:])
@pytest.mark.parametrize("full, list_rows", [(1, 1000), (8, 2), (512, 1000)])
def test_reach_of_hubs(spark, edges, full, list_rows):
    """Bitmaps alone, lists alone and both; what few entities a hub has is not spelled out as a bitmap."""
    sets = partner_sets(edges)
    hubs = split_hubs(neighbour_pairs(trades(spark, edges)), 2)
    busy = {h for h in sets if len(sets[h]) > 2}
    found = hubs.classes.join(hubs.reach(full, list_rows), "hub_class")
    want = [(i, len(set().union(*(sets[h] for h in sets[i] & busy)))) for i in sets if sets[i] & busy]
    assert rows(found, "id", "reach") == sorted(want)


def brute_betweenness(sets, nodes):
    score = dict.fromkeys(nodes, 0.0)
    for s in sets:
        dist, paths, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in sets[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = defaultdict(float)
        for w in reversed(order):
            for v in sets[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w] / 2
    return score


@pytest.mark.parametrize("edges, batches, hub_degree", [(GRAPHS[0], 1, 1000), (GRAPHS[2], 7, 4)])
def test_betweenness(spark, edges, batches, hub_degree):
    want = brute_betweenness(partner_sets(edges), range(N + 1))
    nodes = entities(spark, {i: {} for i in range(N + 1)}).selectExpr("entity_id as id")
    pairs = neighbour_pairs(trades(spark, edges))
    found = {r.entity_id: r.betweenness for r in betweenness(nodes, pairs, batches=batches, hub_degree=hub_degree).collect()}
    assert found == pytest.approx(want)
    sampled = betweenness(nodes, pairs, sources=N + 1, hub_degree=hub_degree, rows_alive=(N + 1) * 9)
    assert {r.entity_id: r.betweenness for r in sampled.collect()} == pytest.approx(want)


def test_betweenness_without_edges(spark):
    nodes = entities(spark, {1: {}, 2: {}}).selectExpr("entity_id as id")
    pairs = neighbour_pairs(trades(spark, [(1, 2)]).limit(0))
    assert rows(betweenness(nodes, pairs), "entity_id", "betweenness") == [(1, 0.0), (2, 0.0)]


def brute_pagerank(weights, nodes, rounds, d=0.85):
    out = defaultdict(float)
    for (a, _), w in weights.items():
        out[a] += w
    rank = dict.fromkeys(nodes, 1 - d)
    for _ in range(rounds):
        new = dict.fromkeys(nodes, 1 - d)
        for (a, b), w in weights.items():
            new[b] += d * rank[a] * w / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("hub_degree, per_job, directed", [(1000, 5, False), (3, 2, False), (3, 7, True)])
def test_pagerank(spark, hub_degree, per_job, directed):
    edges = [(a, b, 10 + (a * 7 + b) % 5) for a, b in GRAPHS[1]]
    weights = defaultdict(float)
    for a, b, w in edges:
        weights[a, b] += w
        if not directed:
            weights[b, a] += w
    graph = project_graph(trades(spark, edges), entities(spark, {i: {} for i in range(N + 1)}), directed)
    result = pagerank(graph, iterations=9, rounds_per_job=per_job, hub_degree=hub_degree, tol=None)
    assert result.ran_iterations == 9 and not result.did_converge
    found = {r.entity_id: r.page_rank for r in result.scores.collect()}
    assert found == pytest.approx(brute_pagerank(weights, range(N + 1), 9))


def test_pagerank_converges_to_node_count(spark):
    graph = project_graph(trades(spark, GRAPHS[0]), entities(spark, {i: {} for i in partner_sets(GRAPHS[0])}))
    result = pagerank(graph, iterations=200, rounds_per_job=5, tol=1e-2)
    assert result.did_converge and result.ran_iterations < 200
    total = sum(r.page_rank for r in result.scores.collect())
    assert total == pytest.approx(len(partner_sets(GRAPHS[0])), rel=5e-2)


def test_louvain_finds_cliques(spark):
    cliques = [range(0, 6), range(10, 16), range(20, 26)]
    edges = [(a, b, 50) for c in cliques for a, b in itertools.combinations(c, 2)] + [(0, 10, 1), (10, 20, 1)]
    nodes = {i: {} for c in cliques for i in c} | {99: {}}
    graph = project_graph(trades(spark, edges), entities(spark, nodes))
    result = louvain(graph, hub_degree=3)
    groups = defaultdict(set)
    for r in result.members.collect():
        groups[r.community_id].add(r.entity_id)
    assert sorted(map(sorted, groups.values())) == [list(range(0, 6)), list(range(10, 16)), list(range(20, 26)), [99]]
    assert result.community_count == 4
    assert result.modularities == sorted(result.modularities)
    assert modularity(result.members, graph) == pytest.approx(result.modularity)


@pytest.mark.parametrize("hub_degree", [3, 1000])
def test_louvain_communities_are_connected(spark, hub_degree):
    edges = [(a, b, 10 + (a * 7 + b) % 50) for a, b in random_edges(60, 150, 5)]
    found = {r.entity_id: r.community_id for r in louvain(project_graph(trades(spark, edges), entities(spark, {i: {} for i in range(60)})), hub_degree=hub_degree).members.collect()}
    near = partner_sets(edges)
    for name in set(found.values()):
        members = {i for i, c in found.items() if c == name}
        reached, queue = set(), [min(members)]
        while queue:
            at = queue.pop()
            if at not in reached:
                reached.add(at)
                queue += near.get(at, set()) & members
        assert reached == members


def test_louvain_beats_singletons_and_repeats(spark):
    graph = project_graph(trades(spark, GRAPHS[0]), entities(spark, {i: {} for i in range(N)}))
    first, second = louvain(graph), louvain(graph)
    alone = modularity(graph.nodes.selectExpr("id as entity_id", "id as community_id"), graph)
    assert first.modularity > alone
    assert rows(first.members, "entity_id", "community_id") == rows(second.members, "entity_id", "community_id")


def test_louvain_without_edges(spark):
    graph = project_graph(trades(spark, [(1, 2)]).limit(0), entities(spark, {1: {}, 2: {}}))
    assert louvain(graph).community_count == 2


@pytest.mark.parametrize("edges", GRAPHS)
def test_shortest_paths_from_both_ends(spark, edges):
    """Of the shortest paths the one whose nodes are smallest, going back from the end."""
    sets = partner_sets(edges)
    t, e = trades(spark, edges), entities(spark, {i: {} for i in range(N)})
    for a, b in [(1, 2), (3, 20), (7, 15), (22, 4)]:
        dist, queue = {a: 0}, deque([a])
        while queue:
            v = queue.popleft()
            for w in sets.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
        path = [b] if b in dist else []
        while path and path[-1] != a:
            path.append(min(w for w in sets[path[-1]] if dist[w] == dist[path[-1]] - 1))
        found = shortest_path(t, e, a, b).orderBy("step").collect()
        assert [r.entity_id for r in found] == path[::-1] and all(r.hops == len(path) - 1 for r in found)


def test_shortest_path(spark):
    t = trades(spark, [(1, 3), (1, 2), (4, 2), (4, 3), (5, 4), (7, 8)])
    e = entities(spark, {i: {} for i in range(1, 9)})
    found = shortest_path(t, e, 1, 5)
    assert rows(found, "hops", "step", "entity_id", "name") == [
        (3, 0, 1, "e1"), (3, 1, 2, "e2"), (3, 2, 4, "e4"), (3, 3, 5, "e5"),
    ]
    assert shortest_path(t, e, 1, 8).count() == 0
    assert shortest_path(t, e, 1, 5, max_hops=2).count() == 0
    assert rows(shortest_path(t, e, 1, 1), "hops", "entity_id") == [(0, 1)]
    assert shortest_path(t, e, 1, 77).count() == 0


def test_community_reports(spark):
    e = entities(spark, {1: {}, 2: {"status": "unbanked"}, 3: {"sic_code": 2}, 4: {"sic_code": 2}})
    sectors = spark.createDataFrame([(1, "i1", "A"), (2, "i2", "B")], "sic_code int, name string, sector string")
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8)], "entity_id long, community_id long")
    assert rows(reports.community_summary(e, groups), "community_id", "size", "banked", "unbanked", "unbanked_pct") == [
        (7, 3, 2, 1, 33.3), (8, 1, 1, 0, 0.0),
    ]
    assert rows(reports.dominant_sector(e, sectors, groups), "community_id", "dominant_sector", "entity_count") == [
        (7, "A", 2), (8, "B", 1),
    ]
    scores = groups.selectExpr("entity_id", "community_id", "cast(entity_id as double) as betweenness", "0.5D as page_rank")
    bridged = reports.communities_bridged(trades(spark, [(1, 2), (1, 4), (2, 3)]), e, scores)
    assert rows(bridged, "entity_id", "own_community", "connected_community", "communities_bridged") == [
        (1, 7, 7, 2), (1, 7, 8, 2),
    ]
    assert [r.entity_id for r in reports.top_brokers(e, scores, n=2).collect()] == [4, 3]
