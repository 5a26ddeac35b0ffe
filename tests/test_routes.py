"""H2: delta buckets, chains and hubs against networkx-like brute force in Python."""

import heapq
import random

import pytest

from prepark.operators import routes as H


def brute(edges, origin, destination):
    """(length, stops) by Dijkstra over (weight, hops)."""
    out = {}
    for s, d, w in edges:
        out.setdefault(s, []).append((d, w))
    best, heap = {}, [(0.0, 0, origin)]
    while heap:
        dist, hops, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = (dist, hops)
        for d, w in out.get(node, []):
            if d not in best:
                heapq.heappush(heap, (dist + w, hops + 1, d))
    return best.get(destination)


def route(spark, edges, origin, destination, **kw):
    graph = H.build_graph(spark.createDataFrame(edges, "source string, target string, weight double"))
    return H.shortest_route(graph, origin, destination, **kw).first()


def check(spark, edges, origin, destination, **kw):
    weight = {}
    for s, d, w in edges:
        weight[s, d] = w
    got = route(spark, edges, origin, destination, **kw)
    length, stops = brute([(s, d, w) for (s, d), w in weight.items()], origin, destination)
    assert got.length == pytest.approx(length)
    assert got.path[0] == origin and got.path[-1] == destination
    assert sum(weight[a, b] for a, b in zip(got.path, got.path[1:])) == pytest.approx(length)
    assert len(got.path) == stops + 1
    return got


@pytest.mark.parametrize("delta", [12.0, None])
def test_random_graphs(spark, delta):
    rng = random.Random(5)
    edges = list({(f"n{a}", f"n{b}"): (f"n{a}", f"n{b}", float(rng.randrange(1, 30))) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(160))
                  if a != b}.values())
    check(spark, edges, "n1", "n2", delta=delta)


def test_ties_and_zero_weights(spark):
    edges = [("a", "b", 0.0), ("b", "a", 0.0), ("b", "c", 1.0), ("a", "x", 1.0), ("x", "c", 0.0), ("a", "c", 1.0), ("c", "z", 2.0), ("b", "z", 3.0), ("a", "y", 2.0), ("y", "z", 1.0)]
    got = check(spark, edges, "a", "z")
    assert got.path == ["a", "b", "z"]  # two stops by b, c or y: the smallest before the end


def test_chains_are_shortened(spark, monkeypatch):
    monkeypatch.setattr(H, "PASSING_NODES", 3)
    edges = []
    for k in range(60):  # a road in both directions, with side roads that end, and a ring apart
        edges += [(f"r{k}", f"r{k + 1}", 1.0 + k % 3), (f"r{k + 1}", f"r{k}", 1.0)]
        if k % 10 == 5:
            edges += [(f"r{k}", f"s{k}", 1.0), (f"s{k}", f"t{k}", 1.0), (f"t{k}", f"s{k}", 1.0)]
    edges += [(f"q{k}", f"q{(k + 1) % 5}", 1.0) for k in range(5)]
    edges += [("r5", "j1", 0.5), ("j1", "j2", 0.5), ("j2", "r15", 0.5), ("r3", "r45", 200.0)]
    got = check(spark, edges, "r0", "r60")
    assert "j1" in got.path
    assert check(spark, edges, "r33", "r2").path[1] == "r32"
    with pytest.raises(ValueError):
        route(spark, edges, "r0", "q1")


def test_a_long_chain_ends(spark):
    n = 100_000
    graph = spark.range(n).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst", "cast(id % 7 as double) as weight")
    got = H.shortest_route(graph, 0, n).first()
    assert got.path == [str(k) for k in range(n + 1)] and got.length == sum(k % 7 for k in range(n))


def test_a_hub_is_dealt_over_keys(spark, monkeypatch):
    n = 300_000
    spokes = spark.range(n).selectExpr("'hub' as src", "concat('m', id) as dst", "cast(1 + id % 5 as double) as weight")
    back = spark.range(n).selectExpr("concat('m', id) as src", "concat('n', id % 1000) as dst", "1.0D as weight")
    more = spark.range(1000).selectExpr("concat('n', id) as src", "concat('n', (id + 1) % 1000) as dst", "1.0D as weight")
    far = spark.range(1000).selectExpr("concat('n', id) as src", "'end' as dst", "cast(id + 1 as double) as weight")
    graph = spots = spokes.unionByName(back).unionByName(more).unionByName(far)
    assert spots.count() == 2 * n + 2000
    salted, hubs = H._salted(graph)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 3)]
    assert {r["salt"] for r in salted.filter("src = 'hub'").select("salt").distinct().collect()} == {0, 1, 2}
    monkeypatch.setattr(H, "BROADCAST_BYTES", 0)  # every join by shuffle
    got = H.shortest_route(graph, "hub", "end").first()
    assert got.path == ["hub", "m0", "n0", "end"] and got.length == 3.0


def test_rounds_carry_no_path(spark):
    """What a round writes are rows of a node and its predecessor."""
    edges = [(f"n{k}", f"n{k + 1}", 1.0) for k in range(6)]
    graph = H.build_graph(spark.createDataFrame(edges, "source string, target string, weight double"))
    known = []
    real = H._route
    H._route = lambda k, *a: known.append(k) or real(k, *a)
    try:
        H.shortest_route(graph, "n0", "n6").collect()
    finally:
        H._route = real
    assert known[0].dtypes == [("node", "string"), ("dist", "double"), ("hops", "bigint"), ("pred", "string"), ("last", "string"), ("span", "bigint")]
