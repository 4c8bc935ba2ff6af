import random

import pytest

from tapedeck.operators import communities as c


def worth(edges, of):
    m2, k, inside = 0.0, {}, 0.0
    for a, b, w in edges:
        m2 += 2 * w
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
        inside += 2 * w * (of[a] == of[b])
    total = {}
    for x in k:
        total[of[x]] = total.get(of[x], 0) + k[x]
    return inside / m2 - sum(v * v for v in total.values()) / (m2 * m2)


def sequential(edges, seed=0):
    """One node after the other, each to where it gains most, until none gains."""
    near, k = {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = near.get(x, {}).get(y, 0) + w
            k[x] = k.get(x, 0) + w
    m2, of = sum(k.values()), {x: x for x in k}
    order = sorted(k)
    random.Random(seed).shuffle(order)
    for _ in range(20):
        moved = False
        for x in order:
            to = {}
            for y, w in near[x].items():
                to[of[y]] = to.get(of[y], 0) + w
            rest = {q: sum(k[y] for y in k if of[y] == q and y != x) for q in {*to, of[x]}}
            gains = {q: (w - to.get(of[x], 0)) / m2 - k[x] * (rest[q] - rest[of[x]]) / m2**2 for q, w in to.items() if q != of[x]}
            best = max(gains, key=lambda q: (gains[q], str(q)), default=None)
            if best is not None and gains[best] > 1e-12:
                of[x], moved = best, True
        if not moved:
            break
    return of


def found(spark, edges, nodes=None):
    e = spark.createDataFrame(edges, "artist_a string, artist_b string, weight double")
    n = spark.createDataFrame([(x,) for x in nodes], "artist_name string") if nodes else None
    return {r.artist_name: r.community for r in c.communities(e, n).collect()}


def test_two_clusters_and_a_bridge(spark):
    edges = [("A1", "A2", 10.0), ("A1", "A3", 10.0), ("A2", "A3", 10.0), ("B1", "B2", 10.0), ("B1", "B3", 10.0), ("B2", "B3", 10.0), ("A1", "B1", 0.1)]
    got = found(spark, [*edges, ("X", "X", 5.0), ("Y", None, 1.0), ("Y", "A1", 0.0)], ["A1", "Z"])
    assert got == {"A1": 0, "A2": 0, "A3": 0, "B1": 1, "B2": 1, "B3": 1, "Z": -1}


def test_no_edges(spark):
    assert found(spark, [], ["A", "B"]) == {"A": -1, "B": -1}
    assert found(spark, []) == {}


@pytest.mark.parametrize("seed", [1, 2])
def test_modularity_is_that_of_a_sequential_run(spark, seed):
    r = random.Random(seed)
    edges = {}
    for _ in range(400):
        x, y = r.randrange(60), r.randrange(60)
        if x < y and (x % 5 == y % 5 or r.random() < 0.15):
            edges[f"n{x:02}", f"n{y:02}"] = round(r.uniform(0.5, 3), 2)
    edges = [(a, b, w) for (a, b), w in edges.items()]
    got = found(spark, edges)
    alone = {x: i for i, x in enumerate(x for x, v in got.items() if v < 0)}
    of = {x: v if v >= 0 else 1000 + alone[x] for x, v in got.items()}
    assert sorted({v for v in got.values() if v >= 0}) == list(range(max(got.values()) + 1))
    assert worth(edges, of) >= 0.95 * max(worth(edges, sequential(edges, s)) for s in range(5))
    # no single move gains anything
    q = worth(edges, of)
    for x in of:
        for to in {of[b if a == x else a] for a, b, _ in edges if x in (a, b)}:
            assert worth(edges, of | {x: to}) <= q + 1e-9


def test_graphs_by_key_keep_apart(spark):
    triangle = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)]
    rows = [(1, *e) for e in triangle] + [(2, *e) for e in triangle] + [(2, "d", "e", 4.0)]
    e = spark.createDataFrame(rows, "user_id long, artist_a string, artist_b string, weight double")
    got = {(r.user_id, r.artist_name): r.community for r in c.communities(e, by=("user_id",)).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 0, (1, "c"): 0, (2, "a"): 0, (2, "b"): 0, (2, "c"): 0, (2, "d"): 1, (2, "e"): 1}


def test_modularity_on_the_graph_of_heaviest_edges(spark):
    from tapedeck.plans.registry import QUERIES

    edges = QUERIES["f06_top_neighbors"](spark, "/root/testdata/sf0.001").select("artist_a", "artist_b", "weight").collect()
    edges = [tuple(e) for e in edges]
    got = found(spark, edges)
    of = {x: v if v >= 0 else x for x, v in got.items()}
    assert worth(edges, of) >= min(worth(edges, sequential(edges, s)) for s in range(5))
    assert got == {r.artist_name: r.community for r in QUERIES["f10_communities"](spark, "/root/testdata/sf0.001").collect()}
