import random

from skein.operators import clustering as C


def value(weights, community, gamma):
    """Sum of (w - gamma) over pairs of one community."""
    size = {}
    for c in community.values():
        size[c] = size.get(c, 0) + 1
    return sum(w for (a, b), w in weights.items() if community[a] == community[b]) - gamma * sum(n * (n - 1) / 2 for n in size.values())


def distributed(spark, weights, nodes, gamma, **more):
    edges = spark.createDataFrame([(1, a, b, w) for (a, b), w in weights.items()], "project int, s long, t long, weight double")
    own = spark.createDataFrame([(1, n) for n in nodes], "project int, node long")
    got = C.partition(edges, own, gamma, **more).collect()
    assert sorted(r["node"] for r in got) == sorted(nodes)
    found = {r["node"]: r["community"] for r in got}
    assert all(c == min(n for n in found if found[n] == c) for c in set(found.values()))
    return found


def grouped(weights, nodes, gamma):
    around = {}
    for (a, b), w in weights.items():
        for x, y in ((a, b), (b, a)):
            around.setdefault(x, {})[y] = around.setdefault(x, {}).get(y, 0.0) + w
    return C.potts(around, sorted(nodes), gamma)


def test_two_cliques_beyond_a_group(spark):
    weights = {(a, b): 0.8 for g in (range(5), range(5, 10)) for a in g for b in g if a < b} | {(0, 5): 0.7}
    got = distributed(spark, weights, range(12), 0.5, most_nodes=3)
    assert got == {**{n: 0 for n in range(5)}, **{n: 5 for n in range(5, 10)}, 10: 10, 11: 11}


def test_planted_communities(spark):
    """12 communities of 6 to 24 nodes, dense inside, with a hub that touches a third of all nodes."""
    rng = random.Random(5)
    home = [c for c in range(12) for _ in range(rng.randrange(6, 25))]
    n = len(home)
    weights = {}
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < (0.5 if home[a] == home[b] else 0.01) or (a == 0 and b % 3 == 0):
                weights[a, b] = 1.0
    got, want = distributed(spark, weights, range(n), 0.2, most_nodes=20), grouped(weights, range(n), 0.2)
    mine, best, planted = value(weights, got, 0.2), value(weights, want, 0.2), value(weights, dict(enumerate(home)), 0.2)
    print(f"{mine:.1f} distributed, {best:.1f} in one task, {planted:.1f} planted")
    assert mine >= 0.98 * max(best, planted)


def test_moves_made_at_once_never_lower_the_sum(spark, monkeypatch):
    """Each round of moves, also with few admitted, adds at least what it reckoned."""
    rng = random.Random(8)
    weights = {(min(a, b), max(a, b)): rng.choice([0.3, 0.6, 1.0]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(400)) if a != b}
    state = {n: n for n in range(60)}
    links = spark.createDataFrame([(1, *p, w) for (a, b), w in weights.items() for p in ((a, b), (b, a))], "p int, s long, t long, w double").cache()
    now = value(weights, state, 0.2)
    for number in range(6):
        monkeypatch.setattr(C, "ADMITTED", 2 if number % 2 else 1000)
        moves = C._moves(links, spark.createDataFrame([(1, k, 1, c) for k, c in state.items()], "p int, n long, size long, c long"), 0.2, number).collect()
        state |= {r["n"]: r["to"] for r in moves}
        then = value(weights, state, 0.2)
        assert then > now if moves else then == now
        now = then


def test_mixed_projects(spark):
    """A project that is one group beside one that is not, one without edges, and nulls nowhere."""
    edges = spark.createDataFrame([("a", 1, 2, 1.0), ("b", 1, 2, 1.0), ("b", 2, 3, 1.0), ("b", 3, 1, 1.0), ("b", 3, 4, 0.1), ("b", 3, 3, 9.0)], "project string, s long, t long, weight double")
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 7)], "project string, node long")
    got = {tuple(r) for r in C.partition(edges, nodes, 0.5, most_nodes=3).collect()}
    assert got == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 1), ("b", 3, 1), ("b", 4, 4), ("c", 7, 7)}
