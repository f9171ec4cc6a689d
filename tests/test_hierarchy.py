import random

import pytest

from closura.operators import hierarchy
from closura.operators.hierarchy import Hierarchy


def brute(links):
    """(child, root, depth) by breadth-first search; an id names a cycle if a way among ids that aren't smaller leads back to it."""
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = set()

    def above(v):
        dist, front = {v: 0}, [v]
        while front:
            nxt = []
            for x in front:
                for p in up.get(x, ()):
                    if p not in dist:
                        dist[p] = dist[x] + 1
                        nxt.append(p)
            front = nxt
        return dist

    reach = {v: above(v) for v in set(up) | {p for ps in up.values() for p in ps}}

    def closes(m):
        seen, todo = set(), [m]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p == m:
                    return True
                if p > m and p not in seen:
                    seen.add(p)
                    todo.append(p)
        return False

    least = {v for v in up if closes(v)}
    for v in up:
        for a, d in reach[v].items():
            if a not in up:
                out.add((v, a, d))
            if a in least:
                out.add((v, a, -1))
    return out


def solve(spark, links):
    df = spark.createDataFrame([(0, c, p) for c, p in links], "h int, child long, parent long")
    return Hierarchy(df)


@pytest.mark.parametrize(("seed", "local"), [(0, 0), (1, 20_000), (2, 0), (3, 0), (3, 20_000)])
def test_random_graphs(spark, monkeypatch, seed, local):
    monkeypatch.setattr(hierarchy, "LOCAL", local)
    rng = random.Random(seed)
    n = 40
    links = [(v, rng.randrange(v)) for v in range(5, n) if rng.random() < 0.9]
    links += [(rng.randrange(n), rng.randrange(n)) for _ in range((0, 4, 8, 14)[seed])]
    h = solve(spark, links)
    assert {(r["id"], r["root"], r["depth"]) for r in h.reach().collect()} == brute(set(links))


def test_cycles_that_share_a_symbol(spark, monkeypatch):
    """10-11 and 11-12 are two cycles; 21 and 22 are on one with 20, and on one of their own."""
    links = [(10, 11), (11, 10), (11, 12), (12, 11), (13, 12), (20, 21), (21, 22), (22, 20), (22, 21)]
    want = brute(set(links))
    assert {(13, 10, -1), (13, 11, -1), (20, 20, -1), (20, 21, -1)} <= want
    for local in (0, 20_000):
        monkeypatch.setattr(hierarchy, "LOCAL", local)
        assert {(r["id"], r["root"], r["depth"]) for r in solve(spark, links).reach().collect()} == want


def test_forms(spark):
    links = [(1, 1), (3, 2), (2, 3), (4, 2), (5, 6), (6, 7), (5, 7), (8, 1), (8, 7), (3, 2)]
    assert {(r["id"], r["root"], r["depth"]) for r in solve(spark, links).reach().collect()} == brute(set(links))


def test_deep_chain_and_wide_parent(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BUCKET", 16)
    links = [(i + 1, i) for i in range(60)] + [(1000 + i, 5) for i in range(200)] + [(2000 + i, 1000 + i) for i in range(60)]
    h = solve(spark, links)
    assert {(r["id"], r["root"], r["depth"]) for r in h.reach().collect()} == brute(set(links))
    t = {r["id"]: (r["hi"], r["lo"]) for r in h.nodes.collect()}
    below = lambda v: {u for u, (hi, _) in t.items() if t[v][1] < hi <= t[v][0]} - {v}
    assert below(1003) == {2003} and below(58) == {59, 60} and len(below(5)) == 55 + 260
    assert sorted(hi for hi, _ in t.values()) == list(range(1, len(t) + 1))


def test_empty(spark):
    assert solve(spark, []).reach().count() == 0


def brute_below(links):
    """{(h, top, below, depth)}: breadth-first search from every node, a node on a cycle found again by its own links."""
    out, up = set(), {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    for v in up:
        dist, front, d = {}, set(up[v]), 1
        while front:
            dist |= dict.fromkeys(front, d)
            front, d = {p for x in front for p in up.get(x, ())} - set(dist), d + 1
        out |= {(a, v, n) for a, n in dist.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_below_by_all_links(spark, monkeypatch, seed):
    rng = random.Random(seed)
    links = {(v, rng.randrange(v)) for v in range(5, 40)} | {(rng.randrange(40), rng.randrange(40)) for _ in range((6, 14, 0)[seed])} | {(40, 40), (41, 40), (42, 43), (43, 42), (44, 43), (44, 7)}
    df = spark.createDataFrame([(0, c, p) for c, p in links], "h int, child long, parent long")
    monkeypatch.setattr(hierarchy, "symbol_links", lambda *_: df)
    got = hierarchy.hierarchy_below(spark, "").collect()
    want = brute_below(links)
    assert sorted((r["id"], r["below_id"], r["depth"]) for r in got) == sorted(want)
    pairs = {(a, b) for a, b, _ in want}
    least = {a: min(b for x, b in pairs if x == a and (b, a) in pairs) for a, b in pairs if a == b}
    assert {(r["id"], r["cycle_id"]) for r in got} == {(a, least.get(a)) for a, _ in pairs}


@pytest.mark.parametrize("seed", range(2))
def test_shortest_path_to_every_root(spark, monkeypatch, seed):
    rng = random.Random(seed)
    links = {(v, rng.randrange(v)) for v in range(5, 30)} | {(rng.randrange(30), rng.randrange(30)) for _ in range((6, 12)[seed])} | {(40, 40), (41, 40), (42, 43), (43, 42), (44, 43), (44, 7)}
    df = spark.createDataFrame([(0, c, p) for c, p in links], "h int, child long, parent long")
    monkeypatch.setattr(hierarchy, "symbol_links", lambda *_: df)
    got = hierarchy.hierarchy_paths(spark, "").collect()
    roots = {p for _, p in links} - {c for c, _ in links}
    assert sorted((r["id"], r["root_id"], r["depth"]) for r in got) == sorted(brute(links) | {(v, v, 0) for v in roots})
    least = {(a, b): d for a, b, d in brute_below(links)}
    for r in got:
        path = [int(x) for x in r["path"].split("/")]
        assert path[0] == r["root_id"] and path[-1] == r["id"] and all((c, p) in links for p, c in zip(path, path[1:]))
        assert len(path) - 1 == (0 if r["depth"] == 0 else least[r["root_id"], r["id"]])
