import itertools

import pytest
from helpers import graph, levels_of, rows, seeds, sym

from closura.functions import text as T
from closura.operators import candidates as C
from closura.operators.graph import HARD, Graph
from closura.operators.packing import Ledger, admissions, admitted_rows, in_rank_order, pack, take_in_order
from closura.plans import harness


@pytest.mark.parametrize(
    ("edges", "start", "want"),
    [
        ("1-CALLS->2 2-CALLS->3 3-CALLS->4", [1], {1: 3, 2: 2, 3: 1}),
        ("1-CALLS->2 1-CALLS->3 2-CALLS->4 1-REFERENCES_TYPE->4", [1], {1: 3, 2: 2, 3: 2, 4: 2}),
        ("1-CALLS->2 1-REFERENCES_TYPE->2 2-CALLS->3 2-IMPLEMENTS->3 1-DECORATED_BY->3", [1], {1: 3, 2: 2, 3: 2}),
        ("1-CALLS->2 2-CALLS->1", [1], {1: 3, 2: 2}),
        ("1-CALLS->1", [1], {1: 3}),
        ("1-CALLS->2 2-CALLS->3 3-CALLS->1", [1], {1: 3, 2: 2, 3: 1}),
        ("1-CALLS->10 2-CALLS->10 1-CALLS->11 2-CALLS->12 10-CALLS->20", [1, 2], {1: 3, 2: 3, 10: 2, 11: 2, 12: 2, 20: 1}),
        ("1-CALLS->5 5-CALLS->2", [1, 2], {1: 3, 2: 3, 5: 2}),
        ("1-OBSERVED_CALLS->2 1-COVERS->3 1-INHERITS_FROM->4", [1], {1: 3}),
    ],
)
def test_closure(spark, edges, start, want):
    assert levels_of(graph(spark, edges), spark, *start) == want


def test_closure_clique_empty_and_types(spark):
    clique = " ".join(f"{a}-CALLS->{b}" for a, b in itertools.permutations(range(1, 7), 2))
    assert levels_of(graph(spark, clique), spark, 1) == {1: 3} | dict.fromkeys(range(2, 7), 2)
    g = graph(spark, "1-CALLS->2")
    assert g.closure(seeds(spark).limit(0)).isEmpty()
    for t in HARD:
        assert levels_of(graph(spark, f"1-{t}->2"), spark, 1) == {1: 3, 2: 2}


def test_profiles(spark):
    g = graph(spark, "1-CALLS->2 1-DECORATED_BY->3 2-CALLS->4")
    want = {"P3": {1: 3, 2: 2, 3: 2, 4: 1}, "P2": {1: 3, 2: 2, 3: 1}, "P1": {1: 3, 2: 1, 3: 1}, "P0": {1: 2, 2: 1, 3: 1}}
    assert {p: levels_of(g, spark, 1, profile=p) for p in want} == want
    assert g.unclosed(g.closure(seeds(spark, 1))).isEmpty()


def test_unclosed(spark):
    g = graph(spark, "9-CALLS->8 8-CALLS->7", [sym(1)])
    bare = spark.createDataFrame([(0, "P3", 1, 3), (0, "P3", 9, 3)], "trial long, profile string, node long, level int")
    assert rows(g.unclosed(bare), "src", "type", "dst", "needed", "level") == [(9, "CALLS", 8, 2, 0)]


def test_provenance(spark):
    g = graph(spark, "1-CALLS->2 2-IMPLEMENTS->3 1-DECORATED_BY->2")
    assert rows(g.provenance(seeds(spark, 1)), "node", "seq", "via", "edge", "rule") == [(2, 1, 1, "CALLS", "CALLS(L3)->L2"), (3, 1, 2, "IMPLEMENTS", "IMPLEMENTS(L2)->L1")]


def _cost(spark, symbols, levels):
    g = graph(spark, "", symbols)
    lv = spark.createDataFrame([(0, "P3", n, v) for n, v in levels.items()], "trial long, profile string, node long, level int")
    return g.cost(lv).first()["cost"]


def test_cost(spark):
    f = lambda e, n=1: 6 * e + 13 * n + 100
    s = [sym(1, refs3=[2, 9]), sym(2, refs2=[9], prov=4), sym(3), sym(9, ident=7), sym(5, file="other.py")]
    assert _cost(spark, s, {1: 3, 2: 2, 3: 1}) == 100 + 10 + 5 + 4 + 7 + f(2) == 251
    assert _cost(spark, [sym(1, refs3=[2]), sym(2)], {1: 3, 2: 1}) == 100 + 5 + 8 + f(1)
    assert _cost(spark, [sym(1, refs3=[2]), sym(2)], {1: 3, 2: 2}) == 100 + 10 + 5 + 5 + f(2)
    assert _cost(spark, [sym(1), sym(5, file="other.py")], {1: 3, 5: 2}) - _cost(spark, [sym(1), sym(5)], {1: 3, 5: 2}) == 13
    assert _cost(spark, [sym(1, refs3=[404])], {1: 3}) == 100 + 5 + f(1)


def test_admission(spark):
    g = graph(spark, "1-CALLS->2 1-DECORATED_BY->3", [sym(1), sym(2, l2=50), sym(3, l2=5000)])
    costs = g.cost(g.closure(seeds(spark, 1)))
    b = lambda n: Graph.admit(costs, spark.createDataFrame([(0, n)], "trial long, budget long")).first()
    assert b(8000)["status"] == "OK"
    assert b(320)["status"] == "DEMOTED:P2"
    low = b(100)
    assert low["status"] == "EXCEEDED" and low["deficit"] == low["cost"] - 95


def _facts(*syms):
    return {s[0]: (s[6], s[7], s[11], s[10], s[3], s[8], s[9]) for s in syms}


def test_packer_prices():
    seed, a, b, dep = sym(1), sym(20, refs2=[50]), sym(21, refs2=[50]), sym(50, ident=6)
    ledger = Ledger(_facts(seed, a, b, dep))
    ledger.raise_to(1, 3)
    assert ledger.price(20, 2) == 27 and ledger.raise_to(20, 2) == 27
    assert ledger.price(21, 2) == 21


def test_packer_order_and_fit():
    facts = _facts(sym(1), sym(20, l2=210), sym(21, l2=11))
    fresh = lambda: (lambda x: (x.raise_to(1, 3), x)[1])(Ledger(facts))
    got, room, _, _ = pack(fresh(), [(20, 1.0), (21, 1.0)], 1000)
    assert [(n, c) for n, c, _, _ in got] == [(21, 22), (20, 221)] and room == 757
    two = _facts(sym(1), sym(20), sym(21))
    for have, want, left in ((21, 1, 0), (20, 0, 20)):
        led = Ledger(two)
        led.raise_to(1, 3)
        got, room, _, _ = pack(led, [(20, 1.0), (21, 1.0)], have)
        assert (len(got), room) == (want, left)


def test_packer_agrees_with_scratch():
    import random

    rng = random.Random(4242)
    for _ in range(200):
        n = 12
        syms = [sym(i, l2=rng.randint(1, 30), l3=rng.randint(30, 90), refs2=rng.sample(range(n + 3), 3), refs3=rng.sample(range(n + 3), 5), ident=rng.randint(1, 9), file=f"f{i % 3}") for i in range(n)]
        facts, led, level = _facts(*syms), Ledger(_facts(*syms)), {}
        for _ in range(8):
            node, to = rng.randrange(n), rng.choice([1, 2, 3])
            led.raise_to(node, to)
            level[node] = max(to, level.get(node, 0))
            up = {x for x, v in level.items() if v >= 2}
            named = {r for x in up for r in (facts[x][6] if level[x] == 3 else facts[x][5])} - up
            want = sum(facts[x][1] if level[x] == 3 else facts[x][0] for x in up) + sum(facts[x][2] for x in up) + sum(facts[r][3] for r in named if r in facts) + 6 * len(up) + 13 * len({facts[x][4] for x in up}) + 100
            assert led.total == want


def test_take_in_order():
    led = Ledger(_facts(sym(1), sym(2, l2=1000), sym(3)))
    led.raise_to(1, 3)
    got, _, _, _ = take_in_order(led, [(2, 1.0), (3, 0.5)], 400)
    assert [g[0] for g in got] == [3]


def test_candidates(spark):
    s = [sym(1, fqn="pkg.mod.Thing.method"), sym(20, fqn="pkg.mod"), sym(21, fqn="pkg.mod.Thing"), sym(22, fqn="pkg.mod.Other.caller"), sym(23, fqn="pkg.mod.Thing2")]
    g = graph(spark, "20-CALLS->1 21-CALLS->1 22-CALLS->1 23-CALLS->1 1-IMPLEMENTS->7 30-IMPLEMENTS->7", s)
    found = C.candidates(g, seeds(spark, 1), seeds(spark))
    assert rows(found, "node", "source") == [(22, "static_caller"), (23, "static_caller"), (30, "sibling_implementation")]
    assert C.pool(found, 1).count() == 1


def test_hubs(spark):
    edges = " ".join(f"{100 + i}-CALLS->1" for i in range(4))
    g = graph(spark, edges)
    assert C.static_callers(g, seeds(spark, 1), hub=4).count() == 4
    assert C.static_callers(g, seeds(spark, 1), hub=3).count() == 0


def test_hints(spark):
    h = spark.createDataFrame([(0, n, 10, 0.0, n) for n in range(1, 11)], "trial long, node long, ident int, score double, place int")
    r = C.fill_hints(h, spark.createDataFrame([(0, 35)], "trial long, cap long")).first()
    assert (r["considered"], r["chosen"], r["tokens"], r["truncated"]) == (10, 3, 30, True)
    g = graph(spark, "", [sym(1, refs3=[2]), sym(2), sym(3)])
    lv = spark.createDataFrame([(0, "P3", 1, 3), (0, "P3", 2, 1), (0, "P3", 3, 1)], "trial long, profile string, node long, level int")
    assert rows(C.hint_pool(g, lv, spark.createDataFrame([], "trial long, node long, score double")), "node") == [(3,)]


def test_one_hop_ranking(spark):
    g = graph(spark, "1-CALLS->2 1-REFERENCES_TYPE->3 2-CALLS->4 1-INHERITS_FROM->5 6-CALLS->1")
    assert rows(C.graph_ranking(g, seeds(spark, 1)), "node", "place") == [(2, 2), (3, 1), (6, 3)]


def test_compile_end_to_end(spark):
    g = graph(spark, "1-CALLS->2 2-CALLS->3 20-CALLS->1 20-CALLS->50 21-CALLS->1", [sym(1), sym(2, refs2=[3])])
    c = harness.Compiled(g, seeds(spark, 1), spark.createDataFrame([(0, 8000)], "trial long, budget long"))
    r = c.summary().first()
    assert r["status"] == "OK" and r["closed"] and r["within_budget"] and r["cost_agrees"] and r["admitted"] == 2
    assert rows(c.levels, "node", "level") == [(1, 3), (2, 2), (20, 2), (21, 2), (3, 1), (50, 1)]


def test_greedy_arm(spark):
    g = graph(spark, "1-CALLS->2 1-CALLS->3", [sym(1), sym(2, l2=1000), sym(3)])
    lv = spark.createDataFrame([(0, 1, 3)], "trial long, node long, level int")
    pool = spark.createDataFrame([(0, 2, 2.0, 1), (0, 3, 1.0, 2)], "trial long, node long, score double, place int")
    got = admitted_rows(admissions(g, lv, pool, spark.createDataFrame([(0, 1200)], "trial long, room long"), greedy=False))
    assert rows(got, "node") == [(3,)]


def test_distribution(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 11)], "v long")
    r = harness.distribution(df.selectExpr("v", "1 as k"), "v", ["k"]).first()
    assert (r["least"], r["median"], r["p90"], r["p99"], r["most"]) == (1, 5.5, 10, 10, 10)


def test_functions(spark):
    df = spark.createDataFrame([("src/pkg/sub/__init__.py", ".\\github/x.py", "a.b.c", "x Foo foo_BAR 9")], "f string, p string, n string, t string")
    r = df.select(T.module_name("f"), T.clean_path("p"), T.leaf("n"), T.last_two("n"), T.owner("n"), T.words("t"), T.name_id("n")).first()
    assert list(r[:6]) == ["pkg.sub", "github/x.py", "c", "b.c", "a.b", ["x", "foo", "foo_bar", "9"]]
    assert 0 <= r[6] < 2**63


def test_rank_order_in_pieces(spark):
    syms = [sym(1)] + [sym(i, l2=(40, 5, 200, 12)[i % 4], refs2=[i + 1], file=f"f{i % 3}") for i in range(2, 30)]
    g = graph(spark, "", syms)
    ranked = spark.createDataFrame([(0, i, float(100 - i), i) for i in range(2, 30)], "trial long, node long, score double, place int")
    for budget in (200, 700, 1500):
        b = spark.createDataFrame([(0, budget)], "trial long, budget long")
        once = admitted_rows(admissions(g, seeds(spark, 1).selectExpr("trial", "node", "3 as level"), ranked, b.selectExpr("trial", "budget as room"), greedy=False))
        got = in_rank_order(g, seeds(spark, 1), ranked, b, piece=5)
        assert rows(got, "node", "cost") == rows(once, "node", "cost")
