import json
import random
import statistics

import pytest
from helpers import RAW_EDGE, RAW_SYMBOL, graph, rows, seeds, sym
from pyspark.sql import functions as F

from closura.api import Engine
from closura.operators import cone, emission, extraction, retrieval
from closura.operators import seeds as S
from closura.plans import cypher, harness
from closura.plans.config import Config
from closura.plans.skew import ranked
from closura.sources import graph_io

NAMES = ["django.db.query.QuerySet.filter", "django.contrib.query.QuerySet.filter", "django.db.query.QuerySet.build", "django.db.query", "pkg.Thing2", "pkg.OtherThing"]


def _named(spark):
    return graph(spark, "", [sym(i + 1, fqn=n) for i, n in enumerate(NAMES)])


def test_resolve_names(spark):
    q = spark.createDataFrame([("django.db.query",), ("build",), ("QuerySet.filter",), ("Thing",), ("nope",), (None,)], "query string")
    got = {r["query"]: (r["id"], r["error"]) for r in S.resolve_names(q, _named(spark)).collect()}
    assert got["django.db.query"] == (4, None) and got["build"] == (3, None)
    assert got["QuerySet.filter"][0] is None and "ambiguous" in got["QuerySet.filter"][1] and NAMES[1] in got["QuerySet.filter"][1]
    assert got["Thing"][0] is None and got["nope"][1] == "no symbol matches 'nope'" and len(got) == 5


def test_word_matches(spark):
    t = spark.createDataFrame([(1, "how does QuerySet filter build the query"), (2, "")], "task_id long, task string")
    got = rows(S.word_matches(t, _named(spark)), "place", "node")
    assert got[0] == (1, 2) or got[0] == (1, 1)
    assert {n for _, n in got[:3]} == {1, 2, 3}


def test_traceback(spark):
    g = graph(spark, "", [sym(10, fqn="pkg.query.outer", file="pkg/query.py", start_line=1, end_line=30), sym(11, fqn="pkg.query.inner", file="pkg/query.py", start_line=31, end_line=45)])
    text = 'Traceback\n  File "/x/pkg/query.py", line 5, in outer\n  File "pkg/query.py", line 35, in inner\n  File "other.py", line 1, in f\n  File "pkg/query.py", line 35, in inner\n  File "pkg/query.py", line 99, in g\n'
    found, lost = S.traceback_seeds(spark.createDataFrame([(1, text), (2, None), (3, "plain")], "task_id long, task string"), g)
    assert rows(found, "place", "node") == [(1, 11), (2, 10)]
    assert rows(lost, "line", "reason") == [(1, "file is not indexed"), (99, "line is inside no known symbol")]


def test_connectivity(spark):
    g = graph(spark, "1-CALLS->2 2-CALLS->3 3-CALLS->4 5-CALLS->5")
    pool = spark.createDataFrame([(0, n) for n in (1, 2, 3, 4, 5)], "task_id long, node long")
    assert rows(S.connectivity(pool, g), "node", "score") == [(1, 2), (2, 3), (3, 3), (4, 2), (5, 0)]
    assert rows(S.connectivity(pool, g, hub=0), "score") == [(0,)] * 5


def test_cone(spark):
    root = lambda n: spark.createDataFrame([(n,)], "root long")
    g = graph(spark, "1-CALLS->0 2-CALLS->1 3-CALLS->2 0-CALLS->1")
    assert rows(cone.impact_cone(g, root(0), 5)[0], "node", "depth") == [(1, 1), (2, 2)]
    wide = graph(spark, " ".join(f"{i}-CALLS->1" for i in range(10, 15)) + " 99-CALLS->10")
    found, notes = cone.impact_cone(wide, root(1), 2, hub=4)
    assert found.count() == 0 and rows(notes, "node", "reason") == [(1, "hub")]
    found, notes = cone.impact_cone(wide, root(1), 2, hub=5, frontier=3)
    assert rows(found, "node", "depth") == [(10, 1), (11, 1), (12, 1), (13, 1), (14, 1), (99, 2)] and rows(notes, "reason") == [("frontier cap",)]


def test_paths(spark):
    g = graph(spark, "1-CALLS->2 2-CALLS->3 1-CALLS->3 3-CALLS->1")
    src = spark.createDataFrame([(1,)], "source long")
    assert rows(cone.paths(g, src), "path") == [([1, 2, 3],), ([1, 2],), ([1, 3],)]
    pair = cone.path_procedure(g, src, spark.createDataFrame([(3,)], "target long"), "CALLS", 2, 1)
    assert rows(pair, "path", "length") == [([1, 3], 1)]


def test_explain(spark):
    g = graph(spark, "1-CALLS->2 2-CALLS->3")
    got = cone.explain(g.provenance(seeds(spark, 1)), spark.createDataFrame([(0, 3)], "trial long, node long"))
    assert rows(got, "depth", "via") == [(1, 2), (2, 1)]


def test_bundles(spark):
    """A candidate at level 3 brings its callees along, whole or not at all."""
    from closura.operators import packing

    g = graph(spark, "1-CALLS->2 5-CALLS->6 5-CALLS->7 6-CALLS->8 9-CALLS->1", [sym(i, l2=10, l3=100) for i in (1, 2, 5, 6, 7, 8, 9)])
    levels = g.closure(seeds(spark, 1)).where("profile = 'P3'")
    pool = spark.createDataFrame([(0, "P3", 5, 3, 9.0, 1), (0, "P3", 9, 2, 0.1, 2)], "trial long, profile string, node long, level int, score double, place int")
    got = packing.bundles(g, levels, pool)
    assert {r["node"]: [tuple(x) for x in r["raises"]] for r in got.collect()} == {5: [(5, 3), (6, 2), (7, 2)], 9: [(9, 2)]}
    run = lambda room: [(r["node"], r["cost"]) for r in packing.admitted_rows(packing.admissions(g, levels.select("trial", "node", "level"), got, spark.createDataFrame([(0, room)], "trial long, room long"))).collect()]
    floor = 100 + 13 + 100 + 10 + 2 * (5 + 6)
    bundle = 100 + 10 + 10 + 3 * (5 + 6)
    assert run(floor + bundle + 21) == [(5, bundle), (9, 21)] and run(floor + bundle - 1) == [(9, 21)] and run(floor + 20) == []
    tight = packing.floor_status(g, seeds(spark, 1), spark.createDataFrame([(0, 200)], "trial long, budget long")).first()
    assert (tight["status"], tight["floor"], tight["deficit"]) == ("EXCEEDED", 224, 24)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0])], "ids long, embeddings array<float>")
    idx = retrieval.clean_index(df, dim=2)
    assert rows(retrieval.cosine_rank(idx, seeds(spark, 1)), "place", "node") == [(1, 2), (2, 3), (3, 4)]
    q = retrieval.query_vectors(idx, seeds(spark, 1, 4)).first()["q"]
    assert q == pytest.approx([0.5**0.5, 0.5**0.5])
    assert rows(retrieval.index_report(df, dim=2), "issue", "n_rows") == [("not finite", 1), ("null", 1), ("wrong length", 1), ("zero", 1)]


def test_peeling():
    assert emission.peel_imports("from x import (\n  a,\n)\nimport y\n\ndef f(): ...") == (["from x import (\n  a,\n)", "import y"], "def f(): ...")
    assert emission.peel_imports("import y\ndef f(): ...") == ([], "import y\ndef f(): ...")
    assert emission.peel_class("class A:\n    def f(self): ...\n", "method") == ("class A:", "    def f(self): ...\n")
    assert emission.peel_class("class A:\n    def f(self): ...\n", "class")[0] is None


def test_render():
    b = lambda **kw: {"section": 0, "level": 3, "fqn": "p.m.A.f", "kind": "method", "file": "p/m.py", "start_line": 3, "tokens": 9, "via": None, "edge": None, "text": "import y\n\nclass A:\n    def f(self): y\n"} | kw
    r = {"status": "DEMOTED:P2", "profile": "P2", "label": "COMPACT", "budget": 8000, "used": 1234, "closed": True, "deficit": 0, "seeds": [], "identities": ["z — f:1", "b — f:2"], "hints": [], "blocks": [b(), b(fqn="p.m.A.g", start_line=5, section=0), b(section=1, fqn="p.m.h", kind="function", level=2, text="import y\n\ndef h(): ...\n", via="A.f", edge="CALLS")]}
    text = emission.render(r, count=len)["text"]
    assert text.startswith("Compiled context · 3 symbols · 1,234 / 8,000 tokens\n1 declarations · 2 bodies · 2 identities\nStructural closure: complete (P2 COMPACT, demoted from P3 FULL)")
    assert text.count("import y") == 1 and text.count("class A:") == 1 and "# h  [L2, 9t]  <- A.f  CALLS" in text and "# --- mandatory identities (2) ---\nb — f:2\nz — f:1" in text
    assert "deficit 5" in emission.render(r | {"status": "EXCEEDED", "deficit": 5, "seeds": ["x"]}, count=len)["text"]


def _root(spark, save):
    at = lambda i, fqn, l3, refs, **kw: (i, fqn, kw.get("kind", "function"), "pkg/mod.py", 10 * i, 10 * i + 5, None, f"def f{i}(): ...\n", 5, [], f"def f{i}():\n    {l3}\n", 11, refs, 7, 9, None, None, None, None)
    s = [at(1, "pkg.Seed.run", "step()", [2]), at(2, "pkg.Dep.step", "pass", []), at(3, "pkg.Caller.go", "run()", [1])]
    e = [("CALLS", 1, 2, 1, None, None), ("CALLS", 3, 1, 1, None, None)]
    v = spark.createDataFrame([(1, [1.0] + [0.0] * 63), (2, [0.0] * 63 + [1.0]), (3, [1.0] + [0.1] * 63)], "ids long, embeddings array<float>")
    return save(symbols=spark.createDataFrame(s, RAW_SYMBOL), edges=spark.createDataFrame(e, RAW_EDGE), vector_index=v)


def test_engine(spark, save):
    eng = Engine(spark, _root(spark, save))
    with pytest.raises(ValueError, match="compile a context"):
        eng.explain("step")
    r = eng.compile(["Seed.run"], budget=2000)
    assert r["status"] == "OK" and r["symbols"] == 3 and "# step  [L2, 5t]  <- Seed.run  CALLS" in r["text"] and "OPTIONAL:static_caller" in r["text"]
    assert eng.explain("step")["chain"][0][1:3] == ("pkg.Seed.run", "CALLS")
    assert eng.compile(task="please run the Seed", budget=2000)["seeds"][0] in (1, 3)
    assert eng.compile(task='  File "none.py", line 1, in f', budget=500)["seeds"] == []
    assert eng.cone("Dep.step")["counts"] == {1: 1, 2: 1}
    assert [x["fqn"] for x in eng.vector_context(["pkg.Seed.run"])] == ["pkg.Caller.go", "pkg.Dep.step"]
    with pytest.raises(S.SeedError, match="nope.*; .*nada"):
        eng.compile(["nope", "nada"])


SOURCES = {
    "src/pkg/base.py": 'LIMIT = 30\nTWICE = LIMIT * 2\nLOOP = POOL\nPOOL = LOOP\n\nclass Base:\n    """Doc."""\n    def run(self, x: int) -> int:\n        \'Run "it"\'\n        return x\n    def _hidden(self): ...\n',
    "src/pkg/sub.py": "from pkg.base import (\n    Base,\n    LIMIT,\n)\n\nclass Sub(Base):\n    def go(self):\n        def inner():\n            return self.run(LIMIT)\n        return self.run(1)\n",
    "src/pkg/broken.py": "def (",
    "src/.hid/x.py": "A = 1",
}


def test_extraction(spark, tmp_path):
    for name, text in SOURCES.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    occ = lambda line, col, s: {"range": [line, col, col + 3], "symbol": f"scip-python python pkg 0.1 {s}"}
    docs = [{"relative_path": "src/pkg/sub.py", "occurrences": [occ(5, 10, "`src.pkg.base`/Base#"), occ(9, 20, "`src.pkg.base`/Base#run()."), occ(9, 40, "`src.pkg.base`/LIMIT.")], "symbols": [{"symbol": "scip-python python pkg 0.1 `src.pkg.sub`/Sub#", "relationships": [{"symbol": "scip-python python pkg 0.1 `src.pkg.base`/Base#", "is_implementation": True}]}]}]
    (tmp_path / "scip.json").write_text(json.dumps({"documents": docs}))
    files = extraction.source_files(spark, str(tmp_path))
    assert {r["file"] for r in files.collect()} == {"src/pkg/base.py", "src/pkg/sub.py", "src/pkg/broken.py"}
    symbols, edges = extraction.build_graph(spark, files, *extraction.scip_tables(spark, str(tmp_path / "scip.json")))
    s = {r["fqn"]: r for r in symbols.collect()}
    name = {r["id"]: f for f, r in s.items()}
    e = {(r["type"], name[r["src"]], name[r["dst"]]): r for r in edges.collect()}
    assert set(e) == {("REFERENCES_TYPE", "pkg.sub.Sub", "pkg.base.Base"), ("CALLS", "pkg.sub.Sub.go", "pkg.base.Base.run"), ("IMPLEMENTS", "pkg.sub.Sub", "pkg.base.Base"), ("INHERITS_FROM", "pkg.sub.Sub", "pkg.base.Base")}
    assert s["pkg.base.TWICE"]["static_value"] == "60" and s["pkg.base.TWICE"]["repr_L2_text"] == "TWICE = 60\n" and s["pkg.base.LOOP"]["evaluable"] is False
    assert "    def run(self, x: int) -> int: ...  # from pkg.base.Base" in s["pkg.sub.Sub"]["repr_L2_text"] and "_hidden" not in s["pkg.sub.Sub"]["repr_L2_text"]
    assert s["pkg.base.Base.run"]["repr_L2_text"].splitlines()[2].strip() == "'Run \"it\"'"
    assert all(emission.parses(r[t]) for r in s.values() for t in ("repr_L2_text", "repr_L3_text"))
    assert graph_io.verify(symbols, edges).where("what = 'symbols'").first()["n"] == len(s)


def test_fold_and_order():
    f = extraction.fold({"A": "30", "B": "A * 2", "C": "int(x)", "D": "E", "E": "D", "F": "{'b', 'a'}", "G": "'x' * 4093", "H": "'x' * 4096", "I": "2 ** 99999", "J": "A and 0"})
    assert f["B"] == (True, "60", 2) and not f["C"][0] and not f["D"][0] and not f["E"][0] and f["F"][1] == "{'a', 'b'}" and f["J"][1] == "False"
    assert f["G"][1] is not None and f["H"] == (True, None, 4098) and not f["I"][0]
    bases = {"O": [], "A": ["O"], "B": ["O"], "C": ["A", "B"]}
    assert extraction.linearize("C", bases) == ["C", "A", "B", "O"]
    assert extraction.fold({"A": "{'x': 1, 'y': [2, -3]}", "B": "{**A}", "C": "(A, 1) * 5000", "D": "not A or 0", "E": "1 if A else 2"}) == {"A": (True, "{'x': 1, 'y': [2, -3]}", 22), "B": (False, None, 0), "C": (False, None, 0), "D": (True, "False", 5), "E": (False, None, 0)}
    assert extraction.scip_name("local 12") is None
    assert extraction.scip_name("scip-python python requests 2 `src.requests.sessions`/Session#get().") == "requests.sessions.Session.get"


def test_surfaces(spark):
    classes = spark.createDataFrame([("O", ["def a(self): ...", "x: int", "def _h(self): ..."]), ("A", ["def a(self, z): ...", "def a(self): ..."]), ("B", ["x: str"]), ("C", ["def _own(self): ..."]), ("X", ["def a(self): ..."]), ("Y", []), ("Z", [])], "fqn string, members array<string>")
    deep = [(f"D{i}", 0, f"D{i + 1}") for i in range(70)]
    more = spark.createDataFrame([(f"D{i}", ["def end(self): ..."] if i == 70 else []) for i in range(71)], "fqn string, members array<string>")
    bases = spark.createDataFrame([("A", 0, "O"), ("B", 0, "O"), ("C", 0, "A"), ("C", 1, "B"), ("X", 0, "gone"), ("Y", 0, "Z"), ("Z", 0, "Y"), *deep], "fqn string, place int, base string")
    got = {r["fqn"]: (r["body"], r["partial"]) for r in extraction.surfaces(classes.union(more), bases).collect()}
    assert got["C"] == ("    def _own(self): ...\n    def a(self, z): ...  # from A\n    x: str  # from B\n", False)
    assert got["O"][0].count("\n") == 3 and got["X"] == ("    def a(self): ...\n", True) and got["Y"] == ("    ...\n", True)
    assert got["D0"] == ("    def end(self): ...  # from D70\n", False) and len(got) == 78


def test_ids_move_to_free_numbers(spark, monkeypatch):
    from closura.functions import text as T

    monkeypatch.setattr(T, "name_id", lambda c: F.length(c).cast("long"))
    got = {r["fqn"]: r["id"] for r in extraction.assign_ids(spark.createDataFrame([("a",), ("b",), ("c",), ("dd",), ("ee",), ("fff",)], "fqn string")).collect()}
    assert got["a"] == 1 and got["dd"] == 2 and got["fff"] == 3 and sorted(got.values()) == [1, 2, 3, 4, 5, 6]


def test_ranked_and_distribution(spark):
    rng = random.Random(3)
    keys = rng.sample(range(10_000), 300)
    got = [(r["k"], r["p"]) for r in ranked(spark.createDataFrame([(k,) for k in keys], "k long"), "k").collect()]
    assert sorted(got) == [(k, i + 1) for i, k in enumerate(sorted(keys))]
    for n in (1, 2, 9, 10):
        v = sorted(rng.choices(range(30), k=n))
        r = harness.distribution(spark.createDataFrame([("a", x) for x in [*v, None]], "g string, v int"), "v", ["g"]).first()
        assert (r["n"], r["least"], r["median"], r["p90"], r["p99"], r["most"]) == (n, v[0], statistics.median(v), v[min(n - 1, int(n * 0.9))], v[min(n - 1, int(n * 0.99))], v[-1])


def test_own_scope():
    rows_ = {r["fqn"]: [u["type"] for u in r["uses"]] for r in extraction.scan_text("m.py", "@register\nclass Foo(Base):\n    def method(self):\n        inner_call()\n")}
    assert rows_ == {"m": [], "m.Foo": ["REFERENCES_TYPE", "DECORATED_BY"], "m.Foo.method": ["CALLS"]}


def test_cypher(spark):
    g = graph(spark, "1-CALLS->2 2-CALLS->3 1-IMPLEMENTS->3", [sym(3, kind="test")])
    run = lambda q, p=None: rows(cypher.run(q, g, p))
    assert run("MATCH (a {id: 1})-[:CALLS]->(b) RETURN b.id AS id") == [(2,)]
    assert run("MATCH (a {id: $x})-[:CALLS*1..2]->(b) RETURN b.id AS id", {"x": 1}) == [(2,), (3,)]
    assert run("MATCH (b:Test)<-[r:CALLS|IMPLEMENTS]-(a) WHERE a.id <> 9 AND NOT (a.id > 5 OR a.fqn STARTS WITH 'x') RETURN a.id AS id") == [(1,), (2,)]
    assert run("UNWIND $rows AS row MATCH (a {id: row.id})-[:CALLS]->(b) RETURN row.id AS src, b.id AS dst", {"rows": [{"id": 1}, {"id": 2}]}) == [(1, 2), (2, 3)]
    assert run("MATCH (a)-[:CALLS]->(b) RETURN count(*) AS n, collect(b.id) AS ids")[0][0] == 2
    assert run("MATCH (a) RETURN a.id AS id ORDER BY id DESC SKIP 1 LIMIT 1") == [(2,)]
    for bad in ("MATCH (a) RETURN", "MATCH (a:Foo) RETURN a.id", "MATCH (a) WHERE b.id = 1 RETURN a.id", "CREATE (a)", "MATCH (a {id: $no}) RETURN a.id"):
        with pytest.raises(cypher.CypherError):
            cypher.run(bad, g)
    s, e = cypher.delete_nodes(g.symbols, g.edges, spark.createDataFrame([(3,)], "id long"))
    assert rows(s, "id") == [(1,), (2,)] and e.count() == 1


def test_io(spark, tmp_path):
    e = spark.createDataFrame([("CALLS", 1, 2, "ast+scip", 0.95, 3, None), ("INHERITS_FROM", 1, 3, "ast+scip", 0.95, None, False)], graph_io.EDGES)
    graph_io.write_jsonl(e, f"{tmp_path}/e", ["type", "src", "dst"], files=1)
    lines = [x for p in sorted((tmp_path / "e").glob("part*")) for x in p.read_text().splitlines()]
    assert lines[0] == '{"type":"CALLS","src":1,"dst":2,"resolver":"ast+scip","confidence":0.95,"call_sites":3}'
    assert rows(graph_io.read_edges(spark, f"{tmp_path}/e")) == rows(e) and graph_io.read_edges(spark, f"{tmp_path}/e", display=False).count() == 1
    (tmp_path / "bad.json").write_text('{"type":"NOPE","src":1,"dst":2}\n')
    with pytest.raises(Exception, match="unknown edge type"):
        graph_io.read_edges(spark, f"{tmp_path}/bad.json").collect()
    graph_io.write_graph(spark.createDataFrame([(1,)], "id long"), e, f"{tmp_path}/g")
    assert spark.read.parquet(f"{tmp_path}/g/edges").where("type = 'CALLS'").count() == 1
    assert [len(c) for c in graph_io.chunks([{"a": "x" * n} for n in (1, 1, 50, 1)], 2, 40)] == [2, 1, 1]
    assert graph_io.same_ids(e.select("src"), e.select("src")) and not graph_io.same_ids(e.select("src"), e.select("dst"))


def test_build_index_and_config(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, text string")
    got = {r["ids"]: list(r["embeddings"]) for r in retrieval.build_index(texts, lambda t: [[len(x), 0.0] for x in t], 2).collect()}
    assert got == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(ValueError, match="unique"):
        retrieval.build_index(texts.union(texts), lambda t: t, 2)
    with pytest.raises(Exception, match="blank"):
        retrieval.build_index(spark.createDataFrame([(1, " ")], "id long, text string"), lambda t: t, 2).collect()
    with pytest.raises(ValueError, match="CLOSURA_ROOT.*positive"):
        Config.from_env({"CLOSURA_BUDGET": "0"})
    assert harness.within_tolerance({"median": 46, "p90": 2000}, {"median": 47, "p90": 83, "max": 1}) == {"median": True, "p90": False, "max": False}


def test_render_explanation():
    assert "not in the compiled" in cone.render_explanation("a", {"present": False, "referenced_by": ["b"]})
    text = cone.render_explanation("a", {"present": True, "level": 2, "seed": False, "chain": [(1, "b", "CALLS", "CALLS(L3)->L2"), (1, "c", "OPTIONAL:static_caller", "packed(static_caller)->L2")]})
    assert "  <- b  CALLS  (rule: CALLS(L3)->L2)" in text and "rules that fired: 1" in text and "optional packing: 1" in text


def test_all_eligible_symbols_are_dealt(spark):
    g = graph(spark, "0-CALLS->1", [sym(i, l3=150) for i in range(0, 2000, 100)] + [sym(i, l3=150) for i in range(1, 9)] + [sym(9, l3=10)])
    got = {(r["trial"], r["node"]) for r in harness.all_seeds(g).collect()}
    assert {n for _, n in got} == set(range(0, 2000, 100)) | set(range(1, 9))
    assert {t for t, _ in got} == {0, 100, 200, 300} | set(range(1, 9))
    assert {x for x in got if x[0] < 100} == {(r["trial"], r["node"]) for r in harness.trial_seeds(g).collect()}
