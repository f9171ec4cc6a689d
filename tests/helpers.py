"""Small graphs and tables for tests."""

from closura.operators.graph import Graph

SYMBOL = "id long, fqn string, kind string, file string, start_line int, end_line int, l2 int, l3 int, refs2 array<long>, refs3 array<long>, ident int, prov int"
EDGE = "type string, src long, dst long, call_sites int"
RAW_SYMBOL = "id long, fqn string, kind string, file string, start_line int, end_line int, parent_class string, repr_L2_text string, repr_L2_tokens int, repr_L2_refs array<long>, repr_L3_text string, repr_L3_tokens int, repr_L3_refs array<long>, identity_tokens int, provenance_tokens int, static_value string, body_hash string, indexed_at timestamp, loaded_at timestamp"
RAW_EDGE = "type string, src long, dst long, call_sites int, indexed_at timestamp, loaded_at timestamp"


def sym(i, **kw):
    d = {"fqn": f"pkg.sym{i}", "kind": "function", "file": "pkg/mod.py", "start_line": i, "end_line": i, "l2": 10, "l3": 100, "refs2": [], "refs3": [], "ident": 8, "prov": 5} | kw
    return (i, d["fqn"], d["kind"], d["file"], d["start_line"], d["end_line"], d["l2"], d["l3"], d["refs2"], d["refs3"], d["ident"], d["prov"])


def graph(spark, edges, symbols=()):
    """edges: 'src-TYPE->dst' with spaces between; every named node exists."""
    rows = []
    for e in edges.split():
        src, rest = e.split("-", 1)
        etype, dst = rest.split("->")
        rows.append((etype, int(src), int(dst), None))
    have = {s[0]: s for s in symbols}
    for n in {x for r in rows for x in r[1:3]} - set(have):
        have[n] = sym(n)
    return Graph(spark.createDataFrame(list(have.values()), SYMBOL), spark.createDataFrame(rows, EDGE))


def seeds(spark, *nodes):
    return spark.createDataFrame([(0, n) for n in nodes], "trial long, node long")


def levels_of(g, spark, *nodes, profile="P3"):
    return {r["node"]: r["level"] for r in g.closure(seeds(spark, *nodes)).where(f"profile = '{profile}'").collect()}


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)
