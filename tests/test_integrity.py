from datetime import datetime as dt

from helpers import RAW_EDGE, RAW_SYMBOL, rows

from closura.operators import integrity, skewed_keys


def _symbol(i, refs, at, **kw):
    d = dict.fromkeys(c.split()[0] for c in RAW_SYMBOL.split(", "))
    d |= {"id": i, "fqn": f"s{i}", "repr_L3_refs": refs, "indexed_at": dt(2025, 1, 5), "loaded_at": at} | kw
    return tuple(d.values())


def _tables(spark, save, symbols, edges, removed=(), stubs=()):
    return save(
        symbols=spark.createDataFrame(symbols, RAW_SYMBOL),
        edges=spark.createDataFrame(edges, RAW_EDGE),
        removed_symbols=spark.createDataFrame(list(removed), "symbol_id long, removed_at timestamp, reason string"),
        stub_symbols=spark.createDataFrame([(i, f"st{i}", "class", "f") for i in stubs], "id long, fqn string, kind string, file string"),
    )


def test_orphans(spark, save):
    a, b, c = dt(2025, 1, 10), dt(2025, 2, 10), dt(2025, 3, 10)
    symbols = [_symbol(1, [2, 3, 99, None], a), _symbol(1, [2, 3, 99, None], c), _symbol(2, None, b), _symbol(4, [5], c), _symbol(6, [4, 1], c)]
    edges = [("calls ", 1, 3, 1, dt(2025, 1, 7), a), ("CALLS", 1, 3, 1, dt(2025, 1, 7), c), ("CALLS", 4, 5, 1, dt(2025, 3, 7), c), ("CALLS", 4, None, None, None, None), ("CALLS", 7, 2, 1, dt(2025, 3, 1), c)]
    root = _tables(spark, save, symbols, edges, [(5, b, None), (5, c, "x"), (4, dt(2026, 1, 1), None)], [3])
    want = [
        ("edges.dst", 4, 5, "2025-03", "removed"), ("edges.src", 2, 7, "2025-03", "missing"), ("symbols.repr_L3_refs", 1, 2, "2025-01", "late"),
        ("symbols.repr_L3_refs", 1, 99, "2025-01", "missing"), ("symbols.repr_L3_refs", 4, 5, "2025-01", "removed"),
    ]
    assert rows(integrity.orphan_references(spark, root)) == want
    got = rows(integrity.orphan_cascade(spark, root), "record", "src", "dst", "orphan", "round")
    assert ("symbol", "6", None, "inherited", 1) in got and ("symbol", "1", None, "direct", 0) in got
    assert ("edge", "1", "3", "inherited", 1) in got and ("edge", "7", "2", "direct", 0) in got and ("edge", "4", None, "inherited", 1) in got


def test_empty_tables(spark, save):
    root = _tables(spark, save, [], [])
    assert integrity.orphan_references(spark, root).count() == 0
    assert integrity.orphan_cascade(spark, root).count() == 0


def test_heavy_keys_and_profile(spark):
    e = spark.createDataFrame([(" calls", 1, i % 3 if i % 2 else 7, 1, None, None) for i in range(60)] + [(None, None, None, None, None, None)], RAW_EDGE)
    heavy = {(r["field"], r["key"]) for r in skewed_keys.heavy_keys(e, 0.4).collect()}
    assert heavy == {("edges.dst", "7"), ("edges.src", "1"), ("edges.type", "CALLS")}
    p = {(r["field"], r["key"]): (r["n_rows"], r["n_neighbours"]) for r in skewed_keys.key_profile(e).collect()}
    assert p["edges.src", 1] == (60, 4) and p["edges.dst", 7] == (30, 1)
    assert skewed_keys.heavy_keys(e.limit(0)).count() == 0


def test_profile_of_all_fields(spark):
    e = [(" calls", 1, 2, 1, None, None), ("CALLS", 1, 2, 1, None, None), ("CALLS", 1, 3, 1, None, None), ("calls", 4, None, 1, None, None), ("X", None, 3, 1, None, None), (None, 4, 2, 1, None, None)]
    got = rows(skewed_keys.key_profile_all(spark.createDataFrame(e, RAW_EDGE), 0.5), "field", "key", "n_rows", "n_src", "n_dst", "heavy")
    want = [
        ("edges.dst", "2", 3, 2, None, True), ("edges.dst", "3", 2, 1, None, False), ("edges.src", "1", 3, None, 2, True), ("edges.src", "4", 2, None, 1, False),
        ("edges.type", "CALLS", 4, 2, 2, True), ("edges.type", "X", 1, 0, 1, False),
    ]
    assert got == want


def test_eager_join_counts(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "x")], "k int, l string")
    b = spark.createDataFrame([(1, "u"), (1, "v"), (1, "v"), (None, "u")], "k int, r string")
    got = {(r["l"], r["r"]): int(r["n_pairs"]) for r in skewed_keys.eager_join_counts(a, b, "k", "l", "r").collect()}
    plain = {(r["l"], r["r"]): r["count"] for r in a.join(b, "k").groupBy("l", "r").count().collect()}
    assert got == plain == {("x", "u"): 2, ("x", "v"): 4}
