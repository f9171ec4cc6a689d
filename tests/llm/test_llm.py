import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from closura.llm import leakage, mixing, near_duplicates, residue, vectors
from closura.llm.near_duplicates import NearDuplicates, Scheme, shingles


# --- problem 1 ----------------------------------------------------------------------------------------------------------
def _vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[3 : 3 + n // 5] = x[2]  # equal
    x[n // 2 : n // 2 + 30] = x[n // 2] + 1e-4 * rng.standard_normal((30, dim))  # nearly equal
    return x


def _neighbours(ids, x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = set()
    for i, a in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {(a, ids[j], r + 1) for r, j in enumerate(order)}
    return out


@pytest.mark.parametrize("block", [64, 4096])
def test_similar_vectors_equal_brute_force(spark, block):
    ids, x = list(range(10, 310)), _vectors(300, 8)
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x, strict=True)]
    bad = [(1, None, ""), (2, [1.0] * 7, ""), (3, [0.0] * 8, ""), (4, [float("nan")] * 8, ""), (5, [None] * 8, ""), (None, [1.0] * 8, ""), rows[0]]
    df = spark.createDataFrame(rows + bad, "ids long, embeddings array<float>, nbr string")
    got = vectors.similar_vectors(df, k=5, dim=8, block_rows=block)
    want = _neighbours(ids, x, 5)
    have = {(r["id"], r["nbr"], r["rank"]) for r in got.collect()}
    assert len(have & want) >= 0.999 * len(want) and len(have) == len(want)  # a rounding tie may differ between BLAS calls
    assert vectors.similar_pairs(df.limit(0), k=5, dim=8).count() == 0


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "ids long, embeddings array<float>")
    got = {(r["id"], r["nbr"], r["rank"], round(r["sim"], 6)) for r in vectors.similar_vectors(df, dim=2).collect()}
    assert got == {(1, 2, 1, 1.0), (1, 3, 2, 0.0), (2, 1, 1, 1.0), (2, 3, 2, 0.0), (3, 1, 1, 0.0), (3, 2, 2, 0.0)}


def _shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in stages}


def test_vectors_are_not_copied_for_tiles(spark):
    """What is shuffled and kept on disk doesn't grow with the number of blocks."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((800, 64)))], "ids long, embeddings array<float>")
    moved = []
    for block in (4096, 16):
        before = _shuffled(spark)
        assert vectors.similar_pairs(df, block_rows=block).count() > 0
        moved.append(sum(n for k, n in _shuffled(spark).items() if k not in before))
    assert moved[1] < 1.5 * moved[0]


def test_staged_vectors_and_their_shuffles_go(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    df = spark.createDataFrame([(i, [float(i // 2), 1.0]) for i in range(40)], "ids long, embeddings array<float>")
    was = set(files())
    got = vectors.similar_vectors(df, dim=2, k=3, block_rows=8)
    assert not [f for f in set(files()) - was if "shuffle_" in f]
    kept = {p.rsplit("/", 2)[0] for p in got.inputFiles()}
    assert len(kept) == 1
    folder = kept.pop().removeprefix("file://")
    assert len(os.listdir(folder)) == 2  # equal vectors and the lists
    assert got.count() == 120
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


# --- problem 4 ----------------------------------------------------------------------------------------------------------
def _texts(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n // 4):
        base = [rng.choice(vocab) for _ in range(rng.choice([12, 40, 90, 200]))]
        for _ in range(4):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            out.append(" ".join(t))
    return out


def _similar(texts, words, t, least):
    s = {i: set(x.tolist()) for i, text in enumerate(texts) if text is not None and (x := shingles(text, words, least)) is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


@pytest.mark.parametrize(("seed", "words", "t"), [(1, 3, 0.7), (2, 5, 0.8)])
def test_near_duplicates_lose_nothing(spark, monkeypatch, seed, words, t):
    texts = [*_texts(seed), None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    n = NearDuplicates(df, words, t, 10)
    got = [(r["id_a"], r["id_b"]) for r in n.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == _similar(texts, words, t, 10)
    groups = {r["id"]: r["group_id"] for r in n.groups().collect()}
    assert all(groups[a] == groups[b] for a, b in got) and len(groups) == len([x for x in texts if x and shingles(x, words, 10) is not None])


def test_near_duplicates_when_everything_is_common(spark, monkeypatch):
    """No shingle counts as rare: all sets are weak and the exact remainder has to find every pair."""
    monkeypatch.setattr(near_duplicates, "RARE", 0)
    texts = _texts(5, 24)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {(r["id_a"], r["id_b"]) for r in NearDuplicates(df, 3, 0.7, 1).pairs().collect()}
    assert got == _similar(texts, 3, 0.7, 1)


def test_near_duplicates_empty(spark):
    n = NearDuplicates(spark.createDataFrame([], "id long, text string"))
    assert n.pairs().count() == 0 and n.groups().count() == 0


@given(st.sets(st.integers(0, 400), min_size=1, max_size=150), st.integers(0, 40), st.randoms(use_true_random=False))
@settings(max_examples=150, deadline=None)
def test_bands_bound_the_distance(a, edits, rng):
    """Similar sets share a band, and differ by no more than the bound of that band."""
    b = set(a)
    for _ in range(edits):
        b ^= {rng.randrange(400)}
    if not b or len(a & b) < 0.7 * len(a | b):
        return
    s = Scheme(0.7)
    i, j = sorted((s.band(len(a)), s.band(len(b))))
    assert j - i <= 1
    assert len(a ^ b) <= min(s.most_apart(len(a), j), s.most_apart(len(b), j))
    n1, n2, k2 = s.shape(j)
    assert n1 * (k2 + 1) > floor_gap(s, j) and n2 > k2


def floor_gap(s, j):
    return int(2 * s.bands[j][1] * s.gap)


# --- problem 6 ----------------------------------------------------------------------------------------------------------
def _runs(doc, item, n=12):
    f = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    g = lambda t: {tuple(f(t)[i : i + n]) for i in range(len(f(t)) - n + 1)}
    return bool(g(doc) & g(item))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"t{i}" for i in range(200)]
    line = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(line(rng.choice([5, 12, 30, 60])))) for i in range(20)] + [(90, None), (91, "")]
    docs = []
    for d in range(120):
        t = line(rng.choice([3, 20, 100]))
        if d % 2:
            src = items[rng.randrange(20)][1].split()
            n, at = rng.choice([8, 11, 12, 13, 20]), rng.randrange(len(t) + 1)
            s = rng.randrange(max(1, len(src) - n + 1))
            t[at:at] = src[s : s + n]
        docs.append((d, rng.choice([" ", "-", "\r\n"]).join(t).upper() if d % 3 else " ".join(t), d))
    docs += [(500, None, 0), (501, "", 0), (0, docs[0][1], 0)]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string, item_id long"), spark.createDataFrame(items, "item_id long, text string"))
    have = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    assert len(have) == len(set(have))
    assert set(have) == {(d, i) for (d, t, _), (i, x) in itertools.product(docs, items) if _runs(t, x)}


def test_paraphrases(spark):
    words = [f"w{i}" for i in range(400)]
    rng = random.Random(9)
    item = rng.sample(words, 60)
    moved = [w for i, w in enumerate(item) if i % 9]  # drops every ninth word
    docs = [(1, " ".join(moved)), (2, " ".join(rng.sample(words, 80))), (3, None)] + [(10 + i, " ".join(rng.choices(words, k=80))) for i in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leakage.paraphrased_items(d, i).collect()] == [(1, 7)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leakage.leaked_items(empty, i).count() == 0 and leakage.leaked_items(d, i.limit(0)).count() == 0


def test_paraphrase_recall(spark):
    """Passages with words dropped, replaced and swapped; the figures are in the README."""
    rng = random.Random(12)
    vocab = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{i}" for i in range(3000)]
    word = lambda: vocab[min(2999, int(20 * rng.paretovariate(1)) - 20)]  # the most frequent word is a twentieth of the text, as in prose
    items = [(i, [word() for _ in range(rng.randint(60, 120))]) for i in range(60)]
    docs, want = [], set()
    for d in range(300):
        text = [word() for _ in range(rng.randint(30, 300))]
        if d % 2:
            i, src = items[rng.randrange(60)]
            part = [w if rng.random() > 0.1 else word() for w in src if rng.random() > 0.12]
            for _ in range(4):
                p = rng.randrange(len(part) - 1)
                part[p], part[p + 1] = part[p + 1], part[p]
            at = rng.randrange(len(text))
            text[at:at] = part
            want.add((d, i))
        docs.append((d, " ".join(text)))
    got = leakage.paraphrased_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"))
    have = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    print("paraphrases", len(want), len(have & want), len(have - want))
    assert len(have & want) >= 0.9 * len(want) and len(have - want) <= 0.02 * len(want)


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_CHARS", 200)
    text = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(12)]
    docs = spark.createDataFrame([(i, "intro " + t) for i, t in enumerate(text)], "doc_id long, text string")
    items = spark.createDataFrame([(100 + i, t) for i, t in enumerate(text)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(docs, items).collect()} == {(i, 100 + i) for i in range(12)}


@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
@settings(max_examples=100, deadline=None)
def test_common_run(a, b):
    want = max((n for n in range(1, len(a) + 1) for i in range(len(a) - n + 1) for j in range(len(b) - n + 1) if a[i : i + n] == b[j : j + n]), default=0)
    assert leakage.common_run(np.array(a, np.uint32), np.array(b, np.uint32)) == want


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=100, deadline=None)
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    assert leakage.common_subsequence(np.array(a, np.uint64), np.array(b, np.uint64)) == row[-1]


# --- problem 7 ----------------------------------------------------------------------------------------------------------
def test_split_tree_keeps_counts():
    counts, rng = np.array([100, 7, 0, 33]), np.random.default_rng(1)
    out = mixing.split_tree(counts, 9, rng)
    assert out.sum(0).tolist() == counts.tolist() and out.sum(1).max() - out.sum(1).min() <= 1 and (out >= 0).all()


def _mix_tables(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(3, 60)))
    docs = [(i, "Big" if i % 3 else " big ", text()) for i in range(600)] + [(1000 + i, "small-one", text()) for i in range(40)] + [(2000 + i, None, text()) for i in range(5)] + [(3000, "other", text()), (3001, "big", None), (3002, "big", "  ")]
    w = [("big", 0.5, 1), ("small_one", 0.3, 3), ("missing", 0.2, 2)]
    return spark.createDataFrame(docs, "doc_id long, source string, text string"), spark.createDataFrame(w, "source string, weight double, max_repeats int")


def test_mix(spark):
    docs, w = _mix_tables(spark)
    m = mixing.Mix(docs, w, shard_tokens=1000)
    sel = [r.asDict() for r in m.selection().collect()]
    sh = {r["source"]: r for r in m.shares().collect()}
    assert abs(sh["big"]["share"] - 0.625) < 0.01 and abs(sh["small_one"]["share"] - 0.375) < 0.01 and sh["missing"]["tokens"] == 0
    uses = {}
    for r in sel:
        uses.setdefault((r["source"], r["doc_id"]), []).append(r["copy"])
    assert all(len(c) == len(set(c)) <= {"big": 1, "small_one": 3}[s] for (s, _), c in uses.items())
    assert not {r["doc_id"] for r in sel} & {3000, 3001, 3002}
    for k in {r["shard"] for r in sel}:
        assert sorted(r["pos"] for r in sel if r["shard"] == k) == list(range(1, sum(r["shard"] == k for r in sel) + 1))
    assert max(sum(r["n_tokens"] for r in sel if r["shard"] == k) for k in range(m.shards)) < 2000
    assert sel == [r.asDict() for r in mixing.Mix(docs, w, shard_tokens=1000).selection().collect()] or sorted(map(str, sel)) == sorted(str(r.asDict()) for r in mixing.Mix(docs, w, shard_tokens=1000).selection().collect())
    assert mixing.Mix(docs.limit(0), w).selection().count() == 0


def test_mix_limits(spark, monkeypatch):
    """Units larger than shards, several uses a unit, a source that may not be used and one that may be used once by default."""
    docs, _ = _mix_tables(spark)
    w = spark.createDataFrame([("big", 0.2, None), ("small_one", 0.7, 40), ("other", 0.1, 0)], "source string, weight double, max_repeats int")
    monkeypatch.setattr(mixing, "UNITS", 12)
    m = mixing.Mix(docs, w, shard_tokens=500)
    assert m.within > 1 and m.units.count() <= 4 * 12 and set(m.sources) == {"big", "small_one"}
    rows = {r["source"]: r for r in m.invariants().collect()}
    assert all(r["in_target"] and r["repeats_kept"] and r["uses_distinct"] for r in rows.values()) and len(rows) == 2
    sel = m.selection().groupBy("shard").agg({"n_tokens": "sum", "pos": "max", "*": "count"}).collect()
    assert all(r["max(pos)"] == r["count(1)"] for r in sel) and len(sel) > 12


# --- problem 8 ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Dear {{name}}, the job has run.", True), ("Since ${VERSION} it works", True), ("Released as [INSERT DATE HERE].", True), ("Ask <your team here> first", True), ("Welcome to <project name>.", True), ("Moved to %(owner)s on __DATE__", True),
        ("Use `{{name}}` in templates", False), ('template = "${X}"', False), ("Example:\n\n```\n<b>{{x}}</b>\n```\n", False), ("> Dear {{name}}", False), ('File "a.py", line 3, in <module>', False), ("List<String> of <b>bold</b>", False), ("", False), ("the renderer leaves \"{{name}}\" alone", False),
    ],
)
def test_placeholders(text, want):
    assert residue.placeholder(text) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please enable JavaScript to continue.", True), ("Guide | docs\nBitte JavaScript einschalten, um die Seite zu sehen.\n(c) the team", True), ("404\nThe page you asked for does not exist.\nHome", True), ("Lorem ipsum dolor sit amet elit", True), ("tbd tbd tbd tbd tbd", True), ("1. first item\n2. another point", True),
        ("Our page works without JavaScript now; only the graph asks the reader to enable it.", False), ("I get 502 Bad Gateway from the proxy whenever it restarts.", False), ("Fix the page not found handler\n\nAdds a test for it and two more cases of the router.", False), ("Fold stale listener", False), ("", False), ("\n \n", False),
    ],
)
def test_no_content(text, want):
    read = residue.Reading(text)
    assert (read.longest() is None and any(k == 2 for _, k in read.segments())) is want


def test_residue_spreads_to_small_edits(spark):
    notice = "Something went wrong on our side while we were loading the requested document for you from the archive of the service, so nothing can be shown at the moment here."
    edited = notice.replace("Something", "Somewhat")
    good = "The archive keeps a copy of every document, and the service loads it when the reader asks for it, so that old versions can be compared."
    gone = "This repositories is unavailable because it was removed or made private (ref 77)."  # like an example
    docs = [(1, notice), (2, edited), (3, good), (4, None), (5, " "), (6, "Dear {{name}}, " + good), (7, good), (2, edited), (8, gone + " Check back later!"), (9, gone + "\n" + good), (10, "Check back later."), (11, "Archive\n" + gone + "\n" + edited)]
    got = sorted((r["doc_id"], r["kind"], r["found_by"]) for r in residue.residue(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, "no_content", "rule"), (2, "no_content", "similar"), (2, "no_content", "similar"), (6, "placeholder", "rule"), (8, "no_content", "similar"), (11, "no_content", "similar")]
    assert residue.residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_notice():
    """Lines of more than LINE words are judged by their sentences."""
    notice = "Please enable JavaScript to continue. " + "The scripts of this site draw the whole viewer and without them there is nothing that the browser could show to you. " * 3
    assert residue.Reading(notice).longest() is None and len(notice.split()) > residue.LINE
    assert residue.Reading(notice + "The parser folds constants before the second pass.").longest() == "the parser folds constants before the second pass."


def test_table_recall(spark):
    """Pairs that the tables find against all pairs, by similarity; the figures are in the README."""
    from closura.plans.staging import Stage

    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([8, 15, 30, 60]))] for _ in range(220)]
    texts = {" ".join(t) for t in base}
    for t in base:
        for _ in range(4):
            e = list(t)
            for _ in range(rng.randint(1, max(1, len(t) // 7))):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            texts.add(" ".join(e))
    texts = sorted(texts)
    grams = [frozenset(residue.grams(t).tolist()) for t in texts]
    want = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = grams[i], grams[j]
        if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (s := len(a & b) / len(a | b)) >= 0.8:
            want[frozenset((texts[i], texts[j]))] = s
    graph = residue.Segments(spark.createDataFrame([(t, 1) for t in texts], "segment string, label int"), Stage(spark, "recall"))
    name = {bytes(r["b"]): r["segment"] for r in graph.nodes.collect()}
    got = {frozenset((name[bytes(r["a"])], name[bytes(r["b"])])) for r in graph.similar(graph.nodes, graph.nodes).collect()}
    assert got <= set(want)
    low = [p for p, s in want.items() if s < 0.85]
    share = lambda pairs: sum(p in got for p in pairs) / len(pairs)
    print("recall", len(want), len(low), share(low), share(list(want)))
    assert len(low) > 100 and share(low) >= 0.9 and share(list(want)) >= 0.95


def test_long_text_is_read_whole(spark):
    text = "word " * 200_000 + "Dear {{name}}, hello"
    assert residue.residue(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 1
