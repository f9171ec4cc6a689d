import random

import pytest
from helpers import RAW_EDGE, RAW_SYMBOL, graph, rows, sym
from pyspark.sql import functions as F

import __spark_entry__
from closura.operators import cosine_admission, packing, retrieval
from closura.plans.staging import Stage


@pytest.mark.parametrize("piece", [1, 4, 500])
def test_same_as_ranking_first(spark, piece, monkeypatch):
    """Equal scores, null files, repeated, own and unknown references, vectors without a symbol, identities above prices."""
    rng = random.Random(11)
    syms = [sym(i, l2=rng.choice([0, 5, 12, 40, 90]), prov=rng.choice([0, 5]), ident=rng.choice([3, 18, 60]), file=rng.choice(["a", "b", "c", None]), refs2=[rng.randrange(1, 130) for _ in range(rng.choice([0, 1, 4]))], refs3=[5, 6, 9, 999]) for i in range(1, 120)]
    g = graph(spark, "", syms)
    turn = [(1.0, 0.0), (0.8, 0.6), (0.6, 0.8), (0.0, 1.0), (-0.6, 0.8)]
    index = retrieval.clean_index(spark.createDataFrame([(i, list(turn[rng.randrange(5)])) for i in range(1, 125)], "ids long, embeddings array<float>"), dim=2)
    seeds = spark.createDataFrame([(t, n) for t in range(7) for n in (3 * t + 1, 3 * t + 2)] + [(0, 777), (7, 130), (8, 40)], "trial long, node long")
    budgets = spark.createDataFrame([(t, 420 + 90 * t) for t in range(8)] + [(8, 150)], "trial long, budget long")
    monkeypatch.setattr(cosine_admission, "TRIALS", 3)
    monkeypatch.setattr(cosine_admission, "CELLS", 60)
    want = rows(packing.in_rank_order(g, seeds, retrieval.cosine_rank(index, seeds), budgets.where("trial <> 8")))
    got = cosine_admission.in_cosine_order(g, index, seeds, budgets, piece)
    assert rows(got) == want and len(want) > 40  # trial 8 costs more than its budget, 7 has no known seed


def test_rounds_do_not_grow_with_the_vectors(spark, save, monkeypatch):
    """4,999 vectors that can't be told from their own tokens to be too dear stand before the only one that fits."""
    n = spark.range(1, 5002)
    last, seed = F.col("id") == 5001, F.col("id") == 100
    of = {"id": F.col("id"), "fqn": F.concat(F.lit("p.s"), F.col("id")), "kind": F.when(seed, "function").otherwise("class"), "file": F.when(seed | last, "a").otherwise("b"), "repr_L2_tokens": F.when(last, 0).otherwise(20), "repr_L3_tokens": F.when(seed, 475).otherwise(9), "identity_tokens": F.when(last, 0).otherwise(25), "provenance_tokens": F.lit(0)}
    kinds = [x.split(" ", 1) for x in RAW_SYMBOL.split(", ")]
    symbols = n.select(*[of.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds])
    angle = F.when(seed, 0.0).otherwise(F.col("id") * 0.0003)
    vectors = n.select(F.col("id").alias("ids"), F.concat(F.array(F.cos(angle), F.sin(angle)), F.array_repeat(F.lit(0.0), 62)).cast("array<float>").alias("embeddings"))
    d = save(symbols=symbols, edges=spark.createDataFrame([], RAW_EDGE), vector_index=vectors)
    put, staged = Stage.put, []
    monkeypatch.setattr(Stage, "put", lambda self, df, **k: staged.append(put(self, df, **k)) or staged[-1])
    got = __spark_entry__.queries()["arm_a_admission"](spark, d)
    assert rows(got, "trial", "place", "node", "cost") == [(0, 5000, 5001, 6)]
    assert len(staged) <= 10
