"""Vector retrieval for seeds: the mean query vector, the ranking by cosine, and checks of an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in one block: a matrix of QUERIES rows goes to every task.
QUERIES = 1024


def index_report(df: DataFrame, ids: str = "ids", vec: str = "embeddings", dim: int = 64) -> DataFrame:
    """(issue, n_rows) of an index: null, wrong length, not finite, zero, not of unit length (1e-4), repeated id."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(vec, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    issue = (
        F.when(F.col(vec).isNull() | F.col(ids).isNull(), "null").when(F.size(vec) != dim, "wrong length").when(~finite, "not finite").when(square == 0, "zero").when(F.abs(F.sqrt(square) - 1) > 1e-4, "not unit")
    )
    per_row = df.select(issue.alias("issue")).where("issue is not null").groupBy("issue").agg(F.count(F.lit(1)).alias("n_rows"))
    twice = df.where(F.col(ids).isNotNull()).groupBy(ids).agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").agg(F.sum("n").alias("n_rows")).where("n_rows > 0")
    return per_row.union(twice.select(F.lit("repeated id"), "n_rows"))


def clean_index(df: DataFrame, ids: str = "ids", vec: str = "embeddings", dim: int = 64) -> DataFrame:
    """(id, vec): usable rows, unit vectors in double precision; of an id's vectors the smallest."""
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(ids).alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull())).where(finite)
    return rows.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_unit, "id long, vec array<double>")


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of length above 0, divided by it (scaled by the largest value first, so nothing overflows)."""
    for b in batches:
        if b.num_rows:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            most = np.abs(v).max(1, keepdims=True)
            ok = most[:, 0] > 0
            v = v[ok] / most[ok]
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            flat = pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), flat], names=["id", "vec"])


def query_vectors(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(trial, q): unit vector of the mean of each trial's seed vectors. Seeds without a vector are left out; a trial
    whose vectors cancel out has none."""
    rows = seeds.select("trial", F.col("node").alias("id")).distinct().join(index, "id").select("trial", F.posexplode("vec").alias("i", "x"))
    mean = rows.groupBy("trial", "i").agg(F.avg("x").alias("x")).groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    v = mean.select("trial", F.transform("v", lambda s: s["x"]).alias("v")).withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    return v.where("len > 1e-12").select("trial", F.transform("v", lambda x: F.try_divide(x, F.col("len"))).alias("q"))


def cosine_rank(index: DataFrame, seeds: DataFrame, top: int | None = None) -> DataFrame:
    """(trial, node, score, place): non-seed vectors by descending cosine (rounded to 9 decimals), ties by id.

    Queries meet the index in blocks of about QUERIES, each sent to the tasks as one matrix (its size is checked by
    counting), so the index is scanned once a block and never shuffled. With ``top`` a task keeps only what can still be
    among the first ``top`` of a trial after its own seeds are taken out.
    """
    spark = index.sparkSession
    q = query_vectors(index, seeds)
    n = q.count()
    blocks = max(1, -(-n // QUERIES))
    most = seeds.groupBy("trial").agg(F.countDistinct("node").alias("n")).agg(F.max("n")).first()[0] or 0
    keep = None if top is None else top + most
    out = None
    for k in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("trial"), F.lit(blocks)) == k).collect()  # about QUERIES rows
        held = spark.sparkContext.broadcast((np.array([r["trial"] for r in rows], np.int64), np.array([r["q"] for r in rows], np.float64).reshape(len(rows), -1)))
        part = index.select("id", "vec").mapInArrow(_scores(held, keep), "trial long, node long, score double")
        out = part if out is None else out.union(part)
    scored = out.join(seeds.select("trial", "node").distinct(), ["trial", "node"], "left_anti")
    w = Window.partitionBy("trial").orderBy(F.desc("score"), "node")
    ranked = scored.withColumn("place", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("place") <= top)


def _scores(held, keep: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trials, q = held.value
        for b in batches:
            if not b.num_rows or not len(trials):
                continue
            ids = b.column("id").to_numpy(zero_copy_only=False)
            s = np.round(b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) @ q.T, 9)
            t, i = np.meshgrid(np.arange(len(trials)), np.arange(len(ids)), indexing="ij")
            t, i, v = t.ravel(), i.ravel(), s.T.ravel()
            if keep is not None and keep < len(ids):
                order = np.lexsort((ids[i], -v, t)).reshape(len(trials), len(ids))[:, :keep].ravel()
                t, i, v = t[order], i[order], v[order]
            yield pa.RecordBatch.from_arrays([pa.array(trials[t]), pa.array(ids[i]), pa.array(v)], names=["trial", "node", "score"])

    return run


def build_index(texts: DataFrame, encode, dim: int) -> DataFrame:
    """(ids, embeddings) of (id, text): ``encode`` maps a list of texts to an array of (n, dim), batch by batch in the tasks.

    Rows are divided by their length. A blank or null text, a repeated id or a vector that is not finite or of length 0
    fails the build, as an index must match its symbols one to one.
    """
    if texts.groupBy("id").count().where("count > 1 or id is null").limit(1).count():
        raise ValueError("ids must be unique and not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.column("text").to_pylist()
            if any(x is None or not x.strip() for x in held):
                raise ValueError("a text is blank")
            if not held:
                continue
            v = np.asarray(encode(held), np.float64).reshape(len(held), dim)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            if not np.isfinite(v).all() or (n <= 0).any():
                raise ValueError("a vector is not finite or of length 0")
            flat = pa.array((v / n).ravel().astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(np.arange(0, v.size + 1, dim, dtype=np.int32), flat)], names=["ids", "embeddings"])

    return texts.select("id", "text").mapInArrow(run, "ids long, embeddings array<float>")
