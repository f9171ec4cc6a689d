"""Finding entry points: by name, by traceback, by words, and reranking them by how connected they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators.graph import Graph


class SeedError(ValueError):
    """Names or tasks that lead to no symbol; the message names them all."""


def resolve_names(names: DataFrame, g: Graph, shown: int = 5) -> DataFrame:
    """(query, id, n_matches, error) for each distinct ``query``: the exact name, else the only name that ends in '.query'.

    Names are exploded to their dotted suffixes, so the suffix match is an equi-join instead of a product.
    """
    q = names.select("query").where("query is not null").distinct()
    parts = F.split("fqn", r"\.")
    full = g.symbols.where("fqn is not null").select("id", "fqn", F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("skip"), parts.alias("p"))
    suffix = full.select("id", "fqn", (F.col("skip") == 0).alias("exact"), F.array_join(F.slice("p", F.col("skip") + 1, F.size("p")), ".").alias("query"))
    hit = q.join(suffix, "query", "left").groupBy("query").agg(
        F.min(F.when(F.col("exact"), F.col("id"))).alias("exact_id"), F.count("id").alias("n"), F.min("id").alias("any_id"), F.slice(F.array_sort(F.collect_set("fqn")), 1, shown).alias("some")
    )
    one = F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("any_id")))
    more = F.when(F.col("n") > shown, F.format_string(" and %d more", F.col("n") - shown)).otherwise("")
    error = F.when(one.isNotNull(), None).when(F.col("n") == 0, F.concat(F.lit("no symbol matches '"), "query", F.lit("'"))).otherwise(F.concat(F.lit("'"), "query", F.lit("' is ambiguous: matches "), F.array_join("some", ", "), more))
    return hit.select("query", one.alias("id"), F.when(F.col("exact_id").isNotNull(), 1).otherwise(F.col("n")).cast("long").alias("n_matches"), error.alias("error"))


def word_matches(tasks: DataFrame, g: Graph, cap: int = T.RERANK) -> DataFrame:
    """(task_id, node, fqn, overlap, place): the symbols whose names share most words with each task (task_id, task).

    Joined by word; a word that names a large part of all symbols would be a hot key, so both sides are made distinct
    first and the counting happens per (task, symbol), which spreads it.
    """
    w = tasks.select("task_id", F.explode(T.words("task")).alias("w"))
    names = g.symbols.where("fqn is not null").select(F.col("id").alias("node"), "fqn", F.explode(T.words("fqn")).alias("w"))
    hits = w.join(names, "w").groupBy("task_id", "node", "fqn").agg(F.count(F.lit(1)).alias("overlap"))
    order = Window.partitionBy("task_id").orderBy(F.desc("overlap"), "fqn", "node")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def traceback_seeds(tasks: DataFrame, g: Graph, cap: int = T.TOP_SEEDS) -> tuple[DataFrame, DataFrame]:
    """((task_id, place, node), (task_id, frame, reason)): symbols at the frames of each traceback, innermost first, and
    the frames that lead nowhere.

    Frames meet symbols on the last part of the path; the rest of the path and the line range are conditions of that
    join. Of several symbols around a line those with the frame's name go first, then the shortest, then by name and id.
    """
    fr = tasks.select("task_id", F.posexplode(T.frames("task")).alias("frame", "f"))
    fr = fr.select("task_id", "frame", F.col("f.file").alias("file"), F.col("f.line").cast("int").alias("line"), F.col("f.name").alias("name")).withColumn("path", T.clean_path("file")).withColumn("base", F.substring_index("path", "/", -1))
    s = g.symbols.where("file is not null").select(F.col("id").alias("node"), "fqn", "kind", F.col("start_line").alias("lo"), F.when(F.coalesce("end_line", F.lit(0)) == 0, F.col("start_line")).otherwise(F.col("end_line")).alias("hi"), T.clean_path("file").alias("spath")).withColumn("base", F.substring_index("spath", "/", -1))
    there = fr.join(s, "base").where(T.same_path(F.col("path"), F.col("spath")))
    inside = there.where("lo <> 0 and line between lo and hi")
    named = (T.leaf("fqn") == F.col("name")) | ((F.col("name") == "<module>") & (F.col("kind") == "module"))
    pick = Window.partitionBy("task_id", "frame").orderBy(F.when(named, 0).otherwise(1), F.col("hi") - F.col("lo"), "fqn", "node")
    best = inside.withColumn("r", F.row_number().over(pick)).where("r = 1")
    once = best.groupBy("task_id", "node").agg(F.min("frame").alias("frame"))
    seeds = once.withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("frame"))).where(F.col("place") <= cap).select("task_id", "place", "node")
    lost = fr.join(best.select("task_id", "frame"), ["task_id", "frame"], "left_anti").join(there.select("task_id", "frame", F.lit(True).alias("known")).distinct(), ["task_id", "frame"], "left")
    reason = F.when(F.col("known"), "line is inside no known symbol").otherwise("file is not indexed")
    return seeds, lost.select("task_id", "frame", "file", "line", "name", reason.alias("reason"))


def connectivity(pool: DataFrame, g: Graph, hub: int = T.HUB) -> DataFrame:
    """(task_id, node, score): for each candidate (task_id, node) how many others of its task are within two CALLS either way.

    Calls of symbols with more than ``hub`` incoming edges are not read.
    """
    cool = g.degrees().where(F.col("in_degree") <= hub).select(F.col("id").alias("dst"))
    calls = g.hard.where("type = 'CALLS' and src <> dst").select("src", "dst")
    mine = pool.select("task_id", F.col("node").alias("dst")).join(cool, "dst", "left_semi").join(calls, "dst")
    inside = mine.join(pool.select("task_id", F.col("node").alias("src")), ["task_id", "src"], "left_semi").select("task_id", "src", "dst").distinct()
    two = inside.join(inside.select("task_id", F.col("src").alias("dst"), F.col("dst").alias("end")), ["task_id", "dst"]).where("src <> end").select("task_id", "src", F.col("end").alias("dst"))
    near = inside.union(two)
    peers = near.select("task_id", F.col("src").alias("node"), F.col("dst").alias("peer")).union(near.select("task_id", "dst", "src")).distinct().groupBy("task_id", "node").agg(F.count(F.lit(1)).alias("score"))
    return pool.select("task_id", "node").join(peers, ["task_id", "node"], "left").fillna(0, ["score"])


def resolve_tasks(tasks: DataFrame, g: Graph, top: int = T.TOP_SEEDS) -> DataFrame:
    """(task_id, place, node, how): seeds of each task text: its traceback if it holds one, else its words, reranked.

    A traceback of which no frame resolves gives no seeds. A task without words or matches gives none either.
    """
    traced = tasks.where(F.size(T.frames("task")) > 0)
    from_frames = traceback_seeds(traced, g, top)[0].select("task_id", "place", "node", F.lit("traceback").alias("how"))
    found = word_matches(tasks.where(F.coalesce(F.size(T.frames("task")), F.lit(0)) <= 0), g)
    ranked = found.join(connectivity(found, g), ["task_id", "node"]).withColumn("p", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("score"), "fqn", "node")))
    return from_frames.union(ranked.where(F.col("p") <= top).select("task_id", F.col("p").alias("place"), "node", F.lit("words").alias("how")))
