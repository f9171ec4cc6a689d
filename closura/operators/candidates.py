"""Optional context: candidate sources, scores, the capped pool, identity hints and the one-hop baseline's ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators.graph import Graph

#: (name, level, weight, confidence, available); the last two need runtime evidence, of which there is none.
SOURCES = (("static_caller", 2, 1.0, 1.0, True), ("sibling_implementation", 2, 0.7, 1.0, True), ("covering_test", 3, 1.2, 1.0, False), ("observed_caller", 2, 1.3, 1.0, False))


def static_callers(g: Graph, seeds: DataFrame, hub: int = T.HUB) -> DataFrame:
    """(trial, node, seed): callers of seeds. Seeds with more than ``hub`` incoming edges are left out before the join."""
    cool = g.degrees().where(F.col("in_degree") <= hub).select(F.col("id").alias("dst"))
    s = seeds.select("trial", F.col("node").alias("dst")).distinct().join(cool, "dst", "left_semi")
    return s.join(g.hard.where("type = 'CALLS'"), "dst").select("trial", F.col("src").alias("node"), F.col("dst").alias("seed"))


def siblings(g: Graph, seeds: DataFrame) -> DataFrame:
    """(trial, node, seed): other implementations of an interface of a seed; not those that are themselves such a seed."""
    s, imp = seeds.select("trial", F.col("node").alias("seed")).distinct(), g.hard.where("type = 'IMPLEMENTS'").select("src", "dst")
    via = s.join(imp, F.col("seed") == F.col("src")).select("trial", "seed", "dst")
    found = via.join(imp.withColumnRenamed("src", "node"), "dst")
    own = via.select("trial", "dst", F.col("seed").alias("node"))
    return found.join(own, ["trial", "dst", "node"], "left_anti").select("trial", "node", "seed").distinct()


def candidates(g: Graph, seeds: DataFrame, emitted: DataFrame) -> DataFrame:
    """(trial, node, source, links, first_link, score, bound, l2): scored candidates, the best source of each.

    Left out: seeds, nodes of ``emitted`` (trial, node), and symbols that enclose a seed by name. ``bound`` is the score
    a token of the candidate's own text, an upper bound of its value in the packer.
    """
    n = g.symbols.count()
    own = [F.struct(F.lit(name).alias("source"), F.lit(i).alias("place"), F.lit(w * c).alias("weight")) for i, (name, _, w, c, on) in enumerate(SOURCES) if on]
    links = static_callers(g, seeds).select("*", own[0].alias("s")).union(siblings(g, seeds).select("*", own[1].alias("s"))).select("trial", "node", "seed", "s.*")
    links = links.join(seeds.select("trial", "node").distinct(), ["trial", "node"], "left_anti").join(emitted.select("trial", "node"), ["trial", "node"], "left_anti")
    by = links.groupBy("trial", "node", "source", "place", "weight").agg(F.count(F.lit(1)).alias("links"), F.min("seed").alias("first_link"))
    by = by.join(g.symbols.select(F.col("id").alias("node"), "fqn", "l2"), "node").join(g.degrees().select(F.col("id").alias("node"), "out_degree"), "node")
    names = seeds.select("trial", "node").distinct().join(g.symbols.select(F.col("id").alias("node"), F.col("fqn").alias("seed_fqn")), "node").select("trial", "seed_fqn")
    enclosing = by.select("trial", "node", "fqn").distinct().join(names, "trial").where(F.col("seed_fqn").startswith(F.concat("fqn", F.lit(".")))).select("trial", "node").distinct()
    by = by.join(enclosing, ["trial", "node"], "left_anti")
    by = by.withColumn("score", T.relevance(F.col("weight"), F.col("links")) * T.idf(n, "out_degree"))
    best = Window.partitionBy("trial", "node").orderBy(F.desc("score"), "place")
    return by.withColumn("r", F.row_number().over(best)).where("r = 1").select("trial", "node", "source", "links", "first_link", "score", (F.col("score") / F.greatest("l2", F.lit(1))).alias("bound"), "l2")


def pool(scored: DataFrame, cap: int = T.POOL) -> DataFrame:
    """The ``cap`` candidates of each trial with the highest bound; ties go to the smaller id. Adds ``place``."""
    w = Window.partitionBy("trial").orderBy(F.desc("bound"), "node")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def one_hop(g: Graph, seeds: DataFrame) -> DataFrame:
    """(trial, node, seed, type, way): neighbours of the seeds over one propagating edge, either way; links repeat."""
    s = seeds.select("trial", F.col("node").alias("seed")).distinct()
    out = s.join(g.hard, F.col("seed") == F.col("src")).select("trial", F.col("dst").alias("node"), "seed", "type", F.lit("out").alias("way"))
    into = s.join(g.hard, F.col("seed") == F.col("dst")).select("trial", F.col("src").alias("node"), "seed", "type", F.lit("in").alias("way"))
    return out.union(into).join(seeds.select("trial", "node").distinct(), ["trial", "node"], "left_anti")


def graph_ranking(g: Graph, seeds: DataFrame) -> DataFrame:
    """(trial, node, links, out_degree, place): one-hop neighbours by descending idf, that is ascending out-degree."""
    near = one_hop(g, seeds).groupBy("trial", "node").agg(F.count(F.lit(1)).alias("links"))
    ranked = near.join(g.degrees().select(F.col("id").alias("node"), "out_degree"), "node")
    return ranked.select("trial", "node", "links", "out_degree", F.row_number().over(Window.partitionBy("trial").orderBy("out_degree", "node")).alias("place"))


def hint_pool(g: Graph, levels: DataFrame, extra: DataFrame) -> DataFrame:
    """(trial, node, ident, score, place): level-1 nodes and ``extra`` (trial, node, score), neither emitted nor charged."""
    one = levels.where("level = 1").select("trial", "node").withColumn("score", F.lit(None).cast("double"))
    both = one.union(extra.select("trial", "node", "score")).groupBy("trial", "node").agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("score"))
    both = both.join(levels.where("level >= 2").select("trial", "node"), ["trial", "node"], "left_anti").join(g.mandatory_identities(levels).select("trial", "node"), ["trial", "node"], "left_anti")
    ranked = both.join(g.symbols.select(F.col("id").alias("node"), "ident"), "node")
    w = Window.partitionBy("trial").orderBy(F.desc("score"), "ident", "node")
    return ranked.select("trial", "node", "ident", "score", F.row_number().over(w).alias("place"))


def fill_hints(hints: DataFrame, caps: DataFrame) -> DataFrame:
    """(trial, considered, chosen, tokens, truncated, nodes): takes hints in order, passing over those that don't fit ``cap``."""
    rows = hints.groupBy("trial").agg(F.array_sort(F.collect_list(F.struct("place", "node", F.col("ident").cast("long").alias("ident")))).alias("h")).join(caps, "trial")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("nodes"))
    take = lambda a, x: a["used"] + x["ident"] <= F.col("cap")
    step = lambda a, x: F.when(take(a, x), F.struct((a["used"] + x["ident"]).alias("used"), F.concat(a["nodes"], F.array(x["node"])).alias("nodes"))).otherwise(a)
    return rows.select("trial", F.size("h").alias("considered"), F.aggregate("h", start, step).alias("a")).select("trial", "considered", F.size("a.nodes").alias("chosen"), F.col("a.used").alias("tokens"), (F.size("a.nodes") < F.col("considered")).alias("truncated"), F.col("a.nodes").alias("nodes"))
