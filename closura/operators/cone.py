"""What may be affected by a change: reverse calls; bounded paths and reachability; why a symbol is in a context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators.graph import Graph
from closura.plans.staging import Stage


def impact_cone(g: Graph, roots: DataFrame, depth: int = 2, hub: int = T.HUB, frontier: int = T.CONE_FRONTIER) -> tuple[DataFrame, DataFrame]:
    """((root, node, depth), (root, node, reason)): callers of each root within ``depth`` (at most 2) calls, and where it stopped.

    Nodes with more than ``hub`` incoming edges are reported instead of expanded, before any join reads their edges. Of
    a level's nodes the ``frontier`` with the smallest ids are expanded, and the level after that is the last.
    """
    calls = g.hard.where("type = 'CALLS'").select(F.col("src").alias("caller"), F.col("dst").alias("node"))
    hot = g.degrees().where(F.col("in_degree") > hub).select(F.col("id").alias("node"))
    seen = front = roots.select("root", F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0))
    notes = None
    for d in range(1, min(depth, 2) + 1):
        w = Window.partitionBy("root").orderBy("node")
        placed = front.withColumn("r", F.row_number().over(w))
        cut = placed.where(F.col("r") > frontier).select("root", F.lit(None).cast("long").alias("node"), F.lit("frontier cap").alias("reason")).distinct()
        use = placed.where(F.col("r") <= frontier)
        hubs = use.join(hot, "node", "left_semi").select("root", "node", F.lit("hub").alias("reason"))
        notes = cut.union(hubs) if notes is None else notes.union(cut).union(hubs)
        new = use.join(hot, "node", "left_anti").join(calls, "node").select("root", F.col("caller").alias("node")).distinct()
        front = new.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
        if d == 1:  # a capped level is the last
            front = front.join(cut.select("root"), "root", "left_anti")
    return seen.where("depth > 0"), notes


def cone_top(g: Graph, cone: DataFrame, top: int = T.CONE_TOP) -> DataFrame:
    """(root, place, node, fqn, file, depth, idf): the ``top`` affected symbols with the fewest outgoing edges."""
    n = g.symbols.count()
    r = cone.join(g.degrees().select(F.col("id").alias("node"), "out_degree"), "node").join(g.symbols.select(F.col("id").alias("node"), "fqn", "file"), "node")
    w = Window.partitionBy("root").orderBy("out_degree", "node")
    return r.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("root", "place", "node", "fqn", "file", "depth", F.round(T.idf(n, "out_degree"), 3).alias("idf"))


def render_cone(name: str, counts: dict[int, int], top: list, notes: list) -> str:
    """Text for one root; ``top`` rows have fqn, file, depth and idf, ``notes`` node and reason."""
    out = [f"Symbols that a change of {name} may affect: {sum(counts.values())} (callers, an over-approximation)"]
    out += [f"  {d} call{'s' * (d > 1)} away: {n}" for d, n in sorted(counts.items())]
    hubs = sum(x["reason"] == "hub" for x in notes)
    if hubs:
        out.append(f"  not expanded, as they have more than {T.HUB} incoming edges: {hubs}")
    if any(x["reason"] != "hub" for x in notes):
        out.append("  cut off at the frontier cap: the result is partial")
    for file in sorted({x["file"] for x in top}):
        out += [f"# {file}", *(f"  {x['fqn'].rpartition('.')[2]}  depth {x['depth']}  idf {x['idf']}" for x in top if x["file"] == file)]
    return "\n".join(out)


def paths(g: Graph, sources: DataFrame, etype: str = "CALLS", longest: int = 2, reverse: bool = False) -> DataFrame:
    """(source, target, length, path): all directed walks of 1 to ``longest`` edges of a type without a repeated node."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = g.hard.where(F.col("type") == etype).select(F.col(a).alias("target"), F.col(b).alias("next"))
    cur = sources.select(F.col("source"), F.col("source").alias("target"), F.array("source").alias("path")).distinct()
    out = None
    for n in range(1, longest + 1):
        cur = cur.join(step, "target").where(~F.array_contains("path", F.col("next"))).select("source", F.col("next").alias("target"), F.concat("path", F.array("next")).alias("path"))
        found = cur.select("source", "target", F.lit(n).alias("length"), "path")
        out = found if out is None else out.union(found)
    return out


def path_procedure(g: Graph, sources: DataFrame, targets: DataFrame | None, etype: str, longest: int, count: int, reverse: bool = False) -> DataFrame:
    """Single-pair, single-source and multi-source paths: per source (and target, where given) the ``count`` shortest,
    ties by the ids along the path."""
    p = paths(g, sources, etype, longest, reverse)
    if targets is not None:
        p = p.join(targets.select("target").distinct(), "target", "left_semi")
    w = Window.partitionBy("source", "target").orderBy("length", "path") if targets is not None else Window.partitionBy("source").orderBy("length", "path")
    return p.withColumn("place", F.row_number().over(w)).where(F.col("place") <= count).select("source", "target", "length", "path", "place")


def reachable(g: Graph, sources: DataFrame, etypes: tuple[str, ...], longest: int) -> DataFrame:
    """(source, node, depth): smallest number of edges from each source, up to ``longest``; each node is expanded once."""
    step = g.hard.where(F.col("type").isin(*etypes)).select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = front = sources.select("source", F.col("source").alias("node")).distinct().withColumn("depth", F.lit(0))
    for d in range(1, longest + 1):
        front = front.join(step, "node").select("source", F.col("next").alias("node")).distinct().join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.union(front)
    return seen.where("depth > 0")


def referenced_by(g: Graph, levels: DataFrame) -> DataFrame:
    """(trial, node, by): identities of a context, and the emitted symbols whose text names them."""
    e = g.emitted(levels).select("trial", "profile", F.col("node").alias("by"), F.explode("refs").alias("node"))
    return e.join(g.mandatory_identities(levels).select("trial", "profile", "node"), ["trial", "profile", "node"], "left_semi").select("trial", "node", "by").distinct()


def explain(provenance: DataFrame, asked: DataFrame, longest: int = 8) -> DataFrame:
    """(trial, node, depth, via, edge, rule): every recorded reason from a node back to the seeds.

    ``provenance`` has (trial, node, via, edge, rule). Each node is visited once, at most ``longest`` steps away; the loop
    ends where a step finds nothing new.
    """
    stage = Stage(provenance.sparkSession, "explain")
    step = stage.put(provenance.select("trial", F.col("node").alias("at"), "via", "edge", "rule"))
    cur = seen = stage.put(asked.select("trial", "node", F.col("node").alias("at")).distinct())
    out = None
    for d in range(1, longest + 1):
        hit = cur.join(step, ["trial", "at"]).select("trial", "node", F.lit(d).alias("depth"), "via", "edge", "rule")
        out = hit if out is None else out.union(hit)
        cur, n = stage.counted(hit.select("trial", "node", F.col("via").alias("at")).distinct().join(seen, ["trial", "node", "at"], "left_anti"))
        if not n:
            break
        seen = seen.union(cur)
    return out


def render_explanation(name: str, found: dict) -> str:
    """Text for one symbol; ``found`` has present, level, seed and chain (depth, name, edge, rule), or referenced_by."""
    if not found["present"]:
        by = found["referenced_by"]
        return "\n".join([f"{name}  -- not in the compiled context.", *(["Named (not emitted) by:", *(f"  <- {x}" for x in by)] if by else ["Nothing in the context names it; give it as a seed to include it."])])
    lines = [f"{name}  [L{found['level']}]"] + (["  a seed, not pulled in by a rule"] if found["seed"] else [])
    lines += [f"  <- {via}  {edge}  (rule: {rule})" for _, via, edge, rule in found["chain"]]
    packed = sum(edge.startswith("OPTIONAL:") for _, _, edge, _ in found["chain"])
    if rules := len(found["chain"]) - packed:
        lines.append(f"  rules that fired: {rules}")
    return "\n".join(lines + ([f"  steps through optional packing: {packed}"] if packed else []))
