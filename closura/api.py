"""The engine as an object: compile a context, explain it, show what a change may affect, or retrieve by vectors.

    engine = Engine(spark, "/data/graph")
    print(engine.compile(["pkg.mod.f"], budget=8000)["text"])
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators import cone, emission, packing, retrieval
from closura.operators import seeds as S
from closura.operators.graph import Graph
from closura.plans.harness import Compiled
from closura.sources.tables import table


class Engine:
    """Tables ``symbols`` and ``edges`` (and ``vector_index`` for retrieval by vectors) below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.g = spark, root, Graph.load(spark, root)
        self.last: Compiled | None = None

    def _ids(self, names: list[str] | None, task: str | None) -> list[int]:
        """Ids of the seeds; names beat a task. All names that fail are reported together."""
        if names:
            rows = {r["query"]: r for r in S.resolve_names(self.spark.createDataFrame([(n,) for n in names], "query string"), self.g).collect()}
            bad = [rows[n]["error"] for n in dict.fromkeys(names) if rows[n]["error"]]
            if bad:
                raise S.SeedError("; ".join(bad))
            return list(dict.fromkeys(rows[n]["id"] for n in names))
        if not task:
            raise S.SeedError("give seeds or a task")
        t = self.spark.createDataFrame([(0, task)], "task_id long, task string")
        got = [r["node"] for r in S.resolve_tasks(t, self.g).orderBy("place").collect()]
        traced = not t.where(F.size(T.frames("task")) > 0).isEmpty()
        if not got and not traced:
            raise S.SeedError(f"no symbol matches a word of {task!r}")
        return got

    def _seeds(self, ids: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(0, i) for i in ids], "trial long, node long")

    def compile(self, seeds: list[str] | None = None, task: str | None = None, budget: int = 8000) -> dict:
        """The context as text with its figures; ``status`` is OK, DEMOTED:Px or EXCEEDED (then with ``deficit``)."""
        if budget <= 0:
            raise ValueError("budget must be positive")
        ids = self._ids(seeds, task)
        if not ids:
            return {"status": "OK", "budget": budget, "seeds": [], "tokens": 0, "text": ""}
        self.last = Compiled(self.g, self._seeds(ids), self.spark.createDataFrame([(0, budget)], "trial long, budget long"))
        r = emission.emit(self.spark, self.root, self.last).drop("trial").first().asDict()
        return {"seeds": ids, "deficit": self.last.admission.first()["deficit"], **r}

    def explain(self, name: str) -> dict:
        """Why a symbol is in the last context: its level and every reason back to the seeds; or what refers to it."""
        if self.last is None:
            raise ValueError("compile a context first")
        (node,) = self._ids([name], None)
        level = self.last.levels.where(F.col("node") == node).first()
        names = self.g.symbols.select("id", "fqn")
        if level is None:
            by = self.g.emitted(self.last.levels).where(F.array_contains("refs", node)).select("fqn").orderBy("fqn")
            return {"present": False, "referenced_by": [r["fqn"] for r in by.collect()]}
        p = emission.provenance(self.last)
        chain = cone.explain(p, self.last.levels.where(F.col("node") == node).select("trial", "node"))
        steps = chain.join(names.withColumnRenamed("id", "via"), "via").orderBy("depth", "via").collect()
        return {"present": True, "level": level["level"], "seed": not steps, "chain": [(r["depth"], r["fqn"], r["edge"], r["rule"]) for r in steps]}

    def cone(self, name: str, depth: int = 2) -> dict:
        """Callers of a symbol within two calls, the least connected first."""
        (node,) = self._ids([name], None)
        found, notes = cone.impact_cone(self.g, self.spark.createDataFrame([(node,)], "root long"), depth)
        counts = {r["depth"]: r["n"] for r in found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).collect()}
        top = [r.asDict() for r in cone.cone_top(self.g, found).orderBy("place").collect()]
        stops = [r.asDict() for r in notes.groupBy("reason").agg(F.first("node").alias("node")).collect()]
        return {"counts": counts, "top": top, "stops": stops, "text": cone.render_cone(name, counts, top, stops)}

    def vector_context(self, seeds: list[str], budget: int = 8000) -> list[dict]:
        """Exact names only: symbols in order of cosine to the seeds' mean vector, as far as they fit the budget."""
        ids = self._ids(seeds, None)
        sd = self._seeds(ids)
        index = retrieval.clean_index(table(self.spark, self.root, "vector_index"))
        missing = sd.join(index.select(F.col("id").alias("node")), "node", "left_anti").count()
        if missing:
            raise S.SeedError(f"{missing} seed(s) have no vector")
        got = packing.in_rank_order(self.g, sd, retrieval.cosine_rank(index, sd), self.spark.createDataFrame([(0, budget)], "trial long, budget long"))
        return [r.asDict() for r in got.join(self.g.symbols.select(F.col("id").alias("node"), "fqn"), "node").orderBy("place").collect()]
