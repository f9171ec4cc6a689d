"""Trials: which seeds, which budgets, and the whole compile pipeline over all trials in one plan."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators import candidates as C
from closura.operators import packing
from closura.operators.graph import PROFILES, Graph
from closura.plans.skew import ranked
from closura.plans.staging import Stage

TRIALS, SEEDS = 100, 6


def trial_seeds(g: Graph, trials: int = TRIALS, size: int = SEEDS) -> DataFrame:
    """(trial, node): eligible symbols dealt to trials by their id; the ``size`` smallest ids of each."""
    w = Window.partitionBy("trial").orderBy("node")
    dealt = g.eligible().select(F.pmod("id", F.lit(trials)).alias("trial"), F.col("id").alias("node"))
    return dealt.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).select("trial", "node")


def all_seeds(g: Graph, trials: int = TRIALS, size: int = SEEDS) -> DataFrame:
    """(trial, node): every eligible symbol, in trials of up to ``size``; those below ``trials`` are ``trial_seeds``.

    The ids that ``trial_seeds`` leaves out fill further trials of the same remainder, so their number grows with the table.
    """
    w = Window.partitionBy("rest").orderBy("node")
    dealt = g.eligible().select(F.pmod("id", F.lit(trials)).alias("rest"), F.col("id").alias("node")).withColumn("r", F.row_number().over(w))
    return dealt.select((F.col("rest") + F.floor((F.col("r") - 1) / size) * trials).alias("trial"), "node")


def sampled_seeds(g: Graph, trials: int = 200, size: int = SEEDS, rng_seed: int = 20260817) -> DataFrame:
    """(trial, place, node): the seeded sample of the evaluation protocol, from the eligible ids in ascending order.

    ``random.sample`` draws positions; only these few are joined to the ranked ids, no id list reaches the driver.
    """
    pool = g.eligible().select("id")
    n, rng = pool.count(), random.Random(rng_seed)
    picks = [(t, i, p + 1) for t in range(trials) for i, p in enumerate(rng.sample(range(n), size))] if n >= size else []
    spark = pool.sparkSession
    return spark.createDataFrame(picks, "trial long, place int, p long").join(ranked(pool, "id"), "p").select("trial", "place", F.col("id").alias("node"))


def budgets(seeds: DataFrame) -> DataFrame:
    """(trial, budget): 600 to 8,000 tokens, by trial, so that every status occurs."""
    return seeds.select("trial").distinct().withColumn("budget", (F.lit(600) + F.pmod(F.col("trial") * 37, F.lit(38)) * 200).cast("long"))


class Compiled:
    """The context of every trial: admission, floor, packing and hints, each part a DataFrame."""

    def __init__(self, g: Graph, seeds: DataFrame, budget: DataFrame):
        self.g, self.seeds, self.budget = g, seeds, budget
        stage = Stage(seeds.sparkSession, "compile")
        self.closures = stage.put(g.closure(seeds))
        self.costs = stage.put(g.cost(self.closures))
        self.admission = stage.put(g.admit(self.costs, budget))
        self.floor = stage.put(self.closures.join(self.admission.select("trial", "profile"), ["trial", "profile"]))
        open_ = self.admission.where("status <> 'EXCEEDED'")
        floor = self.floor.join(open_.select("trial"), "trial", "left_semi")
        emitted = floor.where("level >= 2").select("trial", "node")
        self.pool = stage.put(C.pool(C.candidates(g, seeds.join(open_.select("trial"), "trial", "left_semi"), emitted)))
        self.packed = stage.put(packing.admissions(g, floor.select("trial", "node", "level"), self.pool, open_.select("trial", F.col("effective").alias("room"))))
        self.admitted = stage.put(packing.admitted_rows(self.packed))
        second = [p.name for p in PROFILES if p.second]
        more = self.admitted.select("trial", F.col("node").alias("src")).join(open_.where(F.col("profile").isin(second)).select("trial"), "trial", "left_semi").join(g.hard, "src").select("trial", F.col("dst").alias("node"), F.lit(1).alias("level"))
        own = floor.select("trial", "node", "level").union(self.admitted.select("trial", "node", F.lit(2))).union(more)
        levels = own.groupBy("trial", "node").agg(F.max("level").alias("level"))
        self.levels = stage.put(levels.join(open_.select("trial", "profile"), "trial").select("trial", "profile", "node", "level"))
        left = self.pool.join(self.admitted.select("trial", "node"), ["trial", "node"], "left_anti").select("trial", "node", "score")
        scored = self.pool.select("trial", "node", "score").join(self.levels.where("level = 1").select("trial", "node"), ["trial", "node"], "left_semi")
        self.hints = stage.put(C.fill_hints(C.hint_pool(g, self.levels, left.union(scored)), open_.select("trial", (F.col("budget") - F.col("effective")).alias("cap"))))
        self.stage = stage

    def summary(self) -> DataFrame:
        """One row a trial: status, costs, counts and the three invariants."""
        final = self.g.cost(self.levels).select("trial", F.col("emitted"), F.col("cost").alias("final_cost"), F.col("identity_tokens"))
        broken = self.g.unclosed(self.levels).groupBy("trial").agg(F.count(F.lit(1)).alias("broken"))
        p = self.packed.select("trial", "floor", "spent", "rounds", "evaluated", F.size("admitted").alias("admitted"))
        n = self.pool.groupBy("trial").agg(F.count(F.lit(1)).alias("candidates"))
        h = self.hints.select("trial", F.col("chosen").alias("hints"), F.col("tokens").alias("hint_tokens"))
        out = self.admission.join(final, "trial", "left").join(p, "trial", "left").join(n, "trial", "left").join(h, "trial", "left").join(broken, "trial", "left").fillna(0)
        total = F.col("final_cost") + F.col("hint_tokens")
        ok = F.col("status") != "EXCEEDED"
        return out.select(
            "trial", "budget", "status", "profile", F.col("cost").alias("floor_cost"), "deficit", "candidates", "admitted", "emitted", "final_cost", "hints", "hint_tokens",
            F.when(ok, total / F.col("budget")).alias("utilisation"),
            (F.col("broken") == 0).alias("closed"), (total <= F.col("budget")).alias("within_budget"), (~ok | (F.col("final_cost") == F.col("floor") + F.col("spent"))).alias("cost_agrees"),
        )


def distribution(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., n, least, median, mean, p90, p99, most); pXX is the element at index min(n-1, int(n * q)) of the sorted values."""
    # counted per value before the shuffle: what a group's task holds are its distinct values
    few = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(value)
    upto = few.withColumns({"_n": F.sum("_k").over(group), "_upto": F.sum("_k").over(order)})
    at = lambda q: F.min(F.when(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q))), F.col(value)))
    middle = (at(0.5) + F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) / 2), F.col(value)))) / 2
    g = upto.groupBy(*by).agg(F.max("_n").alias("n"), F.min(value).alias("least"), middle.alias("median"), (F.sum(F.col(value) * F.col("_k")) / F.max("_n")).alias("mean"), at(0.9).alias("p90"), at(0.99).alias("p99"), F.max(value).alias("most"))
    return g.select(*by, "n", "least", "median", "mean", "p90", "p99", "most")


def within_tolerance(observed: dict[str, float], predicted: dict[str, float], low: float = 0.1, high: float = 10.0) -> dict[str, bool]:
    """For each predicted statistic whether the observed one is between ``low`` and ``high`` times as large."""
    return {k: k in observed and low * v <= observed[k] <= high * v for k, v in predicted.items()}
