"""Sequential admission: the bundle packer and the greedy baselines, one call a trial.

Everything that can be a join is one: a trial arrives as a row with its floor, its capped pool and the scalars they need
(bounded by the pool cap and the budget). Only the loop itself, in which each admission changes the price of the next,
runs in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from closura.functions.text import BASE, PER_FILE, PER_SYMBOL
from closura.operators.graph import Graph
from closura.plans.staging import Stage

_OUT = "trial long, floor long, spent long, room long, rounds int, evaluated int, admitted array<struct<node:long,cost:long,score:double,value:double>>"


class Ledger:
    """Price of a context under rising levels. ``facts``: id -> (l2, l3, prov, ident, file, refs2, refs3)."""

    def __init__(self, facts: dict[int, tuple]):
        self.facts, self.level, self.named, self.files, self.total = facts, {}, {}, {}, BASE

    def _refs(self, node: int, level: int) -> list[int]:
        f = self.facts[node]
        return f[6] if level >= 3 else f[5] if level == 2 else []

    def _tokens(self, node: int, level: int) -> int:
        f = self.facts[node]
        return f[1] if level >= 3 else f[0] if level == 2 else 0

    def price(self, node: int, level: int) -> int:
        """Tokens that raising ``node`` to ``level`` adds; may be negative, when its identity no longer has to be listed."""
        if node not in self.facts or (now := self.level.get(node, 0)) >= level:
            return 0
        extra = self._tokens(node, level) - self._tokens(node, now)
        fresh = level >= 2 > now
        if fresh:
            f = self.facts[node]
            extra += f[2] + PER_SYMBOL + (0 if self.files.get(f[4]) else PER_FILE)
            if self.named.get(node):
                extra -= f[3]
        change: dict[int, int] = {}
        for r in self._refs(node, level):
            change[r] = change.get(r, 0) + 1
        for r in self._refs(node, now):
            change[r] = change.get(r, 0) - 1
        for r, d in change.items():
            if d and r != node and r in self.facts and self.level.get(r, 0) < 2:
                had = self.named.get(r, 0)
                extra += self.facts[r][3] * ((had + d > 0) - (had > 0))
        return extra

    def raise_to(self, node: int, level: int) -> int:
        extra = self.price(node, level)
        if node in self.facts and (now := self.level.get(node, 0)) < level:
            if level >= 2 > now:
                f = self.facts[node]
                self.files[f[4]] = self.files.get(f[4], 0) + 1
            for r in self._refs(node, level):
                self.named[r] = self.named.get(r, 0) + 1
            for r in self._refs(node, now):
                self.named[r] -= 1
            self.level[node] = level
        self.total += extra
        return extra


    def bundle(self, raises: list[tuple[int, int]], keep: bool) -> int:
        """Tokens that raising several nodes together adds, each (node, level); put in force only with ``keep``."""
        if len(raises) == 1 and not keep:
            return self.price(*raises[0])
        before = None if keep else (dict(self.level), dict(self.named), dict(self.files), self.total)
        extra = sum(self.raise_to(*r) for r in raises)
        if before:
            self.level, self.named, self.files, self.total = before
        return extra


def pack(ledger: Ledger, pool: list[tuple], room: int) -> tuple[list[tuple[int, int, float, float]], int, int, int]:
    """Admit candidates (node, score[, raises]) until none fits ``room``: (admitted, room, rounds, evaluated).

    ``raises`` are the (node, level) that admission brings along, itself first; without them it is the node at level 2. A
    bundle is admitted whole or not at all, so the context stays closed. Each round prices every remaining candidate again,
    as what is already in makes others cheaper. The highest score a token wins, a price of 0 or less at once; the first in
    pool order wins ties; candidates that don't fit stay.
    """
    admitted, rounds, evaluated = [], 0, 0
    open_ = [(c[0], c[1], c[2] if len(c) > 2 and c[2] else [(c[0], 2)]) for c in pool]
    while open_:
        rounds += 1
        best = None
        open_ = [c for c in open_ if ledger.level.get(c[0], 0) < c[2][0][1]]
        for node, score, raises in open_:
            evaluated += 1
            cost = ledger.bundle(raises, False)
            if cost <= room:
                value = score / cost if cost > 0 else float("inf")
                if best is None or value > best[3]:
                    best = (node, cost, score, value, raises)
        if best is None:
            break
        room -= ledger.bundle(best[4], True)
        admitted.append(best[:4])
        open_ = [c for c in open_ if c[0] != best[0]]
    return admitted, room, rounds, evaluated


def take_in_order(ledger: Ledger, ranked: list[tuple[int, float]], budget: int) -> tuple[list[tuple[int, int, float, float]], int, int, int]:
    """The baselines' rule: in rank order, level 2, whatever still fits the whole budget."""
    admitted, room, seen = [], budget - ledger.total, 0
    for node, score in ranked:
        if ledger.level.get(node, 0) >= 2:
            continue
        seen += 1
        if (cost := ledger.price(node, 2)) <= room:
            room -= ledger.raise_to(node, 2)
            admitted.append((node, cost, score, score / cost if cost > 0 else float("inf")))
    return admitted, room, 1, seen


def _run(greedy: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                facts = {x["id"]: (x["l2"], x["l3"], x["prov"], x["ident"], x["file"], x["refs2"], x["refs3"]) for x in r.facts}
                ledger = Ledger(facts)
                for x in sorted(r.levels, key=lambda x: x["node"]):
                    ledger.raise_to(x["node"], x["level"])
                floor, room = ledger.total, r.room
                pool = [(x["node"], x["score"], [(y["node"], y["level"]) for y in x["raises"]]) for x in sorted(r.pool if r.pool is not None else [], key=lambda x: x["place"])]
                got, left, rounds, seen = pack(ledger, pool, room - floor) if greedy else take_in_order(ledger, [x[:2] for x in pool], room)
                out.append((r.trial, floor, ledger.total - floor, left, rounds, seen, [{"node": n, "cost": c, "score": s, "value": min(v, 1e308)} for n, c, s, v in got]))
            yield pd.DataFrame(out, columns=["trial", "floor", "spent", "room", "rounds", "evaluated", "admitted"])

    return run


def _facts(g: Graph, levels: DataFrame, pool: DataFrame) -> DataFrame:
    """(trial, facts): scalars of every node of a trial and of everything that these refer to."""
    own = levels.select("trial", "node").union(pool.select("trial", "node")).distinct()
    scal = g.symbols.select(F.col("id").alias("node"), "l2", "l3", "prov", "ident", "file", "refs2", "refs3")
    refs = own.join(scal.select("node", F.array_union("refs2", "refs3").alias("r")), "node").select("trial", F.explode("r").alias("node"))
    nodes = own.withColumn("own", F.lit(True)).union(refs.withColumn("own", F.lit(False))).groupBy("trial", "node").agg(F.max("own").alias("own")).join(scal, "node")
    thin = lambda c: F.when(F.col("own"), F.col(c)).otherwise(F.array().cast("array<bigint>")).alias(c)
    return nodes.groupBy("trial").agg(F.collect_list(F.struct(F.col("node").alias("id"), "l2", "l3", "prov", "ident", "file", thin("refs2"), thin("refs3"))).alias("facts"))


def admissions(g: Graph, levels: DataFrame, pool: DataFrame, rooms: DataFrame, greedy: bool = True) -> DataFrame:
    """One row a trial with what was admitted, in order.

    ``levels`` (trial, node, level) is the floor, ``pool`` (trial, node, score, place) the candidates, ``rooms`` (trial,
    room) the tokens that the whole context may cost. ``greedy``: the bundle packer; otherwise in rank order. The pool may
    have ``raises`` (see ``bundles``); a candidate without them is raised to level 2 alone.
    """
    kind = "array<struct<node:bigint,level:int>>"
    pool = pool.withColumn("raises", F.coalesce("raises", F.array().cast(kind)) if "raises" in pool.columns else F.array().cast(kind))
    with_ = pool.select("trial", F.explode("raises").alias("x")).select("trial", "x.node")
    lv = levels.where("level >= 2").groupBy("trial").agg(F.collect_list(F.struct("node", "level")).alias("levels"))
    pl = pool.groupBy("trial").agg(F.collect_list(F.struct("node", "score", "place", "raises")).alias("pool"))
    rows = lv.join(_facts(g, levels.where("level >= 2"), pool.select("trial", "node").union(with_)), "trial").join(pl, "trial", "left").join(rooms.select("trial", F.col("room").cast("long").alias("room")), "trial")
    return rows.select("trial", "levels", "facts", "pool", "room").mapInPandas(_run(greedy), _OUT)


def bundles(g: Graph, levels: DataFrame, pool: DataFrame) -> DataFrame:
    """``pool`` (trial, profile, node, level, ...) with ``raises``: what admission of a candidate at its level brings along.

    ``levels`` (trial, profile, node, level) is the closed floor. Each candidate's bundle is the closure that it induces
    there: itself first, then the other rising nodes of level 2 and above (level 1 costs nothing) by id.
    """
    one = pool.select("trial", "profile", "node", "level").distinct().withColumn("key", F.concat_ws("/", "trial", "node"))
    tried = one.select(F.col("key").alias("trial"), "profile", "node", "level")
    floor = one.select("key", "trial", "profile").join(levels, ["trial", "profile"]).select(F.col("key").alias("trial"), "profile", "node", "level")
    delta = g.induced_delta(floor, tried).where("level >= 2").withColumnRenamed("trial", "key").join(one.select("key", F.col("node").alias("own")), "key")
    order = F.array_sort(F.collect_list(F.struct((F.col("node") != F.col("own")).alias("o"), "node", "level")))
    raises = delta.groupBy("key").agg(F.transform(order, lambda x: F.struct(x["node"].alias("node"), x["level"].cast("int").alias("level"))).alias("raises"))
    return pool.join(one.join(raises, "key").select("trial", "node", "level", "raises"), ["trial", "node", "level"], "left")


def floor_status(g: Graph, seeds: DataFrame, budgets: DataFrame) -> DataFrame:
    """(trial, budget, floor, status, deficit) of the baselines: EXCEEDED where the seeds alone cost more than the budget.

    Those trials get nothing from ``in_rank_order``; ``deficit`` says by how many tokens they are over.
    """
    own = g.cost(seeds.select("trial", F.lit("P3").alias("profile"), "node", F.lit(3).alias("level")).distinct()).select("trial", F.col("cost").alias("floor"))
    over = F.col("floor") > F.col("budget")
    return budgets.join(own, "trial").select("trial", "budget", "floor", F.when(over, "EXCEEDED").otherwise("OK").alias("status"), F.greatest(F.col("floor") - F.col("budget"), F.lit(0)).alias("deficit"))


def admitted_rows(packed: DataFrame) -> DataFrame:
    """(trial, place, node, cost, score, value) of ``admissions``."""
    return packed.select("trial", F.posexplode("admitted").alias("p", "a")).select("trial", (F.col("p") + 1).alias("place"), "a.node", "a.cost", "a.score", "a.value")


def in_rank_order(g: Graph, seeds: DataFrame, ranked: DataFrame, budgets: DataFrame, piece: int = 500) -> DataFrame:
    """(trial, place, node, cost, score, value): seeds at level 3, then ``ranked`` candidates in order, whatever fits.

    ``ranked`` (trial, node, score, place) may be as long as the symbol table. It is taken in pieces: a round gets the
    next ``piece`` candidates of each trial whose least possible price still fits the trial's room, so what can't be
    admitted any more never reaches a task and the result is that of one pass over the whole ranking.
    """
    stage = Stage(ranked.sparkSession, "rank-order")
    least = g.symbols.select(F.col("id").alias("node"), (F.col("l2") + F.col("prov") + PER_SYMBOL - F.col("ident")).alias("least"))
    todo = stage.put(ranked.select("trial", "node", "score", "place").join(least, "node"))
    levels = seeds.select("trial", "node", F.lit(3).alias("level")).distinct()
    state = stage.put(budgets.select("trial", F.col("budget").cast("long").alias("budget"), F.col("budget").cast("long").alias("room"), F.lit(0).alias("last")))
    out = None
    while True:
        open_ = todo.join(state, "trial").where((F.col("place") > F.col("last")) & (F.col("least") <= F.col("room")))
        w = Window.partitionBy("trial").orderBy("place")
        now = stage.put(open_.withColumn("r", F.row_number().over(w)).where(F.col("r") <= piece).select("trial", "node", "score", "place"))
        if now.isEmpty():
            return out if out is not None else admitted_rows(admissions(g, levels, now, budgets.select("trial", F.col("budget").alias("room")), greedy=False)).select("trial", "place", "node", "cost", "score", "value")
        packed = stage.put(admissions(g, levels, now, state.select("trial", F.col("budget").alias("room")), greedy=False))
        got = stage.put(admitted_rows(packed).drop("place").join(now.select("trial", "node", "place"), ["trial", "node"]).select("trial", "place", "node", "cost", "score", "value"))
        out = got if out is None else out.union(got)
        levels = levels.union(got.select("trial", "node", F.lit(2)))
        ends = now.groupBy("trial").agg(F.max("place").alias("end"))
        left = packed.select("trial", F.col("room").alias("left"))
        state = stage.put(state.join(ends, "trial").join(left, "trial").select("trial", "budget", F.col("left").alias("room"), F.col("end").alias("last")))
