"""The symbol graph: degrees, expansion, the level closure under four profiles, its cost and its admission to a budget.

The closure is the least fixpoint of rules that strictly lower the level, so it is exactly two joins and two maxima
whatever the graph: hop-1 targets get at most level 2 and hop-2 targets at most level 1, and a node that is expanded
never changes its level while it is. All trials and all profiles go through the same two joins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.sources.tables import edge_type, first_delivery, table

#: Edge types that propagate, in their order; INHERITS_FROM is shown only.
HARD = ("REFERENCES_TYPE", "CALLS", "OVERRIDES", "IMPLEMENTS", "DECORATED_BY", "READS_CONSTANT")
DIRECT = ("CALLS", "REFERENCES_TYPE")
SCALARS = ["fqn", "kind", "file", "start_line", "end_line", "repr_L2_tokens", "repr_L3_tokens", "repr_L2_refs", "repr_L3_refs", "identity_tokens", "provenance_tokens"]


@dataclass(frozen=True)
class Profile:
    """Levels that a profile allows: of seeds, of hop-1 targets (by edge type) and of targets of level-2 sources."""

    name: str
    rank: int
    seed: int
    direct: int
    other: int
    second: int
    label: str


PROFILES = (
    Profile("P3", 3, 3, 2, 2, 1, "FULL"),
    Profile("P2", 2, 3, 2, 1, 0, "COMPACT"),
    Profile("P1", 1, 3, 1, 1, 0, "MINIMAL"),
    Profile("P0", 0, 2, 1, 1, 1, "FLOOR"),
)


def profile_rows(profiles: tuple[Profile, ...] = PROFILES) -> Column:
    """An array of structs to explode: every trial under every profile."""
    return F.array(*[F.struct(F.lit(p.name).alias("profile"), F.lit(p.seed).alias("seed_level"), F.lit(p.direct).alias("direct"), F.lit(p.other).alias("other"), F.lit(p.second).alias("second")) for p in profiles])


def required(level: Column, etype: Column, direct: Column, other: Column, second: Column) -> Column:
    """Level that an edge of type ``etype`` out of a node at ``level`` asks for, capped by the profile."""
    return F.when(level >= 3, F.least(F.lit(2), F.when(etype.isin(*DIRECT), direct).otherwise(other))).when(level == 2, F.least(F.lit(1), second)).otherwise(0)


class Graph:
    """Symbols (scalar columns, no texts) and edges, both by first delivery.

    Symbols without an id are left out, null token counts are 0, null reference lists empty; edges with a null end, of
    an unknown type or with an end that is not a symbol don't propagate.
    """

    def __init__(self, symbols: DataFrame, edges: DataFrame):
        self.symbols, self.edges = symbols, edges

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Graph:
        s = first_delivery(table(spark, root, "symbols").where("id is not null"), ["id"], SCALARS).drop("loaded_at")
        zero, none = F.lit(0), F.array().cast("array<long>")
        s = s.select("id", "fqn", "kind", "file", "start_line", "end_line", F.coalesce("repr_L2_tokens", zero).alias("l2"), F.coalesce("repr_L3_tokens", zero).alias("l3"), F.coalesce("repr_L2_refs", none).alias("refs2"), F.coalesce("repr_L3_refs", none).alias("refs3"), F.coalesce("identity_tokens", zero).alias("ident"), F.coalesce("provenance_tokens", zero).alias("prov"))
        e = table(spark, root, "edges").select(edge_type().alias("type"), "src", "dst", "call_sites").groupBy("type", "src", "dst").agg(F.max("call_sites").alias("call_sites"))
        return cls(s, e)

    @cached_property
    def hard(self) -> DataFrame:
        """(type, src, dst): distinct propagating edges between known symbols."""
        ids = self.symbols.select("id")
        e = self.edges.where(F.col("type").isin(*HARD) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("type", "src", "dst")
        return e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select("type", "src", "dst")

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every symbol over the propagating edges; 0 without any."""
        ends = self.hard.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("x")).select("x.*")
        d = ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum(F.lit(1) - F.col("o")).alias("in_degree"))
        return self.symbols.select("id").join(d, "id", "left").fillna(0, ["out_degree", "in_degree"])

    def eligible(self) -> DataFrame:
        """Functions and methods outside of tests/ whose body has at least 150 tokens."""
        return self.symbols.where(F.col("kind").isin("function", "method") & ~F.coalesce(F.col("file"), F.lit("")).startswith("tests/") & (F.col("l3") >= 150))

    # -- closure -----------------------------------------------------------------------------------------------
    def closure(self, seeds: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
        """(trial, profile, node, level), level > 0, of ``seeds`` (trial, node); repeated seeds count once."""
        s = seeds.select("trial", "node").distinct()
        start = s.select("*", F.explode(profile_rows(profiles)).alias("p")).select("trial", "p.profile", "node", F.col("p.seed_level").alias("level"), F.lit(True).alias("seeded"))
        first = s.join(self.hard, s["node"] == self.hard["src"]).select("trial", "type", "dst", F.explode(profile_rows(profiles)).alias("p"))
        need = required(F.col("p.seed_level"), F.col("type"), F.col("p.direct"), F.col("p.other"), F.col("p.second"))
        hop1 = first.select("trial", "p.profile", F.col("dst").alias("node"), need.alias("level"), F.lit(False).alias("seeded"))
        near = start.union(hop1).groupBy("trial", "profile", "node").agg(F.max("level").alias("level"), F.max("seeded").alias("seeded"))
        second = {p.name: p.second for p in profiles if p.second and p.seed == 3}
        front = near.where(F.col("profile").isin(*second) & (F.col("level") == 2) & ~F.col("seeded")).select("trial", "profile", F.col("node").alias("src"))
        hop2 = front.join(self.hard, "src").select("trial", "profile", F.col("dst").alias("node"), F.lit(1).alias("level"))
        return near.select("trial", "profile", "node", "level").union(hop2).groupBy("trial", "profile", "node").agg(F.max("level").alias("level")).where("level > 0")

    def provenance(self, seeds: DataFrame, profile: Profile = PROFILES[0]) -> DataFrame:
        """(trial, node, seq, via, edge, rule): every rule that raised a node, in order, under one profile.

        Order: hop, position of the source (seeds by id, hop-2 sources by the order in which they were raised), edge
        type, target. Only rises above everything before them are kept.
        """
        s = seeds.select("trial", "node").distinct()
        place = F.create_map(*[x for i, t in enumerate(HARD) for x in (F.lit(t), F.lit(i))])
        lit = lambda n: F.lit(getattr(profile, n))
        hop1 = s.join(self.hard, s["node"] == self.hard["src"]).select("trial", F.col("dst").alias("node"), "src", "type", required(lit("seed"), F.col("type"), lit("direct"), lit("other"), lit("second")).alias("need"), lit("seed").alias("have"), F.struct(F.lit(1).alias("hop"), F.col("src").alias("p1"), place[F.col("type")].alias("p2"), F.col("dst").alias("p3"), F.lit(0).alias("c")).alias("o"))
        before = Window.partitionBy("trial", "node").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
        held = s.withColumn("seed_level", F.lit(profile.seed))
        risen = hop1.join(held, ["trial", "node"], "left").withColumn("was", F.greatest(F.coalesce(F.max("need").over(before), F.lit(0)), F.coalesce("seed_level", F.lit(0)))).where("need > was")
        out = risen.select("trial", "node", "src", "type", "need", "have", "o")
        if profile.second and profile.seed == 3:
            front = risen.where("need = 2").groupBy("trial", "node").agg(F.min("o").alias("f"))
            hop2 = front.select("trial", F.col("node").alias("src"), "f").join(self.hard, "src").select("trial", F.col("dst").alias("node"), "src", "type", F.lit(profile.second).alias("need"), F.lit(2).alias("have"), F.struct(F.lit(2).alias("hop"), F.col("f.p1"), F.col("f.p2"), F.col("f.p3"), place[F.col("type")].alias("c")).alias("o"))
            known = risen.select("trial", "node").union(s.select("trial", "node")).distinct()
            once = Window.partitionBy("trial", "node").orderBy("o")
            late = hop2.join(known, ["trial", "node"], "left_anti").withColumn("r", F.row_number().over(once)).where("r = 1").select("trial", "node", "src", "type", "need", "have", "o")
            out = out.union(late)
        seq = Window.partitionBy("trial", "node").orderBy("o")
        return out.select("trial", "node", F.row_number().over(seq).alias("seq"), F.col("src").alias("via"), F.col("type").alias("edge"), F.format_string("%s(L%d)->L%d", "type", "have", "need").alias("rule"))

    def unclosed(self, levels: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
        """(trial, profile, src, type, dst, needed, level): rules that ``levels`` break; closed if empty."""
        p = F.create_map(*[x for q in profiles for x in (F.lit(q.name), F.struct(F.lit(q.direct).alias("direct"), F.lit(q.other).alias("other"), F.lit(q.second).alias("second")))])
        fired = levels.where("level >= 2").join(self.hard, F.col("node") == F.col("src")).withColumn("p", p[F.col("profile")])
        fired = fired.select("trial", "profile", "src", "type", "dst", required(F.col("level"), F.col("type"), F.col("p.direct"), F.col("p.other"), F.col("p.second")).alias("needed")).where("needed > 0")
        have = levels.select("trial", "profile", F.col("node").alias("dst"), "level")
        return fired.join(have, ["trial", "profile", "dst"], "left").fillna(0, ["level"]).where("needed > level").select("trial", "profile", "src", "type", "dst", "needed", "level")

    def induced_delta(self, levels: DataFrame, raised: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
        """(trial, profile, node, level): what rises, and to which level, when ``raised`` joins the closed ``levels``.

        Both have (trial, profile, node, level). As rules strictly lower the level, the rises are those of the raised nodes,
        of their targets and of the targets' targets: two joins, which read only what is raised.
        """
        p = F.create_map(*[x for q in profiles for x in (F.lit(q.name), F.struct(F.lit(q.direct).alias("direct"), F.lit(q.other).alias("other"), F.lit(q.second).alias("second")))])
        key = ["trial", "profile", "node"]
        had = levels.select(*key, F.col("level").alias("had"))

        def rising(df: DataFrame) -> DataFrame:
            most = df.groupBy(*key).agg(F.max("level").alias("level"))
            return most.join(had, key, "left").where(F.col("level") > F.coalesce("had", F.lit(0))).select(*key, "level")

        def step(front: DataFrame) -> DataFrame:
            fired = front.where("level >= 2").join(self.hard, F.col("node") == F.col("src")).withColumn("p", p[F.col("profile")])
            need = required(F.col("level"), F.col("type"), F.col("p.direct"), F.col("p.other"), F.col("p.second"))
            return fired.select("trial", "profile", F.col("dst").alias("node"), need.alias("level"))

        first = rising(raised)
        near = rising(first.union(step(first)))
        fresh = near.join(first, [*key, "level"], "left_anti")
        return rising(near.union(step(fresh)))

    # -- cost and admission ------------------------------------------------------------------------------------
    def emitted(self, levels: DataFrame) -> DataFrame:
        """``levels`` of 2 and above with the symbol's scalars; ``refs`` and ``tokens`` are those of the level."""
        top = F.col("level") >= 3
        return levels.where("level >= 2").join(self.symbols.withColumnRenamed("id", "node"), "node").withColumn("tokens", F.when(top, F.col("l3")).otherwise(F.col("l2"))).withColumn("refs", F.when(top, F.col("refs3")).otherwise(F.col("refs2")))

    def mandatory_identities(self, levels: DataFrame) -> DataFrame:
        """(trial, profile, node, ident): symbols that emitted text refers to and that aren't emitted."""
        e = self.emitted(levels)
        refs = e.select("trial", "profile", F.explode("refs").alias("node")).distinct()
        return refs.join(e.select("trial", "profile", "node"), ["trial", "profile", "node"], "left_anti").join(self.symbols.select(F.col("id").alias("node"), "ident"), "node").select("trial", "profile", "node", "ident")

    def cost(self, levels: DataFrame) -> DataFrame:
        """(trial, profile, emitted, files, source_tokens, provenance_tokens, identity_tokens, cost) of every context."""
        own = self.emitted(levels).groupBy("trial", "profile").agg(F.count(F.lit(1)).alias("emitted"), F.countDistinct("file").alias("files"), F.sum("tokens").alias("source_tokens"), F.sum("prov").alias("provenance_tokens"))
        named = self.mandatory_identities(levels).groupBy("trial", "profile").agg(F.sum("ident").alias("identity_tokens"))
        out = levels.select("trial", "profile").distinct().join(own, ["trial", "profile"], "left").join(named, ["trial", "profile"], "left").fillna(0)
        return out.withColumn("cost", F.col("source_tokens") + F.col("provenance_tokens") + F.col("identity_tokens") + T.framing(F.col("emitted"), F.col("files")))

    @staticmethod
    def admit(costs: DataFrame, budgets: DataFrame, profiles: tuple[Profile, ...] = PROFILES) -> DataFrame:
        """(trial, budget, effective, status, profile, cost, deficit): the richest profile within 95 % of the budget.

        If none fits, the status is EXCEEDED, with the floor profile's cost and by how much it is over.
        """
        rank = F.create_map(*[x for p in profiles for x in (F.lit(p.name), F.lit(p.rank))])
        top, floor = max(profiles, key=lambda p: p.rank), min(profiles, key=lambda p: p.rank)
        j = costs.join(budgets, "trial").withColumn("effective", F.col("budget") - F.floor(F.col("budget") * T.RESERVE)).withColumn("fits", F.col("cost") <= F.col("effective"))
        g = j.groupBy("trial", "budget", "effective").agg(F.max(F.when(F.col("fits"), F.struct(rank[F.col("profile")].alias("r"), "profile", "cost"))).alias("b"), F.max(F.when(F.col("profile") == floor.name, F.col("cost"))).alias("floor"))
        ok = F.col("b").isNotNull()
        status = F.when(~ok, "EXCEEDED").when(F.col("b.profile") == top.name, "OK").otherwise(F.concat(F.lit("DEMOTED:"), F.col("b.profile")))
        return g.select("trial", "budget", "effective", status.alias("status"), F.when(ok, F.col("b.profile")).otherwise(floor.name).alias("profile"), F.when(ok, F.col("b.cost")).otherwise(F.col("floor")).alias("cost"), F.when(~ok, F.col("floor") - F.col("effective")).otherwise(0).alias("deficit"))

    @staticmethod
    def suggestion(admission: DataFrame) -> DataFrame:
        """(trial, deficit, suggestion) of the contexts that exceed their budget even under the floor profile."""
        text = F.format_string("raise the budget to %d tokens or start from fewer seeds", F.ceil((F.col("effective") + F.col("deficit")) / F.lit(1 - T.RESERVE)))
        return admission.where("status = 'EXCEEDED'").select("trial", "deficit", text.alias("suggestion"))
