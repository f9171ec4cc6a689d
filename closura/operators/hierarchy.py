"""Problem 2: parent-child rows to full hierarchies.

The links form a graph in which most nodes have one parent, some have several and some lie on cycles. It is split into a
forest (each node's smallest parent, cycles cut at their smallest node) and the remaining *cross links*.

1. Leaves are peeled off, twice as many levels each round: a node stays if it is the 2^r-th ancestor of a node and has a
   2^r-th ancestor itself. When a round peels nothing, what is left of a graph with one parent a node are its cycles.
2. The forest is turned into Euler tours: one list a tree of enter and exit elements. Runs of leaves under one parent are
   one weighted element, and a parent's children are dealt to buckets of about BUCKET, so no parent needs one task for
   all its children.
3. Parallel list ranking (pointer jumping, HOPS links a round) gives every element its weight to the end of its tour: entry and exit numbers,
   depth and root of every node. v lies below u exactly if the interval of v is inside that of u.
4. Cross links are folded in on a graph that has only their ends as nodes: shortest distances to roots by a semi-naive
   fixpoint, cycles by strongly connected components (trimming, then forward-backward colouring): the smallest id of a
   component is the smallest of a cycle; without that id the rest falls into components again, and so on. A graph of at
   most LOCAL links is searched by one task, in the same way.
5. All symbols below a symbol, and whole paths, are made of pieces of the forest in the same way.

All tables carry ``h``, so several hierarchies go through the same rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from closura.plans.staging import Stage
from closura.sources.tables import edge_type, symbols_once, table

HOPS, LOCAL, BUCKET = 3, 20_000, 4096
ENTER, EXIT = -1, -2  # element kinds; kinds from 0 on are leaf runs, by bucket


def _hier() -> Column:
    return F.when(F.col("h") == 0, "inherits").otherwise("contains").alias("hier")


def symbol_links(spark: SparkSession, root: str) -> DataFrame:
    """(h, child, parent): h 0 for INHERITS_FROM edges, 1 for enclosing classes; only links between known symbols.

    ``parent_class`` is compared after removing surrounding whitespace. Null or unknown ends are ignored, links are
    distinct, a symbol that is its own parent is kept.
    """
    symbols = symbols_once(spark, root, ["fqn", "parent_class"])
    stubs = table(spark, root, "stub_symbols").where("id is not null")
    ids = symbols.select("id").union(stubs.select("id")).distinct()
    e = table(spark, root, "edges").where(edge_type() == "INHERITS_FROM").select(F.col("src").alias("child"), F.col("dst").alias("parent")).where("child is not null and parent is not null").distinct()
    inherits = e.join(symbols.select(F.col("id").alias("child")), "child", "left_semi").join(ids.select(F.col("id").alias("parent")), "parent", "left_semi")
    names = symbols.select("fqn", F.col("id").alias("parent")).union(stubs.select("fqn", F.col("id").alias("parent"))).where("fqn is not null").groupBy("fqn").agg(F.min("parent").alias("parent"))
    inside = symbols.where("parent_class is not null").select(F.col("id").alias("child"), F.regexp_replace("parent_class", r"^\s+|\s+$", "").alias("fqn"))
    contains = inside.join(names, "fqn")
    return inherits.select(F.lit(0).alias("h"), "child", "parent").union(contains.select(F.lit(1), "child", "parent"))


class Hierarchy:
    """Forest, Euler numbers and cross links of ``links`` (h, child, parent)."""

    def __init__(self, links: DataFrame):
        self.stage = Stage(links.sparkSession, "hierarchy")
        self.links = self.stage.put(links.where("child is not null and parent is not null").select("h", "child", "parent").distinct())
        primary = self.stage.put(self.links.groupBy("h", "child").agg(F.min("parent").alias("parent")))
        cut = self._cycles(primary)
        cross = self.links.join(primary, ["h", "child", "parent"], "left_anti")
        if cut is None:
            self.forest = primary
        else:
            reps = cut.where("id = least").select("h", F.col("id").alias("child"))
            self.forest = self.stage.put(primary.join(reps, ["h", "child"], "left_anti"))
            cross = cross.union(primary.join(reps, ["h", "child"], "left_semi").select("h", "child", "parent"))
        self.cross = self.stage.put(cross)

    # 1. peeling
    def _cycles(self, primary: DataFrame) -> DataFrame | None:
        """(h, id, least) of the nodes on cycles of the one-parent graph; None without any."""
        jump, size = primary.select("h", F.col("child").alias("id"), F.col("parent").alias("to")), None
        while True:
            below = jump.select("h", F.col("to").alias("id")).distinct()
            far = jump.select("h", F.col("id").alias("to"), F.col("to").alias("to2"))
            before, (jump, n) = jump, self.stage.counted(jump.join(below, ["h", "id"], "left_semi").join(far, ["h", "to"]).select("h", "id", F.col("to2").alias("to")))
            self.stage.drop(before)
            if not n:
                return None
            if n == size:  # every node is an ancestor of one of them: the jump is a permutation
                break
            size = n
        ring = primary.withColumnRenamed("child", "id").join(jump.select("h", "id"), ["h", "id"], "left_semi")
        ring = self.stage.put(ring.select("h", "id", F.col("parent").alias("to"), F.least("id", "parent").alias("least")))
        while n:  # the smallest of the next 2^r nodes; when no node learns of a smaller one, it is the smallest of the cycle
            far = ring.select("h", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"))
            new = ring.join(far, ["h", "to"]).select("h", "id", F.col("to2").alias("to"), F.least("least", "least2").alias("least"), (F.col("least2") < F.col("least")).alias("new"))
            before, (ring, n) = ring, self.stage.counted(new, "new")
            self.stage.drop(before)
        return ring.select("h", "id", "least")

    def _follow(self, a: DataFrame, keys: list[str], to: list[str], merge: dict[str, Column]) -> DataFrame:
        """Pointer jumping: each row takes over the pointer ``to`` of the row (by ``keys``) that it points to, until all are null.

        ``merge`` makes a row's new values of its own and those of the other row, which have a 2 in their name and are null
        for rows that have arrived. HOPS rows are followed a round, so distances grow by HOPS + 1. Many rows may point to
        one: that side of the join is the large one, which adaptive execution splits.
        """
        a, n = self.stage.counted(a, f"{to[0]} is not null")
        while n:
            far = a.select("h", *[F.col(k).alias(t) for k, t in zip(keys, to, strict=True)], *[F.col(c).alias(f"{c}2") for c in (*to, *merge)])
            live = a.where(f"{to[0]} is not null")
            for _ in range(HOPS):
                live = live.join(far, ["h", *to], "left").select("h", *keys, *[F.col(f"{t}2").alias(t) for t in to], *[m.alias(c) for c, m in merge.items()])
            before, (a, n) = a, self.stage.counted(a.where(f"{to[0]} is null").select(live.columns).union(live), f"{to[0]} is not null")
            self.stage.drop(before)
        return a

    def _fixpoint(self, first: DataFrame, back: DataFrame, value: list[str], step: dict[str, Column]) -> DataFrame:
        """(h, a, top, *value): the least ``value`` (compared as a struct) of every (a, top) over all ways along ``back`` (h, a, to, ...).

        Semi-naive: ``step`` makes a value of the one at ``to`` and the columns of ``back``; only rows that were new or became
        smaller in the round before are carried on.
        """
        v = F.struct(*value)
        best, n = self.stage.counted(first.groupBy("h", "a", "top").agg(F.min(v).alias("v")).select("h", "a", "top", "v.*", F.lit(True).alias("new")))
        while n:
            more = best.where("new").select("h", F.col("a").alias("to"), "top", *value).join(back, ["h", "to"]).select("h", "a", "top", *[step[c].alias(c) for c in value])
            both = best.select("h", "a", "top", v.alias("v"), v.alias("had")).unionByName(more.select("h", "a", "top", v.alias("v")), allowMissingColumns=True)
            least = both.groupBy("h", "a", "top").agg(F.min("v").alias("v"), F.min("had").alias("had")).select("h", "a", "top", "v.*", (F.col("had").isNull() | (F.col("v") < F.col("had"))).alias("new"))
            before, (best, n) = best, self.stage.counted(least, "new")
            self.stage.drop(before)
        return best.select("h", "a", "top", *value)

    # 2. Euler tours
    def _tours(self) -> tuple[DataFrame, DataFrame]:
        """The list elements (h, node, k, nnode, nk, w, d), and the leaves with their place (h, id, node, k, place)."""
        f = self.forest
        size = f.groupBy("h", "parent").agg(F.count(F.lit(1)).alias("n"))
        inner = size.select("h", F.col("parent").alias("child"), F.lit(True).alias("inner"))
        kids = f.join(size, ["h", "parent"]).join(inner, ["h", "child"], "left").select("h", "parent", "child", F.coalesce("inner", F.lit(False)).alias("inner"), F.pmod(F.xxhash64("child"), F.ceil(F.col("n") / BUCKET)).cast("int").alias("b"))
        kids = self.stage.put(kids)
        bucket = Window.partitionBy("h", "parent", "b").orderBy("child")
        leaves = kids.where("not inner").select("h", F.col("child").alias("id"), F.col("parent").alias("node"), F.col("b").alias("k"), F.row_number().over(bucket).alias("place"))
        item = lambda first, k1, last, k2, w, o: F.struct(o.alias("o"), first.alias("f"), k1.alias("fk"), last.alias("l"), k2.alias("lk"), w.alias("w"))
        p, c, b, i = F.col("parent"), F.col("child"), F.col("b"), lambda x: F.lit(x).cast("int")
        runs = kids.where("not inner").groupBy("h", "parent", "b").agg(F.count(F.lit(1)).alias("w")).select("h", "parent", "b", item(p, b, p, b, F.col("w"), F.lit(0)).alias("x"))
        subs = kids.where("inner").select("h", "parent", "b", item(c, i(ENTER), c, i(EXIT), F.lit(0).cast("long"), F.lit(1)).alias("x"))
        items = self.stage.put(runs.union(subs))
        heads = items.groupBy("h", "parent", "b").agg(F.min("x").alias("first"))
        order = Window.partitionBy("h", "parent").orderBy("b")
        heads = heads.select("h", "parent", "b", F.lead("first").over(order).alias("then"), F.row_number().over(order).alias("r"), "first")
        within = items.withColumn("next", F.lead("x").over(Window.partitionBy("h", "parent", "b").orderBy("x")))
        j = within.join(heads.select("h", "parent", "b", "then"), ["h", "parent", "b"])
        after = F.coalesce("next", "then")
        to, tk = F.coalesce(after["f"], p), F.coalesce(after["fk"], i(EXIT))
        last = F.col("x")["l"], F.col("x")["lk"]
        linked = j.select("h", last[0].alias("node"), last[1].alias("k"), to.alias("nnode"), tk.alias("nk"), F.col("x")["w"].alias("w"), F.when(F.col("x")["o"] == 1, -1).otherwise(0).cast("long").alias("d"))
        enter = heads.where("r = 1").select("h", p.alias("node"), i(ENTER).alias("k"), F.col("first")["f"].alias("nnode"), F.col("first")["fk"].alias("nk"), F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("d"))
        tops = size.select("h", "parent").join(f.select("h", F.col("child").alias("parent")), ["h", "parent"], "left_anti")
        ends = tops.select("h", p.alias("node"), i(EXIT).alias("k"), F.lit(None).cast("long").alias("nnode"), F.lit(None).cast("int").alias("nk"), F.lit(0).cast("long").alias("w"), F.lit(-1).cast("long").alias("d"))
        return linked.union(enter).union(ends), leaves

    # 3. list ranking
    @cached_property
    def nodes(self) -> DataFrame:
        """(h, id, root, depth, hi, lo): u is below v, or v itself, exactly if both have one root and lo(v) < hi(u) <= hi(v)."""
        elements, leaves = self._tours()
        a = self._follow(
            elements.withColumn("root", F.when(F.col("nnode").isNull(), F.col("node"))), ["node", "k"], ["nnode", "nk"],
            {"w": F.col("w") + F.coalesce("w2", F.lit(0)), "d": F.col("d") + F.coalesce("d2", F.lit(0)), "root": F.coalesce("root", "root2")},
        )
        put = a.where(F.col("k") < 0).groupBy("h", F.col("node").alias("id")).agg(F.max("root").alias("root"), F.max(F.when(F.col("k") == ENTER, -F.col("d"))).alias("depth"), F.max(F.when(F.col("k") == ENTER, F.col("w"))).alias("hi"), F.max(F.when(F.col("k") == EXIT, F.col("w"))).alias("lo"))
        low = leaves.join(a.where("k >= 0").select("h", "node", "k", "root", "w", "d"), ["h", "node", "k"]).select("h", "id", "root", (-F.col("d")).alias("depth"), (F.col("w") - F.col("place") + 1).alias("hi"), (F.col("w") - F.col("place")).alias("lo"))
        placed = put.union(low)
        alone = self.cross.select("h", F.explode(F.array("child", "parent")).alias("id")).distinct().join(placed, ["h", "id"], "left_anti")
        zero = F.lit(0).cast("long")
        return self.stage.put(placed.union(alone.select("h", "id", F.col("id").alias("root"), zero.alias("depth"), F.lit(1).cast("long").alias("hi"), zero.alias("lo"))))

    def true_roots(self) -> DataFrame:
        """(h, root): trees whose root has no parent at all (a cut cycle's smallest node is the root of its tree only)."""
        return self.nodes.where("depth = 0").select("h", "root").join(self.links.select("h", F.col("child").alias("root")), ["h", "root"], "left_anti")

    # 4. cross links
    def _nearest(self) -> DataFrame:
        """(h, id, near, least): the nearest node from ``id`` upwards that has cross links, and the smallest id on the way."""
        marked = self.cross.select("h", F.col("child").alias("id")).distinct()
        trees = self.nodes.join(marked, ["h", "id"], "left_semi").select("h", "root").distinct()
        inside = self.nodes.join(trees, ["h", "root"], "left_semi").select("h", "id")
        up = inside.join(self.forest.select("h", F.col("child").alias("id"), "parent"), ["h", "id"], "left").join(marked.withColumn("m", F.lit(True)), ["h", "id"], "left")
        done = F.coalesce("m", F.lit(False))
        start = up.select("h", "id", F.when(~done, F.col("parent")).alias("to"), F.when(done, F.col("id")).alias("near"), F.col("id").alias("least"))
        return self._follow(start, ["id"], ["to"], {"near": F.coalesce("near", "near2"), "least": F.least("least", "least2")}).where("near is not null").select("h", "id", "near", "least")

    def reach(self) -> DataFrame:
        """(h, id, root, depth): shortest distance of every node with a parent to every root above it; -1 for cycles."""
        placed = self.nodes.select("h", "id", "root", "depth")
        roots = self.true_roots()
        own = placed.where("depth > 0").join(roots, ["h", "root"], "left_semi").select("h", "id", "root", "depth")
        if self.cross.isEmpty():
            return own.withColumn("depth", F.col("depth").cast("int"))
        near = self._nearest()
        depth = lambda c, d: self.nodes.select("h", F.col("id").alias(c), F.col("depth").alias(d))
        at = lambda c: near.select("h", F.col("id").alias(c), F.col("near").alias("to"), F.col("least"))
        x = self.cross.select("h", F.col("child").alias("a"), F.col("parent").alias("p"), F.lit(1).alias("w"))
        marked = x.select("h", "a").distinct()
        climb = marked.join(self.forest.select("h", F.col("child").alias("a"), F.col("parent").alias("p")), ["h", "a"]).select("h", "a", "p", F.lit(1).alias("w"))
        steps = self.stage.put(x.withColumn("x", F.lit(True)).union(climb.withColumn("x", F.lit(False))).join(depth("p", "dp"), ["h", "p"]).join(at("p"), ["h", "p"], "left").join(depth("to", "dt"), ["h", "to"], "left"))
        hops = self.stage.put(steps.where("to is not null").select("h", "a", "to", (F.lit(1) + F.col("dp") - F.col("dt")).alias("w"), "least"))
        first = steps.where("x").join(placed.select("h", F.col("id").alias("p"), "root"), ["h", "p"]).join(roots, ["h", "root"], "left_semi").select("h", "a", "root", (F.lit(1) + F.col("dp")).alias("dist"))
        first = first.union(self._cycle_marks(hops)).withColumnRenamed("root", "top")
        back = self.stage.put(hops.groupBy("h", "a", "to").agg(F.min("w").alias("w")))
        best = self._fixpoint(first, back, ["dist"], {"dist": F.when(F.col("dist") < 0, -1).otherwise(F.col("dist") + F.col("w"))}).withColumnRenamed("top", "root")
        via = near.join(depth("id", "d"), ["h", "id"]).join(depth("near", "dn"), ["h", "near"]).select("h", "id", F.col("near").alias("a"), (F.col("d") - F.col("dn")).alias("w"))
        far = via.join(best, ["h", "a"]).select("h", "id", "root", F.when(F.col("dist") < 0, F.lit(-1)).otherwise(F.col("dist") + F.col("w")).alias("depth"))
        return own.union(far).groupBy("h", "id", "root").agg(F.min("depth").cast("int").alias("depth"))

    # 5. whole ways up
    def _segments(self) -> DataFrame:
        """(h, id, near, seg): the ids from ``id`` up the forest to the nearest node with cross links, or (near null) to the root."""
        marked = self.cross.select("h", F.col("child").alias("id")).distinct().withColumn("m", F.lit(True))
        ids = self.links.select("h", F.explode(F.array("child", "parent")).alias("id")).distinct()
        up = ids.join(self.forest.select("h", F.col("child").alias("id"), "parent"), ["h", "id"], "left").join(marked, ["h", "id"], "left")
        start = up.select("h", "id", F.when(F.col("m").isNull(), F.col("parent")).alias("to"), F.when(F.col("m"), F.col("id")).alias("near"), F.array("id").alias("seg"))
        return self._follow(start, ["id"], ["to"], {"near": F.coalesce("near", "near2"), "seg": F.concat("seg", F.coalesce("seg2", F.array().cast("array<bigint>")))}).select("h", "id", "near", "seg")

    def above(self, roots: bool = False) -> DataFrame:
        """(h, id, top, dist, path): the smallest number of links from every node to every node above it, by all links.

        A node on a cycle is above itself. With ``roots``, only tops without parents and the smallest node of each cycle,
        and ``path`` has the ids from id to top on the first of the shortest ways by the order of ids; else it is empty.
        Pieces of the forest between nodes with cross links are put together by a semi-naive fixpoint over these nodes.
        """
        seg = self._segments()
        marked = self.cross.select("h", F.col("child").alias("a")).distinct()
        steps = self.stage.put(self.links.select("h", F.col("child").alias("a"), F.col("parent").alias("id")).join(marked, ["h", "a"], "left_semi").join(seg, ["h", "id"]))
        n = F.size("seg")
        if roots:
            tops = self.links.select("h", F.col("parent").alias("top")).join(self.links.select("h", F.col("child").alias("top")), ["h", "top"], "left_anti")
            hops = self.stage.put(steps.where("near is not null").select("h", "a", F.col("near").alias("to"), n.cast("long").alias("w"), F.array_min("seg").alias("least")))
            tops = self.stage.put(tops.union(self._cycle_marks(hops).select("h", F.col("root").alias("top"))).distinct())
            keep = lambda df: df.join(tops, ["h", "top"], "left_semi")
            ids = lambda *parts: F.concat(*parts)
        else:
            keep = lambda df: df
            ids = lambda *_: F.array().cast("array<bigint>")
        best_of = lambda df, *by: df.groupBy("h", *by).agg(F.min(F.struct("dist", "path")).alias("v")).select("h", *by, "v.dist", "v.path")
        own = seg.select("h", "id", F.posexplode("seg").alias("dist", "top")).where("dist > 0")
        own = keep(own).join(seg.select("h", "id", "seg"), ["h", "id"]) if roots else own.withColumn("seg", F.array().cast("array<bigint>"))
        own = own.select("h", "id", "top", "dist", ids(F.slice("seg", F.lit(1), F.col("dist") + 1)).alias("path"))
        if self.cross.isEmpty():
            return own
        first = keep(steps.select("h", "a", "id", F.posexplode("seg").alias("dist", "top")))
        first = first.join(steps.select("h", "a", "id", "seg"), ["h", "a", "id"]) if roots else first.withColumn("seg", F.array().cast("array<bigint>"))
        first = first.select("h", "a", "top", (F.col("dist") + 1).alias("dist"), ids(F.array("a"), F.slice("seg", F.lit(1), F.col("dist") + 1)).alias("path"))
        back = steps.where("near is not null").select("h", "a", F.col("near").alias("to"), n.alias("dist"), ids(F.array("a"), F.slice("seg", F.lit(1), n - 1)).alias("path"))
        back = self.stage.put(best_of(back, "a", "to").select("h", "a", "to", F.col("dist").alias("w"), F.col("path").alias("way")))
        best = self._fixpoint(first, back, ["dist", "path"], {"dist": F.col("dist") + F.col("w"), "path": ids("way", "path")})
        via = seg.where("near is not null").select("h", F.col("near").alias("a"), "id", (n - 1).alias("w"), ids(F.slice("seg", F.lit(1), n - 1)).alias("way"))
        far = via.join(best, ["h", "a"]).select("h", "id", "top", (F.col("dist") + F.col("w")).alias("dist"), ids("way", "path").alias("path"))
        return best_of(own.union(far), "id", "top")

    def _cycle_marks(self, hops: DataFrame) -> DataFrame:
        """(h, a, root, dist -1): for each node on cycles the smallest ids of the cycles that it is on or reaches within its
        strongly connected component. An id is one of them exactly if it lies on a cycle of ids that aren't smaller."""
        core, n = self.stage.counted(hops.select("h", "a", "to", "least").distinct())
        if n <= LOCAL:
            out = core.repartition(1).mapInArrow(_local_marks, "h int, a long, root long")
        else:
            outer, roots = None, None
            while True:
                comp = self._components(core.select("h", "a", "to").distinct())
                of = lambda c, name: comp.select("h", F.col("v").alias(c), F.col("c").alias(name))  # noqa: E731, B023
                within = core.join(of("a", "c"), ["h", "a"]).join(of("to", "c2"), ["h", "to"]).where("c = c2")
                within, n = self.stage.counted(within.select("h", "a", "to", "least", "c", (F.col("c") if outer is None else F.col("c0")).alias("c0")))
                if outer is None:
                    outer, roots = within.select("h", "a", "c0").distinct(), within.select("h", "c0", F.col("least").alias("root")).limit(0)
                if not n:
                    break
                least = within.groupBy("h", "c").agg(F.min("least").alias("root"), F.first("c0").alias("c0"))
                roots = self.stage.put(roots.union(least.select("h", "c0", "root")))
                core = within.join(least.select("h", "c", "root"), ["h", "c"]).where("least <> root").select("h", "a", "to", "least", "c0")
            out = outer.join(roots.distinct(), ["h", "c0"]).select("h", "a", "root")
        return out.select("h", "a", "root", F.lit(-1).cast("long").alias("dist"))

    def _components(self, links: DataFrame) -> DataFrame:
        """(h, v, c): the strongly connected component, by a node of it, of all nodes that may lie on cycles."""
        core, n, out = links, None, None
        while True:  # trim what has no way in or no way out
            core, m = self.stage.counted(core.join(core.select("h", F.col("to").alias("a")).distinct(), ["h", "a"], "left_semi").join(core.select("h", F.col("a").alias("to")).distinct(), ["h", "to"], "left_semi").select("h", "a", "to"))
            if m in (0, n):
                break
            n = m
        while m:
            color = self.stage.put(core.select("h", F.explode(F.array("a", "to")).alias("v")).distinct().withColumn("c", F.col("v")))
            while n:  # smallest node that reaches v
                push = core.join(color.select("h", F.col("v").alias("a"), "c"), ["h", "a"]).select("h", F.col("to").alias("v"), "c", F.lit(None).cast("long").alias("had"))
                new = color.select("h", "v", "c", F.col("c").alias("had")).union(push).groupBy("h", "v").agg(F.min("c").alias("c"), F.min("had").alias("had"))
                marked, n = self.stage.counted(new, "c < had")
                color = marked.select("h", "v", "c")
            inside = self.stage.put(core.join(color.select("h", F.col("v").alias("a"), F.col("c")), ["h", "a"]).join(color.select("h", F.col("v").alias("to"), F.col("c").alias("c2")), ["h", "to"]).where("c = c2").select("h", "a", "to", "c"))
            found = front = self.stage.put(color.where("v = c"))
            while True:  # those of that colour that reach it in turn
                prev = inside.join(front.select("h", F.col("v").alias("to"), "c"), ["h", "to", "c"], "left_semi").select("h", F.col("a").alias("v"), "c").distinct()
                front, n = self.stage.counted(prev.join(found, ["h", "v", "c"], "left_anti"))
                if not n:
                    break
                found = self.stage.put(found.union(front))
            out = found if out is None else out.union(found)
            rest = core.join(found.select("h", F.col("v").alias("a")), ["h", "a"], "left_anti").join(found.select("h", F.col("v").alias("to")), ["h", "to"], "left_anti")
            core, n = self.stage.counted(rest.select("h", "a", "to"))
            m = n
        return out if out is not None else core.select("h", F.col("a").alias("v"), F.col("to").alias("c"))


def _strong(links: dict[int, set[int]]) -> list[set[int]]:
    """Strongly connected components of nodes (Kosaraju, without recursion)."""
    order, seen = [], set()
    for s in links:
        stack = [] if s in seen else [(s, iter(links[s]))]
        seen.add(s)
        while stack:
            v, rest = stack[-1]
            w = next((w for w in rest if w not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(links.get(w, ()))))
    back: dict[int, set[int]] = {}
    for v, to in links.items():
        for w in to:
            back.setdefault(w, set()).add(v)
    out, done = [], set()
    for s in reversed(order):
        if s not in done:
            part, todo = {s}, [s]
            while todo:
                new = back.get(todo.pop(), set()) - part - done
                part |= new
                todo += new
            done |= part
            out.append(part)
    return out


def _local_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, a, root) of at most LOCAL links (h, a, to, least), as in ``Hierarchy._cycle_marks``."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for b in batches:
        for h, *link in zip(*(b.column(c).to_pylist() for c in ("h", "a", "to", "least")), strict=True):
            by.setdefault(h, []).append(tuple(link))
    out = []
    for h, links in by.items():
        todo = [(links, None)]
        while todo:
            core, outer = todo.pop()
            to: dict[int, set[int]] = {}
            for a, t, _ in core:
                to.setdefault(a, set()).add(t)
            name = {v: i for i, part in enumerate(_strong(to)) for v in part}
            parts: dict[int, list[tuple[int, int, int]]] = {}
            for x in core:
                if name.get(x[0], -1) == name.get(x[1], -2):
                    parts.setdefault(name[x[0]], []).append(x)
            for part in parts.values():
                least, nodes = min(x[2] for x in part), outer or {x[0] for x in part}
                out += [(h, v, least) for v in nodes]
                todo.append(([x for x in part if x[2] != least], nodes))
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["h", "a", "root"])


def hierarchy_roots(spark: SparkSession, root: str) -> DataFrame:
    """(hier, id, root_id, depth) for both hierarchies of the symbols.

    One row for each id with a parent and each root it reaches (smallest number of links), and one with depth -1 for each
    cycle that it is on or reaches, by the smallest id of the cycle; cycles with the same smallest id are one. Empty tables, nulls, repeated rows and unknown ends: see ``symbol_links``.
    """
    return Hierarchy(symbol_links(spark, root)).reach().select(_hier(), "id", F.col("root").alias("root_id"), "depth")


def hierarchy_below(spark: SparkSession, root: str) -> DataFrame:
    """(hier, id, below_id, depth, cycle_id): every symbol and every symbol below it, over all links.

    ``depth`` is the smallest number of links between the two; ``cycle_id`` the smallest id of the cycle that id is on, else
    null. A symbol on a cycle is below itself. Symbols with nothing below have no row.
    """
    h = Hierarchy(symbol_links(spark, root))
    pairs = h.stage.put(h.above().drop("path"))
    on = pairs.where("id = top").select("h", "id")
    ring = pairs.select("h", "id", "top").join(on, ["h", "id"], "left_semi").join(on.select("h", F.col("id").alias("top")), ["h", "top"], "left_semi")
    both = ring.join(ring.select("h", F.col("id").alias("top"), F.col("top").alias("id")), ["h", "id", "top"], "left_semi")
    cycle = both.groupBy("h", F.col("id").alias("top")).agg(F.min("top").alias("cycle_id"))
    return pairs.join(cycle, ["h", "top"], "left").select(_hier(), F.col("top").alias("id"), F.col("id").alias("below_id"), F.col("dist").alias("depth"), "cycle_id")


def hierarchy_paths(spark: SparkSession, root: str) -> DataFrame:
    """(hier, id, root_id, depth, path): a path for every row of ``hierarchy_roots``, and one of depth 0 for each root.

    ``path`` has the ids from root_id down to id, joined by '/'. It is a shortest one; of several, the one whose ids, read
    upwards, come first. A cycle (depth -1) has the shortest path from its smallest node; for that node itself, once around.
    """
    h = Hierarchy(symbol_links(spark, root))
    up = h.stage.put(h.above(roots=True))
    parents, children = h.links.select("h", F.col("parent").alias("top")).distinct(), h.links.select("h", F.col("child").alias("top")).distinct()
    tops = parents.join(children, ["h", "top"], "left_anti")
    below = up.join(children.withColumn("ring", F.lit(True)), ["h", "top"], "left").select("h", "id", "top", F.when(F.col("ring"), -1).otherwise(F.col("dist")).alias("depth"), "path")
    rows = below.union(tops.select("h", F.col("top").alias("id"), "top", F.lit(0).alias("depth"), F.array("top").alias("path")))
    return rows.select(_hier(), "id", F.col("top").alias("root_id"), "depth", F.concat_ws("/", F.reverse("path").cast("array<string>")).alias("path"))
