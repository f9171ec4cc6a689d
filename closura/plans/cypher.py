"""The graph store's read language as DataFrames: MATCH, WHERE, RETURN, ORDER BY, SKIP, LIMIT, UNION and UNWIND.

    run("MATCH (a:Symbol {id: $id})-[:CALLS*1..2]->(b) WHERE b.kind = 'function' RETURN DISTINCT b.fqn AS fqn ORDER BY fqn LIMIT 5", g, {"id": 7})

A pattern is a chain of nodes and edges in either direction; ``[:T*m..n]`` is a bounded walk. Labels are Symbol and Test.
Parameters are values, or lists of dicts for UNWIND. What the store refuses (IN, CONTAINS, min, max, several types in one
edge) is allowed. Every construct is planned as a join, filter or aggregate, so Catalyst orders and prunes as usual.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from closura.operators.graph import Graph

_TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\$?[A-Za-z_]\w*)|(<=|>=|<>|->|<-|\.\.|[-()\[\]{}:,.=<>*|+]))")
_AGG = {"count": F.count, "sum": F.sum, "avg": F.avg, "collect": F.collect_list, "min": F.min, "max": F.max}


class CypherError(ValueError):
    """A query outside of the supported language."""


class _Parser:
    def __init__(self, text: str, g: Graph, params: dict):
        self.g, self.params, self.t, pos = g, params, [], 0
        text = text.strip().rstrip(";")
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise CypherError(f"unexpected text at {text[pos : pos + 20]!r}")
            num, string, word, sign = m.groups()
            value = (float(num) if "." in num else int(num)) if num else re.sub(r"\\(.)", r"\1", string[1:-1]) if string else word or sign
            self.t.append(("num" if num else "str" if string else "word" if word else "sign", value))
            pos = m.end()
        self.i, self.df, self.bound, self.seen = 0, None, {}, 0

    # -- tokens
    def peek(self, *values: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] in ("word", "sign") and str(self.t[self.i][1]).upper() in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> None:
        if not self.take(*values):
            raise CypherError(f"expected {' or '.join(values)} at {self.t[self.i : self.i + 3]}")

    def word(self) -> str:
        if self.i < len(self.t) and self.t[self.i][0] == "word":
            self.i += 1
            return self.t[self.i - 1][1]
        raise CypherError(f"expected a name at {self.t[self.i : self.i + 3]}")

    # -- query
    def query(self) -> DataFrame:
        out = self.part()
        while self.take("UNION"):
            all_ = self.take("ALL")
            self.df, self.bound = None, {}
            nxt = self.part()
            out = out.union(nxt.select(*out.columns)) if all_ else out.union(nxt.select(*out.columns)).distinct()
        if self.i < len(self.t):
            raise CypherError(f"unexpected {self.t[self.i][1]!r}")
        return out

    def part(self) -> DataFrame:
        if self.take("UNWIND"):
            rows = self.params[self.word()[1:]]
            self.need("AS")
            name = self.word()
            spark = self.g.symbols.sparkSession
            keys = sorted({k for r in rows for k in r})
            self.df = spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], [f"{name}.{k}" for k in keys])
            self.bound[name] = "row"
        while self.take("MATCH"):
            self.pattern()
            while self.take(","):
                self.pattern()
        if self.take("WHERE"):
            self.df = self.df.where(self.disjunction())
        self.need("RETURN")
        return self.returned()

    # -- patterns
    def node(self) -> tuple[str, DataFrame, list[Column]]:
        self.need("(")
        self.seen += 1
        name = self.word() if self.t[self.i][0] == "word" else f"_n{self.seen}"
        label = self.word() if self.take(":") else None
        conds = []
        if label == "Test":
            conds.append(F.col(f"`{name}.kind`") == "test")
        elif label not in (None, "Symbol"):
            raise CypherError(f"unknown label {label}")
        if self.take("{"):
            while True:
                key = self.word()
                self.need(":")
                conds.append(F.col(f"`{name}.{key}`") == self.operand())
                if not self.take(","):
                    break
            self.need("}")
        self.need(")")
        s = self.g.symbols
        return name, s.select(*[F.col(c).alias(f"{name}.{c}") for c in s.columns]), conds

    def pattern(self) -> None:
        name, table, conds = self.node()
        if name not in self.bound:
            # the first node meets what is bound already (UNWIND rows) by its own conditions
            cond = reduce(lambda a, b: a & b, conds) if conds else None
            if self.df is not None and cond is None:
                raise CypherError("a second pattern must share a node or name one by its properties")
            self.df = (table.where(cond) if cond is not None else table) if self.df is None else self.df.join(table, cond)
            self.bound[name] = "node"
        else:
            for c in conds:
                self.df = self.df.where(c)
        while self.peek("-", "<-"):
            left = self.take("<-")
            if not left:
                self.need("-")
            self.need("[")
            if self.t[self.i][0] == "word":
                self.word()
            types = []
            if self.take(":"):
                types.append(self.word())
                while self.take("|"):
                    self.take(":")
                    types.append(self.word())
            lo = hi = 1
            if self.take("*"):
                lo = int(self.t[self.i][1])
                self.i += 1
                self.need("..")
                hi = int(self.t[self.i][1])
                self.i += 1
            self.need("]")
            if left:
                self.need("-")
            else:
                self.need("->")
            other, table, conds = self.node()
            e = self.g.edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
            e = e.where(F.col("type").isin(*types)) if types else e
            a, b = ("dst", "src") if left else ("src", "dst")
            e = e.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
            out, cur = None, self.df.withColumn("_at", F.col(f"`{name}.id`"))
            for k in range(1, hi + 1):
                cur = cur.join(e, F.col("_at") == F.col("_a")).drop("_at", "_a").withColumnRenamed("_b", "_at")
                if k >= lo:
                    out = cur if out is None else out.union(cur)
            self.df = out
            if other in self.bound:
                self.df = self.df.where(F.col("_at") == F.col(f"`{other}.id`")).drop("_at")
            else:
                self.df = self.df.join(table, F.col("_at") == F.col(f"`{other}.id`")).drop("_at")
                self.bound[other] = "node"
            for c in conds:
                self.df = self.df.where(c)
            name = other

    # -- expressions
    def disjunction(self) -> Column:
        c = self.conjunction()
        while self.take("OR"):
            c = c | self.conjunction()
        return c

    def conjunction(self) -> Column:
        c = self.negation()
        while self.take("AND"):
            c = c & self.negation()
        return c

    def negation(self) -> Column:
        if self.take("NOT"):
            return ~self.negation()
        if self.take("("):
            c = self.disjunction()
            self.need(")")
            return c
        a = self.operand()
        if self.take("STARTS"):
            self.need("WITH")
            return a.startswith(self.operand())
        if self.take("ENDS"):
            self.need("WITH")
            return a.endswith(self.operand())
        if self.take("CONTAINS"):
            return a.contains(self.operand())
        if self.take("IN"):
            values = self.params[self.word()[1:]]
            return a.isin(*values)
        if self.take("IS"):
            no = self.take("NOT")
            self.need("NULL")
            return a.isNotNull() if no else a.isNull()
        for sign, op in (("=", "__eq__"), ("<>", "__ne__"), ("<=", "__le__"), (">=", "__ge__"), ("<", "__lt__"), (">", "__gt__")):
            if self.take(sign):
                return getattr(a, op)(self.operand())
        raise CypherError("expected a comparison")

    def operand(self) -> Column:
        if self.i >= len(self.t):
            raise CypherError("unexpected end")
        kind, value = self.t[self.i]
        if kind in ("num", "str"):
            self.i += 1
            return F.lit(value)
        if self.take("-"):
            return -self.operand()
        name = self.word()
        if name.startswith("$"):
            return F.lit(self.params[name[1:]])
        if name.lower() in ("true", "false"):
            return F.lit(name.lower() == "true")
        self.need(".")
        if name not in self.bound:
            raise CypherError(f"{name} is not bound")
        return F.col(f"`{name}.{self.word()}`")

    def item(self) -> tuple[Column, str, bool]:
        first = self.i
        name = str(self.t[self.i][1]).lower()
        if name in _AGG and self.i + 1 < len(self.t) and self.t[self.i + 1][1] == "(":
            self.i += 2
            if self.take("*"):
                c = F.count(F.lit(1))
            else:
                distinct = self.take("DISTINCT")
                x = self.operand()
                c = F.count_distinct(x) if distinct and name == "count" else F.collect_set(x) if distinct and name == "collect" else _AGG[name](x)
            self.need(")")
            agg = True
        else:
            c, agg = self.operand(), False
        label = "".join(str(v) for _, v in self.t[first : self.i])
        return c, self.word() if self.take("AS") else label, agg

    def returned(self) -> DataFrame:
        distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        keys, aggs = [x for x in items if not x[2]], [x for x in items if x[2]]
        if aggs:
            out = self.df.groupBy(*[c.alias(n) for c, n, _ in keys]).agg(*[c.alias(n) for c, n, _ in aggs])
        else:
            out = self.df.select(*[c.alias(n) for c, n, _ in items])
        out = out.select(*[f"`{n}`" for _, n, _ in items])
        out = out.distinct() if distinct else out
        if self.take("ORDER"):
            self.need("BY")
            order = []
            while True:
                first = self.i
                self.word()
                if self.take("."):
                    self.word()
                name = "".join(str(v) for _, v in self.t[first : self.i])
                order.append(F.col(f"`{name}`").desc() if self.take("DESC") else F.col(f"`{name}`").asc())
                self.take("ASC")
                if not self.take(","):
                    break
            out = out.orderBy(*order)
        if self.take("SKIP"):
            out = out.offset(int(self.t[self.i][1]))
            self.i += 1
        if self.take("LIMIT"):
            out = out.limit(int(self.t[self.i][1]))
            self.i += 1
        return out


def run(text: str, g: Graph, params: dict | None = None) -> DataFrame:
    """The result of a query over ``g``; CypherError for anything outside of the language."""
    try:
        return _Parser(text, g, params or {}).query()
    except (IndexError, KeyError) as e:
        raise CypherError(f"incomplete query or missing parameter: {e}") from e


def delete_nodes(symbols: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of ``ids`` (id) and the edges at them (DETACH DELETE)."""
    i = ids.select("id").distinct()
    e = edges.join(i.withColumnRenamed("id", "src"), "src", "left_anti").join(i.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*edges.columns)
    return symbols.join(i, "id", "left_anti"), e
