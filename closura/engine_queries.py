"""Queries of the retrieval engine over the symbol graph, and the SQL that each is compared with.

Seeds come from ``trial_seeds``: eligible symbols dealt to 100 trials by id, of which the 6 smallest ids each are kept, so
queries with seeds start from at most 600 symbols, whatever the table's size. ``trial_seeds_all`` has all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.functions import text as T
from closura.operators import candidates as C
from closura.operators import cone, cosine_admission, emission, packing, retrieval, seeds
from closura.operators.graph import PROFILES, Graph
from closura.plans import cypher, harness
from closura.plans.staging import Stage
from closura.sources import graph_io
from closura.sources.tables import edge_type, symbols_once, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PRELUDE = """WITH RECURSIVE
s AS (SELECT id, any_value(fqn) AS fqn, any_value(kind) AS kind, any_value(file) AS file, any_value(start_line) AS start_line, any_value(end_line) AS end_line,
  coalesce(any_value(repr_L2_tokens), 0) AS l2, coalesce(any_value(repr_L3_tokens), 0) AS l3, coalesce(any_value(repr_L2_refs), []) AS refs2, coalesce(any_value(repr_L3_refs), []) AS refs3,
  coalesce(any_value(identity_tokens), 0) AS ident, coalesce(any_value(provenance_tokens), 0) AS prov, any_value(repr_L2_text) AS t2, any_value(repr_L3_text) AS t3, any_value(static_value) AS sv FROM symbols WHERE id IS NOT NULL GROUP BY id),
e AS (SELECT upper(trim(type)) AS type, src, dst, max(call_sites) AS call_sites, count(*) AS n FROM edges GROUP BY 1, 2, 3),
h AS (SELECT type, src, dst FROM e WHERE type IN ('REFERENCES_TYPE','CALLS','OVERRIDES','IMPLEMENTS','DECORATED_BY','READS_CONSTANT') AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)),
deg AS (SELECT s.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM s LEFT JOIN (SELECT src, count(*) AS n FROM h GROUP BY 1) o ON o.src = s.id LEFT JOIN (SELECT dst, count(*) AS n FROM h GROUP BY 1) i ON i.dst = s.id),
el AS (SELECT * FROM s WHERE kind IN ('function', 'method') AND NOT starts_with(coalesce(file, ''), 'tests/') AND l3 >= 150),
sd AS (SELECT id % 100 AS trial, id AS node FROM el QUALIFY row_number() OVER (PARTITION BY id % 100 ORDER BY id) <= 6),
pr(profile, rank, seed_level, direct, other, second) AS (VALUES ('P3', 3, 3, 2, 2, 1), ('P2', 2, 3, 2, 1, 0), ('P1', 1, 3, 1, 1, 0), ('P0', 0, 2, 1, 1, 1)),
h1 AS (SELECT trial, profile, dst AS node, CASE WHEN seed_level = 3 THEN least(2, CASE WHEN type IN ('CALLS', 'REFERENCES_TYPE') THEN direct ELSE other END) ELSE least(1, second) END AS level, false AS seeded
  FROM sd JOIN h ON h.src = sd.node CROSS JOIN pr),
nr AS (SELECT trial, profile, node, max(level) AS level, max(seeded) AS seeded FROM (SELECT trial, profile, node, seed_level AS level, true AS seeded FROM sd CROSS JOIN pr UNION ALL SELECT * FROM h1) GROUP BY ALL),
h2 AS (SELECT trial, profile, dst AS node, 1 AS level FROM nr JOIN h ON h.src = nr.node WHERE profile = 'P3' AND level = 2 AND NOT seeded),
lv AS (SELECT trial, profile, node, max(level) AS level FROM (SELECT trial, profile, node, level FROM nr UNION ALL SELECT * FROM h2) GROUP BY ALL HAVING max(level) > 0),
em AS (SELECT trial, profile, node, level, fqn, file, prov, CASE WHEN level = 3 THEN l3 ELSE l2 END AS tokens, CASE WHEN level = 3 THEN refs3 ELSE refs2 END AS refs FROM lv JOIN s ON s.id = lv.node WHERE level >= 2),
rf AS (SELECT DISTINCT trial, profile, node AS by, unnest(refs) AS node FROM em),
mi AS (SELECT DISTINCT r.trial, r.profile, r.node, s.ident FROM rf r JOIN s ON s.id = r.node WHERE NOT EXISTS (FROM em WHERE em.trial = r.trial AND em.profile = r.profile AND em.node = r.node)),
co AS (SELECT *, source_tokens + provenance_tokens + identity_tokens + 6 * emitted + 13 * files + 100 AS cost FROM (SELECT trial, profile, count(*) AS emitted, count(DISTINCT file) AS files, CAST(sum(tokens) AS BIGINT) AS source_tokens, CAST(sum(prov) AS BIGINT) AS provenance_tokens,
  coalesce((SELECT CAST(sum(ident) AS BIGINT) FROM mi WHERE mi.trial = em.trial AND mi.profile = em.profile), 0) AS identity_tokens FROM em GROUP BY ALL)),
bu AS (SELECT DISTINCT trial, CAST(600 + (trial * 37 % 38) * 200 AS BIGINT) AS budget FROM sd),
ef AS (SELECT trial, budget, budget - CAST(floor(budget * 0.05) AS BIGINT) AS effective FROM bu),
fit AS (SELECT co.*, budget, effective, rank FROM co JOIN ef USING (trial) JOIN pr USING (profile)),
ad AS (SELECT trial, budget, effective, CASE WHEN max(CASE WHEN cost <= effective THEN rank END) IS NULL THEN 'EXCEEDED' WHEN max(CASE WHEN cost <= effective THEN rank END) = 3 THEN 'OK' ELSE 'DEMOTED:P' || max(CASE WHEN cost <= effective THEN rank END) END AS status,
  'P' || coalesce(max(CASE WHEN cost <= effective THEN rank END), 0) AS profile, coalesce(arg_max(cost, CASE WHEN cost <= effective THEN rank END), max(CASE WHEN rank = 0 THEN cost END)) AS cost,
  CASE WHEN max(CASE WHEN cost <= effective THEN rank END) IS NULL THEN max(CASE WHEN rank = 0 THEN cost END) - effective ELSE 0 END AS deficit FROM fit GROUP BY trial, budget, effective),
sc AS (SELECT trial, src AS node, dst AS seed FROM sd JOIN h ON h.dst = sd.node AND h.type = 'CALLS' JOIN deg ON deg.id = sd.node WHERE in_degree <= 500),
iv AS (SELECT trial, node AS seed, dst FROM sd JOIN h ON h.src = sd.node AND type = 'IMPLEMENTS'),
sb AS (SELECT DISTINCT iv.trial, h.src AS node, iv.seed FROM iv JOIN h ON h.dst = iv.dst AND h.type = 'IMPLEMENTS' WHERE NOT EXISTS (FROM iv x WHERE x.trial = iv.trial AND x.dst = iv.dst AND x.seed = h.src)),
ln AS (SELECT trial, node, source, place, weight, count(*) AS links, min(seed) AS first_link FROM (SELECT *, 'static_caller' AS source, 0 AS place, 1.0 AS weight FROM sc UNION ALL SELECT *, 'sibling_implementation', 1, 0.7 FROM sb) c
  WHERE NOT EXISTS (FROM sd WHERE sd.trial = c.trial AND sd.node = c.node) GROUP BY ALL),
en AS (SELECT DISTINCT ln.trial, ln.node FROM ln JOIN s c ON c.id = ln.node JOIN sd ON sd.trial = ln.trial JOIN s t ON t.id = sd.node WHERE starts_with(t.fqn, c.fqn || '.')),
ca AS (SELECT trial, node, source, links, first_link, CAST(weight AS DOUBLE) * (1 + ln(greatest(links, 1))) * ln((SELECT count(*) FROM s) / (1.0 + out_degree)) AS score, s.l2 FROM ln JOIN deg ON deg.id = ln.node JOIN s ON s.id = ln.node
  WHERE NOT EXISTS (FROM en WHERE en.trial = ln.trial AND en.node = ln.node) AND NOT EXISTS (FROM em WHERE em.trial = ln.trial AND em.node = ln.node AND em.profile = 'P3')
  QUALIFY row_number() OVER (PARTITION BY trial, node ORDER BY CAST(weight AS DOUBLE) * (1 + ln(greatest(links, 1))) DESC, place) = 1),
po AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY score / greatest(l2, 1) DESC, node) AS place FROM ca QUALIFY place <= 150),
nb AS (SELECT trial, dst AS node, node AS seed, type, 'out' AS way FROM sd JOIN h ON h.src = sd.node UNION ALL SELECT trial, src, node, type, 'in' FROM sd JOIN h ON h.dst = sd.node),
oh AS (SELECT * FROM nb WHERE NOT EXISTS (FROM sd WHERE sd.trial = nb.trial AND sd.node = nb.node)),
ro AS (SELECT DISTINCT node AS root FROM sd),
c1 AS (SELECT DISTINCT root, src AS node FROM ro JOIN h ON h.dst = root AND type = 'CALLS' JOIN deg ON deg.id = root WHERE in_degree <= 500 AND src <> root),
k1 AS (SELECT root, count(*) AS n FROM c1 GROUP BY 1),
c2 AS (SELECT DISTINCT c1.root, src AS node FROM c1 JOIN k1 ON k1.root = c1.root AND k1.n <= 200 JOIN h ON h.dst = c1.node AND type = 'CALLS' JOIN deg ON deg.id = c1.node WHERE in_degree <= 500 AND src <> c1.root AND NOT EXISTS (FROM c1 x WHERE x.root = c1.root AND x.node = h.src)),
cn AS (SELECT root, node, 1 AS depth FROM c1 UNION ALL SELECT root, node, 2 FROM c2)
"""

_TYPES = "['REFERENCES_TYPE','CALLS','OVERRIDES','IMPLEMENTS','DECORATED_BY','READS_CONSTANT']"
_WHY = f""", r1 AS (SELECT sd.trial, h.dst AS node, h.src AS via, h.type AS edge, list_position({_TYPES}, h.type) AS tp FROM sd JOIN h ON h.src = sd.node WHERE NOT EXISTS (FROM sd x WHERE x.trial = sd.trial AND x.node = h.dst)
  QUALIFY row_number() OVER (PARTITION BY sd.trial, h.dst ORDER BY h.src, list_position({_TYPES}, h.type)) = 1),
r2 AS (SELECT r1.trial, h.dst AS node, h.src AS via, h.type AS edge FROM r1 JOIN h ON h.src = r1.node WHERE NOT EXISTS (FROM r1 x WHERE x.trial = r1.trial AND x.node = h.dst) AND NOT EXISTS (FROM sd x WHERE x.trial = r1.trial AND x.node = h.dst)
  QUALIFY row_number() OVER (PARTITION BY r1.trial, h.dst ORDER BY r1.via, r1.tp, r1.node, list_position({_TYPES}, h.type)) = 1),
why AS (SELECT trial, node, via, edge, edge || '(L3)->L2' AS rule FROM r1 UNION ALL SELECT trial, node, via, edge, edge || '(L2)->L1' FROM r2)"""

_ALL = "SELECT id % 100 + 100 * ((row_number() OVER (PARTITION BY id % 100 ORDER BY id) - 1) // 6) AS trial, id AS node FROM el"
_PRELUDE_ALL = re.sub(r"\nsd AS \(.*\),\n", f"\nsd AS ({_ALL}),\n", _PRELUDE)


def query(name: str, sql: str | None = None, prelude: bool = True):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (_PRELUDE if prelude else "") + sql
        return f

    return keep


def _g(s: SparkSession, d: str) -> tuple[Graph, DataFrame]:
    g = Graph.load(s, d)
    return g, harness.trial_seeds(g)


def _compiled(s: SparkSession, d: str) -> harness.Compiled:
    g, sd = _g(s, d)
    return harness.Compiled(g, sd, harness.budgets(sd))


# --- scans, degrees, expansion ---------------------------------------------------------------------------------------
@query("symbol_scalars", "SELECT id, fqn, kind, file, l2, l3, ident, prov, len(refs2) AS n_refs2, len(refs3) AS n_refs3 FROM s")
def _(s, d):
    return Graph.load(s, d).symbols.select("id", "fqn", "kind", "file", "l2", "l3", "ident", "prov", F.size("refs2").alias("n_refs2"), F.size("refs3").alias("n_refs3"))


@query("edge_coalesce", "SELECT type, src, CAST(dst AS VARCHAR) AS dst, n AS deliveries FROM e")
def _(s, d):
    e = table(s, d, "edges").select(edge_type().alias("type"), "src", "dst")
    return graph_io.coalesce_edges(e).select("type", "src", F.col("dst").cast("string").alias("dst"), F.col("call_sites").alias("deliveries"))


@query("edge_type_counts", "SELECT type, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst FROM h GROUP BY 1")
def _(s, d):
    return Graph.load(s, d).hard.groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


@query("verify_readback", "SELECT 'symbols' AS what, count(*) AS n FROM s UNION ALL SELECT 'tests', count(*) FROM s WHERE kind = 'test' UNION ALL SELECT 'edges ' || type, count(*) FROM e GROUP BY type")
def _(s, d):
    g = Graph.load(s, d)
    return graph_io.verify(g.symbols, g.edges)


@query("degrees", "SELECT id, out_degree, in_degree FROM deg")
def _(s, d):
    return Graph.load(s, d).degrees()


@query("hub_nodes", "SELECT id, in_degree FROM deg WHERE in_degree > 500")
def _(s, d):
    return Graph.load(s, d).degrees().where(F.col("in_degree") > T.HUB).select("id", "in_degree")


@query("hub_nodes_20", "SELECT id, in_degree FROM deg WHERE in_degree > 20")
def _(s, d):
    return Graph.load(s, d).degrees().where(F.col("in_degree") > 20).select("id", "in_degree")


@query("kind_counts", "SELECT kind, count(*) AS n, CAST(sum(l3) AS BIGINT) AS l3_tokens FROM s GROUP BY 1")
def _(s, d):
    return Graph.load(s, d).symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("l3").alias("l3_tokens"))


@query("eligible_seeds", "SELECT id, fqn, l3 FROM el")
def _(s, d):
    return Graph.load(s, d).eligible().select("id", "fqn", "l3")


@query("trial_seeds", "SELECT trial, node FROM sd")
def _(s, d):
    return _g(s, d)[1]


@query("trial_seeds_all", _ALL)
def _(s, d):
    return harness.all_seeds(Graph.load(s, d))


@query("expand_forward", "SELECT trial, src, type, dst FROM sd JOIN h ON h.src = sd.node")
def _(s, d):
    g, sd = _g(s, d)
    return sd.join(g.hard, F.col("node") == F.col("src")).select("trial", "src", "type", "dst")


@query("expand_reverse", "SELECT trial, dst, type, src FROM sd JOIN h ON h.dst = sd.node")
def _(s, d):
    g, sd = _g(s, d)
    return sd.join(g.hard, F.col("node") == F.col("dst")).select("trial", "dst", "type", "src")


@query("undirected_one_hop", "SELECT trial, node, seed, type, way FROM oh")
def _(s, d):
    return C.one_hop(*_g(s, d))


# --- closure, cost, admission ------------------------------------------------------------------------------------------
@query("closure_profile_matrix", "SELECT trial, profile, node, level FROM lv")
def _(s, d):
    g, sd = _g(s, d)
    return g.closure(sd)


@query("closure_profile_matrix_all", _PRELUDE_ALL + "SELECT trial, profile, node, level FROM lv", prelude=False)
def _(s, d):
    g = Graph.load(s, d)
    return g.closure(harness.all_seeds(g))


for _p in PROFILES:

    @query(f"closure_{_p.name.lower()}", f"SELECT trial, node, level FROM lv WHERE profile = '{_p.name}'")
    def _(s, d, p=_p):
        g, sd = _g(s, d)
        return g.closure(sd, (p,)).select("trial", "node", "level")


@query("l1_lattice", "SELECT trial, profile, count(*) AS n FROM lv WHERE level = 1 GROUP BY ALL")
def _(s, d):
    g, sd = _g(s, d)
    return g.closure(sd).where("level = 1").groupBy("trial", "profile").agg(F.count(F.lit(1)).alias("n"))


@query("closure_cost", "SELECT trial, profile, emitted, files, source_tokens, provenance_tokens, identity_tokens, cost FROM co")
def _(s, d):
    g, sd = _g(s, d)
    return g.cost(g.closure(sd))


@query("mandatory_identities", "SELECT trial, profile, node, ident FROM mi")
def _(s, d):
    g, sd = _g(s, d)
    return g.mandatory_identities(g.closure(sd))


@query("profile_admission", "SELECT trial, budget, effective, status, profile, cost, deficit FROM ad")
def _(s, d):
    g, sd = _g(s, d)
    return g.admit(g.cost(g.closure(sd)), harness.budgets(sd))


@query(
    "exceeded_suggestions",
    _PRELUDE.replace("600 + (trial * 37 % 38) * 200", "300 + (trial * 37 % 38) * 20") + "SELECT trial, deficit, 'raise the budget to ' || CAST(ceil((effective + deficit) / 0.95) AS BIGINT) || ' tokens or start from fewer seeds' AS suggestion FROM ad WHERE status = 'EXCEEDED'",
    prelude=False,
)
def _(s, d):
    g, sd = _g(s, d)
    low = harness.budgets(sd).withColumn("budget", (F.lit(300) + (F.col("budget") - 600) / 10).cast("long"))
    return Graph.suggestion(g.admit(g.cost(g.closure(sd)), low))


@query(
    "induced_delta",
    """, s2 AS (SELECT trial, node FROM sd UNION SELECT trial, node FROM po WHERE place = 1),
      gn AS (SELECT trial, node, max(level) AS level, max(seeded) AS seeded FROM (SELECT trial, node, 3 AS level, true AS seeded FROM s2 UNION ALL SELECT trial, h.dst, 2, false FROM s2 JOIN h ON h.src = s2.node) GROUP BY ALL),
      gl AS (SELECT trial, node, max(level) AS level FROM (SELECT trial, node, level FROM gn UNION ALL SELECT trial, h.dst, 1 FROM gn JOIN h ON h.src = gn.node WHERE level = 2 AND NOT seeded) GROUP BY ALL)
      SELECT gl.trial, gl.node, gl.level FROM gl LEFT JOIN lv ON lv.trial = gl.trial AND lv.node = gl.node AND lv.profile = 'P3' WHERE gl.level > coalesce(lv.level, 0)""",
)
def _(s, d):
    g, sd = _g(s, d)
    levels = g.closure(sd, PROFILES[:1])
    best = C.pool(C.candidates(g, sd, levels.where("level >= 2"))).where("place = 1")
    return g.induced_delta(levels, best.select("trial", F.lit("P3").alias("profile"), "node", F.lit(3).alias("level"))).select("trial", "node", "level")


@query(
    "arm_floor_status",
    """, fl AS (SELECT trial, node, l3, prov, file, refs3 FROM sd JOIN s ON s.id = sd.node), fr AS (SELECT DISTINCT trial, unnest(refs3) AS node FROM fl),
      fm AS (SELECT fr.trial, CAST(sum(s.ident) AS BIGINT) AS ident FROM fr JOIN s ON s.id = fr.node WHERE NOT EXISTS (FROM fl WHERE fl.trial = fr.trial AND fl.node = fr.node) GROUP BY 1),
      fc AS (SELECT fl.trial, CAST(sum(l3 + prov) AS BIGINT) + 6 * count(*) + 13 * count(DISTINCT file) + 100 + coalesce(max(fm.ident), 0) AS floor FROM fl LEFT JOIN fm ON fm.trial = fl.trial GROUP BY 1)
      SELECT trial, budget, floor, CASE WHEN floor > budget THEN 'EXCEEDED' ELSE 'OK' END AS status, greatest(floor - budget, 0) AS deficit FROM fc JOIN bu USING (trial)""",
)
def _(s, d):
    g, sd = _g(s, d)
    return packing.floor_status(g, sd, harness.budgets(sd))


@query("status_histogram", "SELECT status, count(*) AS n, CAST(sum(deficit) AS BIGINT) AS deficit FROM ad GROUP BY 1")
def _(s, d):
    return QUERIES["profile_admission"](s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("deficit").alias("deficit"))


@query(
    "is_closed",
    """, br AS (SELECT DISTINCT lv.trial, lv.profile FROM lv JOIN pr ON pr.profile = lv.profile JOIN h ON h.src = lv.node LEFT JOIN lv x ON x.trial = lv.trial AND x.profile = lv.profile AND x.node = h.dst
      WHERE lv.level >= 2 AND coalesce(x.level, 0) < CASE WHEN lv.level >= 3 THEN least(2, CASE WHEN h.type IN ('CALLS', 'REFERENCES_TYPE') THEN direct ELSE other END) ELSE least(1, second) END)
      SELECT DISTINCT lv.trial, lv.profile, br.trial IS NULL AS closed FROM lv LEFT JOIN br ON br.trial = lv.trial AND br.profile = lv.profile""",
)
def _(s, d):
    g, sd = _g(s, d)
    lv = g.closure(sd)
    return lv.select("trial", "profile").distinct().join(g.unclosed(lv).select("trial", "profile", F.lit(False).alias("c")).distinct(), ["trial", "profile"], "left").select("trial", "profile", F.coalesce("c", F.lit(True)).alias("closed"))


@query(
    "unclosed_edges",
    "SELECT sd.trial, 'P3' AS profile, src, type, dst, 2 AS needed, coalesce(o.l, 0) AS level FROM sd JOIN h ON h.src = sd.node LEFT JOIN (SELECT trial, node, 3 AS l FROM sd) o ON o.trial = sd.trial AND o.node = h.dst WHERE coalesce(o.l, 0) < 2",
)
def _(s, d):
    g, sd = _g(s, d)
    return g.unclosed(sd.select("trial", F.lit("P3").alias("profile"), "node", F.lit(3).alias("level")))


@query(
    "closure_first_reason",
    """SELECT trial, node, via, edge FROM (SELECT sd.trial, h.dst AS node, h.src AS via, h.type AS edge FROM sd JOIN h ON h.src = sd.node WHERE NOT EXISTS (FROM sd x WHERE x.trial = sd.trial AND x.node = h.dst)
      QUALIFY row_number() OVER (PARTITION BY sd.trial, h.dst ORDER BY h.src, list_position(['REFERENCES_TYPE','CALLS','OVERRIDES','IMPLEMENTS','DECORATED_BY','READS_CONSTANT'], h.type)) = 1)""",
)
def _(s, d):
    g, sd = _g(s, d)
    return g.provenance(sd).where("seq = 1 and rule like '%(L3)->%'").select("trial", "node", "via", "edge")


@query("closure_provenance", f"{_WHY} SELECT trial, node, CAST(1 AS INTEGER) AS seq, via, edge, rule FROM why")
def _(s, d):
    g, sd = _g(s, d)
    return g.provenance(sd)


@query("provenance_complete", f"{_WHY} SELECT count(*) AS non_seeds, count(CASE WHEN NOT EXISTS (FROM why WHERE why.trial = lv.trial AND why.node = lv.node) THEN 1 END) AS without_reason FROM lv WHERE profile = 'P3' AND NOT EXISTS (FROM sd WHERE sd.trial = lv.trial AND sd.node = lv.node)")
def _(s, d):
    g, sd = _g(s, d)
    others = g.closure(sd, PROFILES[:1]).join(sd, ["trial", "node"], "left_anti")
    why = g.provenance(sd).select("trial", "node", F.lit(1).alias("w")).distinct()
    return others.join(why, ["trial", "node"], "left").agg(F.count(F.lit(1)).alias("non_seeds"), F.count(F.when(F.col("w").isNull(), 1)).alias("without_reason"))


@query("explain_referencing", "SELECT rf.trial, rf.node, rf.by FROM rf JOIN mi USING (trial, profile, node) WHERE profile = 'P3'")
def _(s, d):
    g, sd = _g(s, d)
    return cone.referenced_by(g, g.closure(sd, PROFILES[:1]))


@query("explain_chains", f"{_WHY} SELECT trial, node, CAST(1 AS INTEGER) AS depth, via, edge, rule FROM why UNION ALL SELECT a.trial, a.node, 2, b.via, b.edge, b.rule FROM why a JOIN why b ON b.trial = a.trial AND b.node = a.via")
def _(s, d):
    g, sd = _g(s, d)
    p = g.provenance(sd)
    return cone.explain(p, p.select("trial", "node"))


@query("round_trip_model", "SELECT trial, CAST(6 * (ceil(n1 / 500) + ceil(n2 / 500)) AS BIGINT) AS round_trips FROM (SELECT trial, count(CASE WHEN level = 3 THEN 1 END) AS n1, count(CASE WHEN level = 2 THEN 1 END) AS n2 FROM lv WHERE profile = 'P3' GROUP BY 1)")
def _(s, d):
    g, sd = _g(s, d)
    n = g.closure(sd, PROFILES[:1]).groupBy("trial").agg(F.count(F.when(F.col("level") == 3, 1)).alias("n1"), F.count(F.when(F.col("level") == 2, 1)).alias("n2"))
    return n.select("trial", T.round_trips(F.col("n1"), F.col("n2")).alias("round_trips"))


# --- candidates, packing, baselines ------------------------------------------------------------------------------------
@query("idf_scores", "SELECT id, round(ln((SELECT count(*) FROM s) / (1.0 + out_degree)), 6) AS idf FROM deg")
def _(s, d):
    g = Graph.load(s, d)
    return g.degrees().select("id", F.round(T.idf(g.symbols.count(), "out_degree"), 6).alias("idf"))


@query("static_callers", "SELECT trial, node, seed FROM sc")
def _(s, d):
    return C.static_callers(*_g(s, d))


@query("sibling_implementations", "SELECT trial, node, seed FROM sb")
def _(s, d):
    return C.siblings(*_g(s, d))


@query("class_siblings", "SELECT a.src AS node, b.src AS sibling, a.dst AS interface FROM h a JOIN h b ON a.dst = b.dst AND a.src <> b.src AND a.type = 'IMPLEMENTS' AND b.type = 'IMPLEMENTS' JOIN deg ON deg.id = a.dst WHERE in_degree <= 500")
def _(s, d):
    g = Graph.load(s, d)
    cool = g.degrees().where(F.col("in_degree") <= T.HUB).select(F.col("id").alias("dst"))
    i = g.hard.where("type = 'IMPLEMENTS'").select("src", "dst").join(cool, "dst", "left_semi")
    return i.select("dst", F.col("src").alias("node")).join(i.select("dst", F.col("src").alias("sibling")), "dst").where("node <> sibling").select("node", "sibling", F.col("dst").alias("interface"))


def _candidates(s, d):
    g, sd = _g(s, d)
    return C.candidates(g, sd, g.closure(sd, PROFILES[:1]).where("level >= 2"))


@query("candidates", "SELECT trial, node, source, links, first_link, round(score, 6) AS score FROM ca")
def _(s, d):
    return _candidates(s, d).select("trial", "node", "source", "links", "first_link", F.round("score", 6).alias("score"))


@query("containment_filter", "SELECT trial, node FROM en")
def _(s, d):
    g, sd = _g(s, d)
    near = C.static_callers(g, sd).select("trial", "node").union(C.siblings(g, sd).select("trial", "node")).distinct().join(sd, ["trial", "node"], "left_anti")
    name = g.symbols.select(F.col("id").alias("node"), "fqn")
    of = sd.join(name, "node").select("trial", F.col("fqn").alias("seed_fqn"))
    return near.join(name, "node").join(of, "trial").where(F.col("seed_fqn").startswith(F.concat("fqn", F.lit(".")))).select("trial", "node").distinct()


@query("candidate_pool_top150", "SELECT trial, node, place FROM po")
def _(s, d):
    return C.pool(_candidates(s, d)).select("trial", "node", "place")


@query("arm_b_ranking", "SELECT trial, node, count(*) AS links, out_degree, row_number() OVER (PARTITION BY trial ORDER BY out_degree, node) AS place FROM oh JOIN deg ON deg.id = oh.node GROUP BY trial, node, out_degree")
def _(s, d):
    return C.graph_ranking(*_g(s, d))


@query(
    "hint_order",
    """SELECT lv.trial, lv.node, s.ident, row_number() OVER (PARTITION BY lv.trial ORDER BY s.ident, lv.node) AS place FROM lv JOIN s ON s.id = lv.node
      WHERE profile = 'P3' AND level = 1 AND NOT EXISTS (FROM mi WHERE mi.trial = lv.trial AND mi.node = lv.node AND mi.profile = 'P3')""",
)
def _(s, d):
    g, sd = _g(s, d)
    none = sd.select("trial", "node", F.lit(0.0).alias("score")).limit(0)
    return C.hint_pool(g, g.closure(sd, PROFILES[:1]), none).select("trial", "node", "ident", "place")


@query("compile_summary")
def _(s, d):
    return _compiled(s, d).summary()


@query("pack_admissions")
def _(s, d):
    return _compiled(s, d).admitted


@query("hint_fill")
def _(s, d):
    return _compiled(s, d).hints.select("trial", "considered", "chosen", "tokens", "truncated")


@query("compile_distribution")
def _(s, d):
    r = _compiled(s, d).summary()
    return harness.distribution(r, "final_cost", ["status"])


@query("emit_contexts")
def _(s, d):
    return emission.emit(s, d, _compiled(s, d))


@query("emit_blocks")
def _(s, d):
    return emission.blocks(_compiled(s, d))


@query("unresolved_references", "SELECT CAST(0 AS BIGINT) AS trial, CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS ref FROM s WHERE false")
def _(s, d):
    return emission.unresolved(_compiled(s, d))


@query("arm_b_admission")
def _(s, d):
    g, sd = _g(s, d)
    n = g.symbols.count()
    return packing.in_rank_order(g, sd, C.graph_ranking(g, sd).select("trial", "node", T.idf(n, "out_degree").alias("score"), "place"), harness.budgets(sd))


@query("arm_a_admission")
def _(s, d):
    g = Graph.load(s, d)
    g = Graph(Stage(s, "arm-a").put(g.symbols), g.edges)
    sd = harness.trial_seeds(g)
    return cosine_admission.in_cosine_order(g, retrieval.clean_index(table(s, d, "vector_index")), sd, harness.budgets(sd))


# --- vectors -----------------------------------------------------------------------------------------------------------
_VEC = """v AS (SELECT ids AS id, min(CAST(embeddings AS DOUBLE[])) AS r FROM vector_index WHERE ids IS NOT NULL AND len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1),
u AS (SELECT id, list_transform(r, lambda x: x / sqrt(list_sum(list_transform(r, lambda y: y * y)))) AS vec FROM v WHERE list_sum(list_transform(r, lambda y: y * y)) > 0),
m AS (SELECT trial, i, avg(x) AS x FROM (SELECT trial, unnest(vec) AS x, unnest(range(1, 65)) AS i FROM sd JOIN u ON u.id = sd.node) GROUP BY ALL),
q0 AS (SELECT trial, list(x ORDER BY i) AS v FROM m GROUP BY 1),
q AS (SELECT trial, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS q FROM q0)"""


@query("query_vector", f", {_VEC} SELECT trial, unnest(range(0, 64)) AS i, round(unnest(q), 6) AS x FROM q")
def _(s, d):
    q = retrieval.query_vectors(retrieval.clean_index(table(s, d, "vector_index")), _g(s, d)[1])
    return q.select("trial", F.posexplode("q").alias("i", "x")).select("trial", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    "cosine_rank_top30",
    f", {_VEC} SELECT trial, u.id AS node, row_number() OVER (PARTITION BY trial ORDER BY round(list_dot_product(u.vec, q.q), 9) DESC, u.id) AS place FROM u CROSS JOIN q WHERE NOT EXISTS (FROM sd WHERE sd.trial = q.trial AND sd.node = u.id) QUALIFY place <= 30",
)
def _(s, d):
    r = retrieval.cosine_rank(retrieval.clean_index(table(s, d, "vector_index")), _g(s, d)[1], top=30)
    return r.select("trial", "node", "place")


@query(
    "index_report",
    """SELECT issue, count(*) AS n_rows FROM (SELECT CASE WHEN embeddings IS NULL OR ids IS NULL THEN 'null' WHEN len(embeddings) <> 64 THEN 'wrong length' WHEN len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite'
      WHEN list_sum(list_transform(embeddings, lambda x: CAST(x AS DOUBLE) * x)) = 0 THEN 'zero' WHEN abs(sqrt(list_sum(list_transform(embeddings, lambda x: CAST(x AS DOUBLE) * x))) - 1) > 1e-4 THEN 'not unit' END AS issue FROM vector_index) WHERE issue IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'repeated id', CAST(sum(n) AS BIGINT) FROM (SELECT count(*) - 1 AS n FROM vector_index WHERE ids IS NOT NULL GROUP BY ids) HAVING sum(n) > 0""",
    prelude=False,
)
def _(s, d):
    return retrieval.index_report(table(s, d, "vector_index"))


# --- cones and paths -----------------------------------------------------------------------------------------------------
def _cone(s, d):
    g, sd = _g(s, d)
    return g, *cone.impact_cone(g, sd.select(F.col("node").alias("root")))


@query("impact_cone_counts", "SELECT root, depth, count(*) AS n FROM cn GROUP BY ALL")
def _(s, d):
    return _cone(s, d)[1].groupBy("root", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("impact_cone_top30", "SELECT root, row_number() OVER (PARTITION BY root ORDER BY out_degree, node) AS place, node, fqn, file, depth FROM cn JOIN deg ON deg.id = cn.node JOIN s ON s.id = cn.node QUALIFY place <= 30")
def _(s, d):
    g, c, _ = _cone(s, d)
    return cone.cone_top(g, c).drop("idf")


@query(
    "impact_cone_stops",
    "SELECT root, root AS node, 'hub' AS reason FROM ro JOIN deg ON deg.id = root WHERE in_degree > 500 UNION ALL SELECT c1.root, c1.node, 'hub' FROM c1 JOIN k1 ON k1.root = c1.root AND n <= 200 JOIN deg ON deg.id = c1.node WHERE in_degree > 500",
)
def _(s, d):
    return _cone(s, d)[2].where("reason = 'hub'")


@query("path_enumeration", "SELECT sd.node AS source, a.dst AS target, 1 AS length FROM (SELECT DISTINCT node FROM sd) sd JOIN h a ON a.src = sd.node AND a.type = 'CALLS' AND a.dst <> sd.node UNION ALL SELECT sd.node, b.dst, 2 FROM (SELECT DISTINCT node FROM sd) sd JOIN h a ON a.src = sd.node AND a.type = 'CALLS' AND a.dst <> sd.node JOIN h b ON b.src = a.dst AND b.type = 'CALLS' AND b.dst <> a.dst AND b.dst <> sd.node")
def _(s, d):
    g, sd = _g(s, d)
    return cone.paths(g, sd.select(F.col("node").alias("source"))).select("source", "target", "length")


@query(
    "path_procedure",
    """SELECT source, target, length, path FROM (SELECT sd.node AS source, a.dst AS target, 1 AS length, [sd.node, a.dst] AS p FROM (SELECT DISTINCT node FROM sd) sd JOIN h a ON a.src = sd.node AND a.type = 'CALLS' AND a.dst <> sd.node
      UNION ALL SELECT sd.node, b.dst, 2, [sd.node, a.dst, b.dst] FROM (SELECT DISTINCT node FROM sd) sd JOIN h a ON a.src = sd.node AND a.type = 'CALLS' AND a.dst <> sd.node JOIN h b ON b.src = a.dst AND b.type = 'CALLS' AND b.dst <> a.dst AND b.dst <> sd.node), LATERAL (SELECT array_to_string(p, '>') AS path)
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY length, p) <= 10""",
)
def _(s, d):
    g, sd = _g(s, d)
    p = cone.path_procedure(g, sd.select(F.col("node").alias("source")), None, "CALLS", 2, 10)
    return p.select("source", "target", "length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "bounded_reachability",
    ", w AS (SELECT DISTINCT node AS source, node, 0 AS depth FROM sd UNION SELECT w.source, h.dst, w.depth + 1 FROM w JOIN h ON h.src = w.node WHERE w.depth < 3) SELECT source, node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0",
)
def _(s, d):
    from closura.operators.graph import HARD

    g, sd = _g(s, d)
    return cone.reachable(g, sd.select(F.col("node").alias("source")), HARD, 3)


# --- seed resolution -------------------------------------------------------------------------------------------------------
@query(
    "suffix_resolution",
    """, qs AS (SELECT DISTINCT string_split(fqn, '.')[-1] AS query FROM s UNION SELECT DISTINCT array_to_string(string_split(fqn, '.')[-2:], '.') FROM s),
      sx AS (SELECT id, fqn, array_to_string(p[k:], '.') AS query, k = 1 AS exact FROM (SELECT id, fqn, string_split(fqn, '.') AS p, unnest(range(1, len(string_split(fqn, '.')) + 1)) AS k FROM s))
      SELECT query, CASE WHEN max(CASE WHEN exact THEN id END) IS NOT NULL THEN max(CASE WHEN exact THEN id END) WHEN count(*) = 1 THEN min(id) ELSE -1 END AS id, CASE WHEN max(CASE WHEN exact THEN id END) IS NOT NULL THEN 1 ELSE count(*) END AS n_matches FROM qs JOIN sx USING (query) GROUP BY query""",
)
def _(s, d):
    g = Graph.load(s, d)
    q = g.symbols.where("fqn is not null").select(T.leaf("fqn").alias("query")).union(g.symbols.where("fqn is not null").select(T.last_two("fqn"))).distinct()
    return seeds.resolve_names(q, g).select("query", F.coalesce("id", F.lit(-1).cast("long")).alias("id"), "n_matches")


def _tasks(s, d):
    return table(s, d, "eval_items").select(F.col("item_id").alias("task_id"), F.col("text").alias("task"))


_WORDS = """, tw AS (SELECT DISTINCT item_id AS task_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM eval_items),
nw AS (SELECT DISTINCT id AS node, fqn, unnest(regexp_extract_all(lower(fqn), '[a-z0-9_]+')) AS w FROM s),
wm AS (SELECT task_id, node, fqn, count(*) AS overlap, row_number() OVER (PARTITION BY task_id ORDER BY count(*) DESC, fqn, node) AS place FROM tw JOIN nw USING (w) GROUP BY task_id, node, fqn QUALIFY place <= 20)"""


@query("task_token_overlap", f"{_WORDS} SELECT task_id, node, fqn, overlap, place FROM wm")
def _(s, d):
    return seeds.word_matches(_tasks(s, d), Graph.load(s, d))


@query(
    "connectivity_rerank",
    f"""{_WORDS}, ie AS (SELECT DISTINCT a.task_id, h.src, h.dst FROM wm a JOIN h ON h.dst = a.node AND h.type = 'CALLS' AND h.src <> h.dst JOIN deg ON deg.id = a.node AND in_degree <= 500 JOIN wm b ON b.task_id = a.task_id AND b.node = h.src),
      i2 AS (SELECT * FROM ie UNION SELECT x.task_id, x.src, y.dst FROM ie x JOIN ie y ON y.task_id = x.task_id AND y.src = x.dst WHERE x.src <> y.dst),
      pe AS (SELECT task_id, src AS node, dst AS peer FROM i2 UNION SELECT task_id, dst, src FROM i2)
      SELECT task_id, node, (SELECT count(*) FROM pe WHERE pe.task_id = wm.task_id AND pe.node = wm.node) AS score FROM wm""",
)
def _(s, d):
    g = Graph.load(s, d)
    return seeds.connectivity(seeds.word_matches(_tasks(s, d), g), g)


def _traces(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("task"))


_FRAMES = r""", fr AS (SELECT task_id, n - i AS frame, f[i] AS file, CAST(l[i] AS INTEGER) AS line, m[i] AS name FROM (SELECT *, len(f) AS n, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id AS task_id,
  regexp_extract_all(text, '(?m)^\s*File "([^"]+)", line (\d+), in (\S+)', 1) AS f, regexp_extract_all(text, '(?m)^\s*File "([^"]+)", line (\d+), in (\S+)', 2) AS l, regexp_extract_all(text, '(?m)^\s*File "([^"]+)", line (\d+), in (\S+)', 3) AS m FROM documents)))"""


@query("traceback_frames", f"{_FRAMES} SELECT task_id, CAST(frame AS INTEGER) AS frame, file, line, name FROM fr")
def _(s, d):
    return _traces(s, d).select("task_id", F.posexplode(T.frames("task")).alias("frame", "f")).select("task_id", "frame", "f.file", F.col("f.line").cast("int").alias("line"), "f.name")


@query("traceback_lost_frames")
def _(s, d):
    return seeds.traceback_seeds(_traces(s, d), Graph.load(s, d))[1]


@query("line_lookup", "SELECT a.id, min(b.id) AS found FROM (SELECT id, file, start_line AS line FROM s WHERE file IS NOT NULL AND start_line > 0) a JOIN s b ON b.file = a.file AND b.start_line <> 0 AND a.line BETWEEN b.start_line AND coalesce(nullif(b.end_line, 0), b.start_line) GROUP BY a.id")
def _(s, d):
    g = Graph.load(s, d)
    a = g.symbols.where("file is not null and start_line > 0").select("id", "file", F.col("start_line").alias("line"))
    hi = F.when(F.coalesce("end_line", F.lit(0)) == 0, F.col("start_line")).otherwise(F.col("end_line"))
    b = g.symbols.select("file", F.col("start_line").alias("lo"), hi.alias("hi"), F.col("id").alias("other"))
    return a.join(b, "file").where("lo <> 0 and line between lo and hi").groupBy("id").agg(F.min("other").alias("found"))


@query("resolve_tasks")
def _(s, d):
    return seeds.resolve_tasks(_tasks(s, d), Graph.load(s, d))


# --- functions, sinks, statistics ----------------------------------------------------------------------------------------------
@query(
    "name_functions",
    "SELECT id, string_split(fqn, '.')[-1] AS leaf, array_to_string(string_split(fqn, '.')[-2:], '.') AS last_two, regexp_replace(fqn, '\\.[^.]*$', '') AS owner, fqn || ' — ' || file || ':' || start_line AS identity, fqn || ' [extracted: ast+scip]' AS provenance, replace(regexp_replace(regexp_replace(regexp_replace(file, '\\.[^./]*$', ''), '^(src|lib)/', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM s",
)
def _(s, d):
    g = Graph.load(s, d).symbols
    return g.select("id", T.leaf("fqn").alias("leaf"), T.last_two("fqn").alias("last_two"), T.owner("fqn").alias("owner"), T.identity("fqn", "file", "start_line").alias("identity"), T.provenance_line("fqn").alias("provenance"), T.module_name("file").alias("module"))


@query("body_hash", "SELECT id, 'sha256:' || sha256(t3) AS hash, strlen(t3) AS bytes FROM s WHERE t3 IS NOT NULL")
def _(s, d):
    t = symbols_once(s, d, ["repr_L3_text"]).where("repr_L3_text is not null")
    return t.select("id", T.body_hash("repr_L3_text").alias("hash"), T.utf8_bytes("repr_L3_text").cast("long").alias("bytes"))


@query("oversize_report", "SELECT id, field, bytes FROM (SELECT id, unnest(['repr_L2_text', 'repr_L3_text', 'static_value', 'fqn', 'file']) AS field, unnest([strlen(t2), strlen(t3), strlen(sv), strlen(fqn), strlen(file)]) AS bytes FROM s) WHERE bytes > 1000")
def _(s, d):
    t = symbols_once(s, d, ["repr_L2_text", "repr_L3_text", "static_value", "fqn", "file", "body_hash"])
    return graph_io.oversize(t, 1000).where("field <> 'body_hash'").withColumn("bytes", F.col("bytes").cast("long"))


@query("closed_prefix", ", p AS (SELECT id FROM s ORDER BY id LIMIT 500) SELECT type, src, dst FROM e WHERE src IN (SELECT id FROM p) AND dst IN (SELECT id FROM p)")
def _(s, d):
    g = Graph.load(s, d)
    return graph_io.closed_prefix(g.symbols, g.edges, 500)[1].select("type", "src", "dst")


@query("upsert_edges", "SELECT type, src, CAST(dst AS VARCHAR) AS dst, CASE WHEN type = 'CALLS' THEN 1 ELSE coalesce(call_sites, -1) END AS call_sites FROM e")
def _(s, d):
    g = Graph.load(s, d)
    delta = g.edges.where("type = 'CALLS'").withColumn("call_sites", F.lit(1))
    out = graph_io.upsert(graph_io.upsert(g.edges, delta, ["type", "src", "dst"]), delta, ["type", "src", "dst"])
    return out.select("type", "src", F.col("dst").cast("string").alias("dst"), F.coalesce("call_sites", F.lit(-1)).alias("call_sites"))


@query("json_lines", """SELECT '{"type":"' || type || '","src":' || src || ',"dst":' || dst || '}' AS value FROM e WHERE dst IS NOT NULL""")
def _(s, d):
    return graph_io.json_lines(Graph.load(s, d).edges.where("dst is not null").select("type", "src", "dst"))


@query(
    "trial_percentiles",
    "SELECT profile, count(*) AS n, min(cost) AS least, median(cost) AS median, round(avg(cost), 6) AS mean, list_sort(list(cost))[least(count(*) - 1, CAST(floor(count(*) * 0.9) AS BIGINT)) + 1] AS p90, list_sort(list(cost))[least(count(*) - 1, CAST(floor(count(*) * 0.99) AS BIGINT)) + 1] AS p99, max(cost) AS most FROM co GROUP BY 1",
)
def _(s, d):
    g, sd = _g(s, d)
    return harness.distribution(g.cost(g.closure(sd)), "cost", ["profile"]).withColumn("mean", F.round("mean", 6))


@query(
    "arms_difference",
    ", a AS (SELECT DISTINCT trial, node FROM lv WHERE profile = 'P3'), b AS (SELECT DISTINCT trial, node FROM oh) SELECT 'closure only' AS part, count(*) AS n FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'one hop only', count(*) FROM (FROM b EXCEPT FROM a) UNION ALL SELECT 'both', count(*) FROM (FROM a INTERSECT FROM b)",
)
def _(s, d):
    g, sd = _g(s, d)
    a, b = g.closure(sd, PROFILES[:1]).select("trial", "node"), C.one_hop(g, sd).select("trial", "node").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(a.subtract(b), "closure only").union(n(b.subtract(a), "one hop only")).union(n(a.intersect(b), "both"))


@query("sampled_trials")
def _(s, d):
    return harness.sampled_seeds(Graph.load(s, d))


@query(
    "evidence_states",
    """, n AS (SELECT strftime(max(loaded_at), '%Y-%m') AS now FROM edges)
      SELECT CASE WHEN strftime(x.loaded_at, '%Y-%m') = n.now THEN 'current' WHEN x.src IN (SELECT id FROM s) AND x.dst IN (SELECT id FROM s) THEN 'historical_endpoints_intact' ELSE 'stale' END AS state, count(*) AS n_edges FROM edges x, n GROUP BY 1""",
)
def _(s, d):
    e = table(s, d, "edges").select(F.date_format("loaded_at", "yyyy-MM").alias("revision"), "src", "dst")
    now = e.agg(F.max("revision")).first()[0]
    ids = Graph.load(s, d).symbols.select("id")
    j = e.join(ids.select(F.col("id").alias("src"), F.lit(True).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(True).alias("b")), "dst", "left")
    state = T.evidence_state(F.col("revision"), F.lit(now), F.coalesce(F.col("a") & F.col("b"), F.lit(False)))
    return j.select(state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n_edges"))


# --- the store's query language ------------------------------------------------------------------------------------------
def _cypher(name: str, text: str, sql: str) -> None:
    query(name, sql)(lambda s, d: cypher.run(text, Graph.load(s, d)))


_cypher("cypher_typed_match", "MATCH (a:Symbol)-[:CALLS]->(b:Symbol) WHERE a.kind = 'method' AND NOT b.kind = 'class' RETURN a.id AS src, b.id AS dst", "SELECT src, dst FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE type = 'CALLS' AND a.kind = 'method' AND NOT b.kind = 'class'")
_cypher("cypher_reverse_aggregate", "MATCH (b)<-[:INHERITS_FROM]-(a) RETURN b.fqn AS base, count(*) AS n, min(a.fqn) AS least", "SELECT b.fqn AS base, count(*) AS n, min(a.fqn) AS least FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE type = 'INHERITS_FROM' GROUP BY 1")
_cypher("cypher_walk", "MATCH (a:Test)-[:CALLS*1..2]->(b) RETURN DISTINCT a.id AS src, b.id AS dst", "SELECT DISTINCT a.id AS src, x.dst FROM s a JOIN (SELECT src, dst FROM e WHERE type = 'CALLS' UNION SELECT x.src, y.dst FROM e x JOIN e y ON y.src = x.dst WHERE x.type = 'CALLS' AND y.type = 'CALLS') x ON x.src = a.id JOIN s b ON b.id = x.dst WHERE a.kind = 'test'")
_cypher("cypher_union", "MATCH (a) WHERE a.fqn STARTS WITH 'cobaltbarn.' OR a.l3 > 400 RETURN a.kind AS kind, a.id AS id UNION MATCH (a:Test) RETURN a.kind AS kind, a.id AS id", "SELECT kind, id FROM s WHERE starts_with(fqn, 'cobaltbarn.') OR l3 > 400 UNION SELECT kind, id FROM s WHERE kind = 'test'")
_cypher("cypher_top", "MATCH (a)-[:CALLS]->(b) RETURN b.id AS id, count(*) AS n ORDER BY n DESC, id SKIP 1 LIMIT 20", "SELECT dst AS id, count(*) AS n FROM e JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE type = 'CALLS' GROUP BY 1 ORDER BY n DESC, id LIMIT 20 OFFSET 1")
