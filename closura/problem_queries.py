"""Queries and SQL of the general training-data problems (2, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura.operators import hierarchy, integrity, skewed_keys
from closura.sources.tables import table

QUERIES = {
    "p2_found": lambda s, d: hierarchy.hierarchy_roots(s, d),
    "p2_below": lambda s, d: hierarchy.hierarchy_below(s, d).withColumn("cycle_id", F.col("cycle_id").cast("string")),
    "p2_paths": lambda s, d: hierarchy.hierarchy_paths(s, d),
    "p3_found": lambda s, d: integrity.orphan_references(s, d),
    "p3_report": lambda s, d: integrity.orphan_report(s, d),
    "p3_cascade": lambda s, d: integrity.orphan_cascade(s, d),
    "p3_report_all": lambda s, d: integrity.orphan_report_all(s, d),
    "p5_found": lambda s, d: skewed_keys.heavy_keys(table(s, d, "edges")).select("field", "key"),
    "p5_profile": lambda s, d: skewed_keys.key_profile(table(s, d, "edges")),
    "p5_profile_all": lambda s, d: skewed_keys.key_profile_all(table(s, d, "edges")),
    "p5_two_hop_types": lambda s, d: skewed_keys.two_hop_types(table(s, d, "edges")).withColumn("n_pairs", F.col("n_pairs").cast("string")),
}

_REFS = """
e AS (SELECT upper(trim(type)) AS type, src, dst, min(loaded_at) AS ld, min(indexed_at) AS indexed_at FROM edges GROUP BY 1, 2, 3),
s AS (SELECT id, min(loaded_at) AS ld, arg_min(indexed_at, loaded_at) AS indexed_at, arg_min(repr_L3_refs, loaded_at) AS refs FROM symbols GROUP BY id),
r AS (SELECT 'edges.src' AS ref_field, dst AS owner_id, src AS ref_id, indexed_at, ld FROM e
      UNION ALL SELECT 'edges.dst', src, dst, indexed_at, ld FROM e
      UNION ALL SELECT 'symbols.repr_L3_refs', id, unnest(refs), indexed_at, ld FROM s),
g AS (SELECT symbol_id, min(removed_at) AS removed_at FROM removed_symbols GROUP BY symbol_id),
c AS (SELECT ref_field, owner_id, r.ref_id, strftime(r.indexed_at, '%Y-%m') AS period,
        CASE WHEN g.removed_at <= r.ld THEN 'removed' WHEN t.id IS NOT NULL THEN NULL WHEN s.id IS NOT NULL AND s.ld > r.ld THEN 'late'
             WHEN s.id IS NOT NULL OR g.symbol_id IS NOT NULL THEN NULL ELSE 'missing' END AS status
      FROM r LEFT JOIN g ON g.symbol_id = r.ref_id LEFT JOIN stub_symbols t ON t.id = r.ref_id LEFT JOIN s ON s.id = r.ref_id WHERE r.ref_id IS NOT NULL),
f AS (SELECT DISTINCT * FROM c WHERE status IS NOT NULL)"""

_CASCADE = """
l AS (SELECT DISTINCT id AS child, unnest(refs) AS parent FROM s),
w AS (SELECT DISTINCT owner_id AS id, 0 AS round FROM f WHERE ref_field = 'symbols.repr_L3_refs'
      UNION SELECT l.child, w.round + 1 FROM w JOIN l ON l.parent = w.id WHERE w.round < (SELECT count(*) FROM s)),
o AS (SELECT id, min(round) AS round FROM w GROUP BY id),
d AS (SELECT DISTINCT CASE ref_field WHEN 'edges.dst' THEN owner_id ELSE ref_id END AS src, CASE ref_field WHEN 'edges.dst' THEN ref_id ELSE owner_id END AS dst
      FROM f WHERE ref_field <> 'symbols.repr_L3_refs'),
x AS (SELECT 'edge' AS record, e.src, e.dst, e.type, e.indexed_at, CASE WHEN d.src IS NOT NULL OR d.dst IS NOT NULL THEN 0 ELSE least(a.round, b.round) + 1 END AS round
      FROM e LEFT JOIN d ON e.src IS NOT DISTINCT FROM d.src AND e.dst IS NOT DISTINCT FROM d.dst LEFT JOIN o a ON a.id = e.src LEFT JOIN o b ON b.id = e.dst),
z AS (SELECT record, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, type, strftime(indexed_at, '%Y-%m') AS period, round, CASE WHEN round = 0 THEN 'direct' ELSE 'inherited' END AS orphan FROM
      (SELECT 'symbol' AS record, o.id AS src, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS VARCHAR) AS type, s.indexed_at, o.round FROM o JOIN s USING (id) UNION ALL SELECT * FROM x WHERE round IS NOT NULL))"""

_KEYS = """k AS (SELECT 'edges.dst' AS field, CAST(dst AS VARCHAR) AS key FROM edges UNION ALL SELECT 'edges.src', CAST(src AS VARCHAR) FROM edges
      UNION ALL SELECT 'edges.type', upper(trim(type)) FROM edges)"""

_LINKS = """
s AS (SELECT id, any_value(fqn) AS fqn, arg_min(parent_class, loaded_at) AS pc FROM symbols GROUP BY id),
k AS (SELECT id, fqn FROM s UNION SELECT id, fqn FROM stub_symbols),
l AS (SELECT DISTINCT 'inherits' AS hier, src AS c, dst AS p FROM edges WHERE upper(trim(type)) = 'INHERITS_FROM' AND src IN (SELECT id FROM s) AND dst IN (SELECT id FROM k)
      UNION SELECT 'contains', s.id, k.id FROM s JOIN k ON k.fqn = regexp_replace(s.pc, '^\\s+|\\s+$', '', 'g')),
w AS (SELECT hier, c, p, 1 AS d FROM l UNION SELECT w.hier, w.c, l.p, w.d + 1 FROM w JOIN l ON l.hier = w.hier AND l.c = w.p WHERE w.d < (SELECT count(*) FROM l)),
b AS (SELECT hier, c, p, min(d) AS d FROM w GROUP BY ALL),
m AS (SELECT hier, c AS m, c AS at FROM b WHERE c = p UNION SELECT m.hier, m.m, l.p FROM m JOIN l ON l.hier = m.hier AND l.c = m.at AND l.p > m.m),
y AS (SELECT DISTINCT m.hier, m.m FROM m JOIN l ON l.hier = m.hier AND l.c = m.at AND l.p = m.m)"""

_TOPS = """
t AS (SELECT DISTINCT hier, p AS top FROM l WHERE NOT EXISTS (FROM l x WHERE x.hier = l.hier AND x.c = l.p)),
u AS (SELECT hier, c, p, [c, p] AS path FROM l UNION ALL SELECT u.hier, u.c, l.p, list_append(u.path, l.p) FROM u JOIN l ON l.hier = u.hier AND l.c = u.p WHERE u.p <> u.c AND (l.p = u.c OR NOT list_contains(u.path, l.p))),
q AS (SELECT hier, c, p, min(struct_pack(n := len(path), path := path)) AS v FROM u WHERE EXISTS (FROM t WHERE t.hier = u.hier AND t.top = u.p) OR EXISTS (FROM y WHERE y.hier = u.hier AND y.m = u.p) GROUP BY ALL)"""

SQL = {
    "p2_found": f"""WITH RECURSIVE {_LINKS}
      SELECT hier, c AS id, p AS root_id, CAST(d AS INTEGER) AS depth FROM b WHERE NOT EXISTS (FROM l WHERE l.hier = b.hier AND l.c = b.p)
      UNION ALL SELECT b.hier, b.c, y.m, -1 FROM b JOIN y ON y.hier = b.hier AND y.m = b.p""",
    "p2_below": f"""WITH RECURSIVE {_LINKS}
      SELECT hier, p AS id, c AS below_id, d AS depth, (SELECT min(x.p) FROM b x JOIN b z ON z.hier = x.hier AND z.c = x.p AND z.p = x.c WHERE x.hier = b.hier AND x.c = b.p)::VARCHAR AS cycle_id FROM b""",
    "p2_paths": f"""WITH RECURSIVE {_LINKS}, {_TOPS}
      SELECT hier, c AS id, p AS root_id, CASE WHEN EXISTS (FROM t WHERE t.hier = q.hier AND t.top = q.p) THEN v.n - 1 ELSE -1 END AS depth, array_to_string(list_reverse(v.path), '/') AS path FROM q
      UNION ALL SELECT hier, top, top, 0, CAST(top AS VARCHAR) FROM t""",
    "p3_found": f"WITH {_REFS} SELECT * FROM f",
    "p3_report": f"WITH {_REFS} SELECT ref_field, period, status, count(*) AS n_refs FROM f GROUP BY ALL",
    "p3_cascade": f"WITH RECURSIVE {_REFS}, {_CASCADE} SELECT * FROM z",
    "p3_report_all": f"WITH RECURSIVE {_REFS}, {_CASCADE} SELECT record, period, orphan, count(*) AS n_records, max(round) AS most_rounds FROM z GROUP BY ALL",
    "p5_found": f"WITH {_KEYS} SELECT field, key FROM k WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)",
    "p5_profile": """WITH k AS (SELECT 'edges.src' AS field, src AS key, dst AS nb FROM edges UNION ALL SELECT 'edges.dst', dst, src FROM edges)
      SELECT field, key, count(*) AS n_rows, count(DISTINCT nb) AS n_neighbours, count(*) >= 0.02 * (SELECT count(*) FROM edges) AS heavy FROM k WHERE key IS NOT NULL GROUP BY 1, 2""",
    "p5_two_hop_types": """SELECT upper(trim(a.type)) AS type_in, upper(trim(b.type)) AS type_out, count(*)::VARCHAR AS n_pairs FROM edges a JOIN edges b ON a.dst = b.src GROUP BY 1, 2""",
}
