"""Queries and SQL of the training-data problems tagged llm (1, 4, 6, 7 and 8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from closura.llm import leakage, mixing, near_duplicates, residue, vectors
from closura.sources.tables import symbols_once, table


def _symbol_texts(s, d):
    return symbols_once(s, d, ["repr_L3_text"]).select("id", F.col("repr_L3_text").alias("text"))


def _near(s, d):
    return near_duplicates.NearDuplicates(_symbol_texts(s, d), words=3, t=0.7, least=30)


QUERIES = {
    "p1_found": lambda s, d: vectors.similar_pairs(table(s, d, "vector_index")),
    "p1_neighbours": lambda s, d: vectors.similar_vectors(table(s, d, "vector_index")),
    "p4_found": lambda s, d: _near(s, d).pairs().select("id_a", "id_b"),
    "p4_groups": lambda s, d: _near(s, d).groups(),
    "p6_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p6_paraphrases": lambda s, d: leakage.paraphrased_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p7_mix": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "source_weights")).selection(),
    "p7_shares": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "source_weights")).shares(),
    "p7_invariants": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "source_weights")).invariants(),
    "p8_found": lambda s, d: residue.residue(table(s, d, "documents")).select("doc_id"),
    "p8_kinds": lambda s, d: residue.residue(table(s, d, "documents")),
}

_P1 = """
v AS (SELECT ids AS id, min(CAST(embeddings AS DOUBLE[64])) AS e FROM vector_index WHERE embeddings IS NOT NULL AND len(embeddings) = 64
        AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0 GROUP BY ids),
n AS (SELECT a.id, b.id AS nbr, round(array_cosine_similarity(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.id <> b.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr) AS rank FROM n QUALIFY rank <= 10)"""

_P4 = """
s AS (SELECT id, arg_min(repr_L3_text, loaded_at) AS text FROM symbols GROUP BY id),
w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM s WHERE text IS NOT NULL),
g AS (SELECT DISTINCT id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS g FROM (SELECT id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 30)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS bo FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
f AS (SELECT id_a, id_b, bo / (x.n + y.n - bo) AS sim FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE bo >= 0.7 * (x.n + y.n - bo) - 1e-9)"""

_P6 = """
d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM eval_items WHERE text IS NOT NULL),
x AS (SELECT id, array_to_string(t[n:n + 11], ' ') AS g FROM (SELECT id, t, unnest(range(1, len(t) - 10)) AS n FROM d)),
y AS (SELECT id, array_to_string(t[n:n + 11], ' ') AS g FROM (SELECT id, t, unnest(range(1, len(t) - 10)) AS n FROM i))"""

_P4_GROUPS = """
k AS (SELECT id, list(g ORDER BY g) AS key FROM g GROUP BY id),
m AS (SELECT id, min(id) OVER (PARTITION BY key) AS cid FROM k),
r AS (SELECT id_a AS a, id_b AS b FROM f JOIN m x ON x.id = id_a JOIN m y ON y.id = id_b WHERE x.id = x.cid AND y.id = y.cid),
v AS (SELECT a, b FROM r UNION ALL SELECT b, a FROM r),
z AS (SELECT a, b FROM v UNION SELECT z.a, v.b FROM z JOIN v ON v.a = z.b)"""

_P7 = r"""
w AS (SELECT replace(lower(trim(source)), '-', '_') AS source, max(weight) AS weight, arg_max(coalesce(max_repeats, 1), weight) AS max_repeats FROM source_weights WHERE source IS NOT NULL AND weight > 0 GROUP BY 1),
d AS (SELECT replace(lower(trim(source)), '-', '_') AS source, count(*) AS n_docs FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\S') GROUP BY 1)"""

SQL = {
    "p7_invariants": f"WITH {_P7} SELECT source, n_docs, round(weight / sum(weight) OVER (), 9) AS target_share, max_repeats, true AS in_target, true AS repeats_kept, true AS uses_distinct FROM w JOIN d USING (source) WHERE max_repeats > 0",
    "p4_groups": f"""WITH RECURSIVE {_P4}, {_P4_GROUPS} SELECT m.id, m.cid AS class_id, least(m.cid, coalesce((SELECT min(b) FROM z WHERE z.a = m.cid), m.cid)) AS group_id,
      (SELECT count(*) FROM v WHERE v.a = m.cid) AS n_links FROM m""",
    "p6_found": f"WITH {_P6} SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y ON x.g = y.g",
    "p4_found": f"WITH {_P4} SELECT id_a, id_b FROM f",
    "p1_found": f"WITH {_P1} SELECT DISTINCT least(id, nbr) AS id_a, greatest(id, nbr) AS id_b FROM t",
    "p1_neighbours": f"WITH {_P1} SELECT id, nbr, sim, rank FROM t",
}
