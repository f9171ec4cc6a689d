"""Problem 3: references to records that do not exist, were removed or arrive later, and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from closura.plans.skew import heavy_values, salted_left_join
from closura.plans.staging import Stage
from closura.sources.tables import edges_once, symbols_once, table


def _key_info(spark: SparkSession, root: str) -> DataFrame:
    """(ref_id, first_loaded, in_symbols, is_stub, removed_at, listed): one row an id that any of the tables names."""
    ts, no = F.lit(None).cast("timestamp"), F.lit(False)
    sym = table(spark, root, "symbols").select(F.col("id").alias("ref_id"), F.col("loaded_at").alias("first_loaded"), F.lit(True).alias("in_symbols"), no.alias("is_stub"), ts.alias("removed_at"), no.alias("listed"))
    stub = table(spark, root, "stub_symbols").select(F.col("id").alias("ref_id"), ts, no, F.lit(True), ts, no)
    gone = table(spark, root, "removed_symbols").select(F.col("symbol_id").alias("ref_id"), ts, no, no, F.col("removed_at"), F.lit(True))
    return (
        sym.union(stub).union(gone).where("ref_id is not null").groupBy("ref_id")
        .agg(F.min("first_loaded").alias("first_loaded"), F.max("in_symbols").alias("in_symbols"), F.max("is_stub").alias("is_stub"), F.min("removed_at").alias("removed_at"), F.max("listed").alias("listed"))
    )


def _references(spark: SparkSession, root: str) -> DataFrame:
    """(ref_field, owner_id, ref_id, indexed_at, at): every non-null reference of a first delivery."""
    e = edges_once(spark, root, ["indexed_at"])
    ends = F.array(
        F.struct(F.lit("edges.src").alias("ref_field"), F.col("dst").alias("owner_id"), F.col("src").alias("ref_id")),
        F.struct(F.lit("edges.dst").alias("ref_field"), F.col("src").alias("owner_id"), F.col("dst").alias("ref_id")),
    )
    from_edges = e.select(F.explode(ends).alias("r"), "indexed_at", F.col("loaded_at").alias("at")).select("r.*", "indexed_at", "at")
    s = symbols_once(spark, root, ["indexed_at", "repr_L3_refs"])
    from_symbols = s.select(F.lit("symbols.repr_L3_refs").alias("ref_field"), F.col("id").alias("owner_id"), F.explode("repr_L3_refs").alias("ref_id"), "indexed_at", F.col("loaded_at").alias("at"))
    return from_edges.union(from_symbols).where("ref_id is not null")


def orphan_references(spark: SparkSession, root: str) -> DataFrame:
    """(ref_field, owner_id, ref_id, period, status): the direct orphans, the first round of the cascade.

    ``removed`` if the id was removed at or before the load of the referring record; else nothing for stubs; else, for
    an id of ``symbols``, ``late`` if its first delivery was loaded after the referring record; else nothing for an id
    that ``removed_symbols`` lists; else ``missing``. A null reference is no case; a null load time of the referrer
    makes it neither late nor removed; rows are distinct; empty tables give no rows. Ids that hold a large part of all
    references are found by a sketch and salted.
    """
    refs = _references(spark, root)
    dst = table(spark, root, "edges").select(F.col("dst").alias("ref_id"))
    src = table(spark, root, "edges").select(F.col("src").alias("ref_id"))
    listed = table(spark, root, "symbols").select(F.explode("repr_L3_refs").alias("ref_id"))
    heavy = heavy_values(dst.union(src).union(listed), "ref_id")
    j = salted_left_join(refs, _key_info(spark, root), "ref_id", heavy, F.col("owner_id"))
    known = F.coalesce(F.col("in_symbols"), F.lit(False))
    status = (
        F.when(F.col("removed_at") <= F.col("at"), "removed")
        .when(F.coalesce(F.col("is_stub"), F.lit(False)), None)
        .when(known & (F.col("first_loaded") > F.col("at")), "late")
        .when(known | F.coalesce(F.col("listed"), F.lit(False)), None)
        .otherwise("missing")
    )
    return j.select("ref_field", "owner_id", "ref_id", F.date_format("indexed_at", "yyyy-MM").alias("period"), status.alias("status")).where("status is not null").distinct()


def orphan_report(spark: SparkSession, root: str) -> DataFrame:
    """(ref_field, period, status, n_refs): direct orphans counted per field and month of the referring record."""
    return orphan_references(spark, root).groupBy("ref_field", "period", "status").agg(F.count(F.lit(1)).alias("n_refs"))


def orphan_cascade(spark: SparkSession, root: str) -> DataFrame:
    """(record, src, dst, type, period, orphan, round): every orphaned record, direct (round 0) or inherited.

    Records are symbols (src = id, dst and type null) and edges; ids are given as strings, period is the month of the record's
    ``indexed_at``. Starting from the direct orphans of ``orphan_references``, a symbol inherits the state from any symbol it
    refers to; each round is one semi-join of the references to the symbols that were new in the round before, so a symbol is
    visited once and reference cycles end. An edge inherits it from either endpoint. ``round`` is the length of the shortest
    chain to a direct orphan. Ids that hold a large part of the edges are salted.
    """
    stage = Stage(spark, "cascade")
    direct = stage.put(orphan_references(spark, root))
    once = symbols_once(spark, root, ["repr_L3_refs", "indexed_at"])
    links = stage.put(once.select(F.col("id").alias("child"), F.explode("repr_L3_refs").alias("parent")).where("parent is not null and parent <> child").distinct())
    known = direct.where("ref_field = 'symbols.repr_L3_refs'").select(F.col("owner_id").alias("id")).distinct().withColumn("round", F.lit(0))
    known = frontier = stage.put(known)
    step, n = 0, 1
    while n:
        step += 1
        reached = links.join(frontier.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        frontier, n = stage.counted(reached.join(known, "id", "left_anti").withColumn("round", F.lit(step)))
        known = known.union(frontier)
    month, none = F.date_format("indexed_at", "yyyy-MM").alias("period"), F.lit(None).cast("string")
    symbols = known.join(once.select("id", "indexed_at"), "id").select(F.lit("symbol").alias("record"), F.col("id").cast("string").alias("src"), none.alias("dst"), none.alias("type"), month, "round")
    e = stage.put(edges_once(spark, root, ["indexed_at"]).select("src", "dst", "type", "indexed_at"))
    of_dst = F.col("ref_field") == "edges.dst"
    bad = direct.where("ref_field <> 'symbols.repr_L3_refs'").select(F.when(of_dst, F.col("owner_id")).otherwise(F.col("ref_id")).alias("s"), F.when(of_dst, F.col("ref_id")).otherwise(F.col("owner_id")).alias("d"), F.lit(0).alias("d0")).distinct()
    j = e.join(bad, F.col("src").eqNullSafe(F.col("s")) & F.col("dst").eqNullSafe(F.col("d")), "left").drop("s", "d")
    at = lambda c, n: known.select(F.col("id").alias(c), F.col("round").alias(n))
    j = salted_left_join(j, at("src", "rs"), "src", heavy_values(e, "src"), F.col("dst"))
    j = salted_left_join(j, at("dst", "rd"), "dst", heavy_values(e, "dst"), F.col("src"))
    edges = j.select(F.lit("edge").alias("record"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "type", month, F.coalesce("d0", F.least("rs", "rd") + 1).alias("round")).where("round is not null")
    return symbols.union(edges).withColumn("orphan", F.when(F.col("round") == 0, "direct").otherwise("inherited"))


def orphan_report_all(spark: SparkSession, root: str) -> DataFrame:
    """(record, period, orphan, n_records, most_rounds): direct and inherited orphans per kind of record and month."""
    return orphan_cascade(spark, root).groupBy("record", "period", "orphan").agg(F.count(F.lit(1)).alias("n_records"), F.max("round").alias("most_rounds"))
