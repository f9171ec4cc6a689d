"""Problem 5: a few keys hold most records.

Every result here is built from counts that are combined before they are shuffled (one row a key and map task), so a key
that holds a third of the table costs its reducer as much as any other. Joins between two skewed sides are never carried
out row by row: both sides are first reduced to a compact state per join key, the states are joined, and the counts are
multiplied (eager aggregation).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.sources.tables import edge_type

FIELDS = ("dst", "src", "type")


def heavy_keys(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(field, key, n_rows, share) of the keys that hold ``share`` of all rows or more; at most 1 / share a field.

    Two compact states meet: a row a key, and a row a field that is rolled up from the same partial counts (null keys count
    towards all rows). The second has three rows, so it goes to every task; no row of ``edges`` is read twice or joined.
    """
    keys = F.array(*[F.struct(F.lit(f"edges.{f}").alias("field"), (edge_type() if f == "type" else F.col(f)).cast("string").alias("key")) for f in FIELDS])
    state = edges.select(F.explode(keys).alias("k")).select("k.*").groupBy("field", "key").agg(F.count(F.lit(1)).alias("n_rows"), F.count("key").alias("named"))
    whole = state.groupBy("field").agg(F.sum("n_rows").alias("total"), F.sum("named").alias("keyed"))
    # a filter on counts stays above the aggregation, and both sides read the same columns: they share one exchange
    heavy = (F.col("named") > 0) & (F.col("named") <= F.col("keyed")) & (F.col("n_rows") >= F.lit(share) * F.col("total"))
    joined = state.join(F.broadcast(whole), "field").where(heavy)
    return joined.select("field", "key", "n_rows", (F.col("n_rows") / F.col("total")).alias("share"))


def key_profile(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(field, key, n_rows, n_neighbours, heavy) for all keys of edges.src and edges.dst.

    Neighbours are the distinct non-null other endpoints. First (key, neighbour) pairs are made distinct, which spreads
    a hot key over all tasks by its neighbours; the second, compact aggregation combines one partial row a task.
    """
    total = edges.count()
    ends = F.array(
        F.struct(F.lit("edges.src").alias("field"), F.col("src").alias("key"), F.col("dst").alias("nb")),
        F.struct(F.lit("edges.dst").alias("field"), F.col("dst").alias("key"), F.col("src").alias("nb")),
    )
    pairs = edges.select(F.explode(ends).alias("k")).select("k.*").where("key is not null").groupBy("field", "key", "nb").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("field", "key").agg(F.sum("n").alias("n_rows"), F.count("nb").alias("n_neighbours"))
    return out.withColumn("heavy", F.col("n_rows") >= F.lit(share) * F.lit(total))


def key_profile_all(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(field, key, n_rows, n_src, n_dst, heavy) for all keys of edges.dst, edges.src and edges.type, as strings.

    ``n_src`` and ``n_dst`` are the distinct non-null ends of the key's rows; null for the field that is the key itself.
    As in ``key_profile``, (key, end) pairs are made distinct first, so a type that holds most rows is spread over all
    tasks by its ends. Each key's rows are counted by the pairs of one side only.
    """
    total = edges.count()
    e = edges.select("src", "dst", edge_type().alias("type"))
    pair = lambda f, side: F.struct(F.lit(f"edges.{f}").alias("field"), F.col(f).cast("string").alias("key"), F.lit(side).alias("side"), F.col(side).alias("nb"))
    pairs = e.select(F.explode(F.array(pair("src", "dst"), pair("dst", "src"), pair("type", "src"), pair("type", "dst"))).alias("k")).select("k.*").where("key is not null")
    pairs = pairs.groupBy("field", "key", "side", "nb").agg(F.count(F.lit(1)).alias("n"))
    counted = F.when((F.col("field") != "edges.type") | (F.col("side") == "src"), F.col("n"))
    ends = lambda f: F.when(F.col("field") != f"edges.{f}", F.count(F.when(F.col("side") == f, F.col("nb")))).alias(f"n_{f}")
    out = pairs.groupBy("field", "key").agg(F.sum(counted).alias("n_rows"), ends("src"), ends("dst"))
    return out.withColumn("heavy", F.col("n_rows") >= F.lit(share) * F.lit(total))


def eager_join_counts(left: DataFrame, right: DataFrame, on: str, left_by: str, right_by: str) -> DataFrame:
    """Rows of ``left`` joined with ``right`` on ``on``, counted per (left_by, right_by), without making the joined rows.

    Both inputs are first reduced to (key, attribute, count); the states are joined and the counts multiplied, then
    summed. A key with a million rows on either side adds one product a pair of attributes instead of 10^12 rows.
    Null join keys match nothing. Counts are decimals, so products of large counts don't overflow.
    """
    a = left.where(F.col(on).isNotNull()).groupBy(on, left_by).agg(F.count(F.lit(1)).alias("_a"))
    b = right.where(F.col(on).isNotNull()).groupBy(on, right_by).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(b, on).groupBy(left_by, right_by).agg(F.sum(F.col("_a").cast("decimal(19,0)") * F.col("_b")).alias("n_pairs"))


def two_hop_types(edges: DataFrame) -> DataFrame:
    """(type_in, type_out, n_pairs): paths of two edge rows a -> b -> c by the types of their edges, over all b."""
    e = edges.withColumn("type", edge_type())
    into = e.select(F.col("dst").alias("node"), F.col("type").alias("type_in"))
    out = e.select(F.col("src").alias("node"), F.col("type").alias("type_out"))
    return eager_join_counts(into, out, "node", "type_in", "type_out")
