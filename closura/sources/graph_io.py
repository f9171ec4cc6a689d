"""Reading and writing symbol graphs: JSON lines, Parquet, upserts, size policy and read-back checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from closura.functions import text as T
from closura.operators.graph import HARD

LONGS = S.ArrayType(S.LongType(), True)
#: The exchange contract of both relations; extra fields are ignored, missing ones are null.
SYMBOLS = S.StructType([
    S.StructField("id", S.LongType()), S.StructField("fqn", S.StringType()), S.StructField("kind", S.StringType()), S.StructField("file", S.StringType()), S.StructField("start_line", S.IntegerType()), S.StructField("end_line", S.IntegerType()), S.StructField("body_hash", S.StringType()),
    S.StructField("repr_L2_text", S.StringType()), S.StructField("repr_L2_tokens", S.IntegerType()), S.StructField("repr_L2_refs", LONGS), S.StructField("repr_L3_text", S.StringType()), S.StructField("repr_L3_tokens", S.IntegerType()), S.StructField("repr_L3_refs", LONGS),
    S.StructField("identity_tokens", S.IntegerType()), S.StructField("provenance_tokens", S.IntegerType()), S.StructField("evaluable", S.BooleanType()), S.StructField("static_value", S.StringType()), S.StructField("static_value_bytes", S.IntegerType()), S.StructField("mro_partial", S.BooleanType()),
])
EDGES = S.StructType([S.StructField("type", S.StringType()), S.StructField("src", S.LongType()), S.StructField("dst", S.LongType()), S.StructField("resolver", S.StringType()), S.StructField("confidence", S.DoubleType()), S.StructField("call_sites", S.IntegerType()), S.StructField("mandatory", S.BooleanType())])
KNOWN = (*HARD, "INHERITS_FROM")
TEXT_COLUMNS = ("repr_L2_text", "repr_L3_text", "static_value")
CAP = 32_000


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYMBOLS).json(path).fillna(0, ["start_line", "end_line"])


def read_edges(spark: SparkSession, path: str, display: bool = True) -> DataFrame:
    """Edges of a JSON-lines file; an unknown type fails the read, INHERITS_FROM can be left out."""
    e = spark.read.schema(EDGES).json(path)
    e = e.withColumn("type", F.when(F.col("type").isin(*KNOWN), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown edge type: "), F.coalesce("type", F.lit("null"))))))
    return e if display else e.where(F.col("type") != "INHERITS_FROM")


def json_lines(df: DataFrame) -> DataFrame:
    """(value): one compact JSON object a row, fields in column order, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """JSON lines in ``order``; range partitioned, so the files in name order are sorted. ``files=1`` for a single file."""
    df = df.repartitionByRange(files, *order) if files else df.repartitionByRange(*order)
    json_lines(df.sortWithinPartitions(*order)).write.mode("overwrite").text(path)


def write_graph(symbols: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet, one pass each; edges partitioned by type so that a type filter prunes files."""
    symbols.write.mode("overwrite").parquet(f"{path}/symbols")
    edges.withColumn("call_sites", F.when(F.col("type") == "CALLS", F.coalesce("call_sites", F.lit(1)))).repartition("type").write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``delta`` in place of those with the same key; running it again changes nothing.

    Keys are compared null-safe. Of several delta rows with one key the largest counts.
    """
    rest = [c for c in base.columns if c not in keys]
    pick = delta.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*base.columns)
    match = reduce(lambda a, b: a & b, [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])
    return base.alias("b").join(pick.select(*keys).alias("d"), match, "left_anti").select(*base.columns).union(pick)


def coalesce_edges(rows: DataFrame) -> DataFrame:
    """(type, src, dst, call_sites): one row an edge, counting its occurrences."""
    return rows.groupBy("type", "src", "dst").agg(F.count(F.lit(1)).alias("call_sites"))


def verify(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, n): what a read-back must find: symbols, tests, and edges of each type."""
    a = symbols.agg(F.count(F.lit(1)).alias("symbols"), F.count(F.when(F.col("kind") == "test", 1)).alias("tests")).select(F.explode(F.array(F.struct(F.lit("symbols").alias("what"), F.col("symbols").alias("n")), F.struct(F.lit("tests").alias("what"), F.col("tests").alias("n")))).alias("x")).select("x.*")
    return a.union(edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("edges "), F.coalesce("type", F.lit("null"))), "n"))


def oversize(symbols: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, field, bytes): texts over ``cap`` bytes; they are reported, never cut."""
    f = F.array(*[F.struct(F.lit(c).alias("field"), T.utf8_bytes(c).alias("bytes")) for c in (*TEXT_COLUMNS, "fqn", "file", "body_hash")])
    return symbols.select("id", F.explode(f).alias("x")).select("id", "x.*").where(F.col("bytes") > cap)


def closed_prefix(symbols: DataFrame, edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` symbols with the smallest ids, and the edges with both ends among them."""
    s = symbols.orderBy("id").limit(n)
    ids = s.select("id")
    return s, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of one column hold the same values equally often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def chunks(rows: Iterable[dict], most: int = 500, size: int = 1_500_000, weigh=lambda r: len(str(r).encode())) -> Iterator[list[dict]]:
    """Batches by rows and bytes for sinks with request limits; a row above ``size`` goes alone."""
    held, total = [], 0
    for r in rows:
        w = weigh(r)
        if held and (len(held) == most or total + w > size):
            yield held
            held, total = [], 0
        held.append(r)
        total += w
    if held:
        yield held


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last definition of each key wins."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
