"""The project's tables: reading them, and the first delivery of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAR = "9999-12-31 00:00:00"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def edge_type(c: str | Column = "type") -> Column:
    """Edge types are compared after removing surrounding blanks and upper-casing."""
    return F.upper(F.trim(F.col(c) if isinstance(c, str) else c))


def first_delivery(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key: the one with the smallest ``loaded_at`` (nulls last, further ties by the columns' order).

    A minimum over structs, so hot keys are combined before the shuffle. ``columns`` are kept besides the keys.
    """
    order = [F.coalesce(F.col("loaded_at"), F.lit(FAR).cast("timestamp")).alias("_o")]
    got = df.groupBy(*keys).agg(F.min(F.struct(*order, "loaded_at", *columns)).alias("_r"))
    return got.select(*keys, "_r.loaded_at", *[F.col(f"_r.{c}").alias(c) for c in columns])


def symbols_once(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    return first_delivery(table(spark, root, "symbols").where("id is not null"), ["id"], columns)


def edges_once(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    e = table(spark, root, "edges").withColumn("type", edge_type())
    return first_delivery(e, ["type", "src", "dst"], columns)
