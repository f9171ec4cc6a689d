"""Keys that hold a large part of the rows: finding them in one pass and joining on them without a hot task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closura.plans.staging import Stage

#: Keys tracked by the heavy-hitter sketch; its counts are off by at most about rows / TRACKED * 3.5.
TRACKED, SHARE = 8192, 0.01


def heavy_values(df: DataFrame, key: str, share: float = SHARE) -> list:
    """Values of ``key`` that may hold ``share`` of the rows or more; at most 2 / share of them reach the driver.

    One mergeable sketch of fixed size per task, whatever the number of keys. A key within the sketch's error of the
    threshold may be named or not: heavy keys are only salted, so that changes no result. Nulls are no keys; an empty
    table has no heavy keys.
    """
    row = df.agg(F.count(key).alias("n"), F.expr(f"approx_top_k({key}, {int(2 / share)}, {TRACKED})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] >= share * row["n"] and x["count"] > 1000]


def salted_left_join(left: DataFrame, right: DataFrame, key: str, heavy: list, spread: Column, salts: int = 32) -> DataFrame:
    """Left join to a table with one row a key. Rows of ``heavy`` keys are spread over ``salts`` tasks by ``spread``.

    Only the heavy keys (a bounded list) are repeated on the right side, so the right side grows by at most
    len(heavy) * salts rows.
    """
    if not heavy:
        return left.join(right, key, "left")
    hot = F.col(key).isin(heavy)
    lhs = left.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0))
    rhs = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return lhs.join(rhs, [key, "_salt"], "left").drop("_salt")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``p``, the place of each row by ``key`` from 1 on (keys are unique), without one task for all rows.

    Rows are range-partitioned and ranked within their range; the ranges' sizes, a row a partition, give the offsets.
    """
    stage, n = Stage(df.sparkSession, "ranked"), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage.put(df.repartitionByRange(n, key).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return cut.join(F.broadcast(sizes), "_part").withColumn("p", own + F.col("_base")).drop("_part", "_base")
