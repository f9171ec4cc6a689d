"""Cutting lineage with tables written to the folder that the cluster names in ``spark.checkpoint.dir``.

A staged table is plain Parquet in the shared folder: it survives the loss of any executor, gives the planner real sizes
and takes a fraction of the room that serialised rows take. Loops drop the table of the round before the last.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"
#: Spark's setting that removes the shuffle files of a job when it ends; else they stay until the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only a local session (tests) may fall back to a temporary one."""
    where = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY, None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError(f"{KEY} must name a folder that all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="closura-")
    spark.conf.set(KEY, where)
    return where


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        _delete(spark, path)


class Stage:
    """Tables of one operator run, under a folder of its own that is removed when the driver's Python ends.

    Results may be read until then, as they are lazy. ``tidy``: the shuffle files of a table go when it is written.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.base, self.n, self.tidy = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0, tidy
        atexit.register(_clean, spark, self.base)

    def put(self, df: DataFrame, **options) -> DataFrame:
        """Write ``df`` and give it back as a table without lineage."""
        path, self.n = f"{self.base}/{self.n}", self.n + 1
        before = self.spark.conf.get(TIDY, None)
        if self.tidy:
            self.spark.conf.set(TIDY, "true")
        try:
            df.write.options(**options).parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.unset(TIDY) if before is None else self.spark.conf.set(TIDY, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged = path
        return out

    def counted(self, df: DataFrame, where: str | Column = "true") -> tuple[DataFrame, int]:
        """``put``, and how many of the rows meet ``where``; counted while they are written, so it takes no job of its own."""
        seen = Observation()
        out = self.put(df.observe(seen, F.count_if(F.expr(where) if isinstance(where, str) else where).alias("n")))
        return out, seen.get["n"]

    def address(self, df: DataFrame) -> str:
        """Where a staged table lies, with the scheme of its file system, for tasks that open its files themselves."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()

    def drop(self, df: DataFrame) -> None:
        """Remove a staged table that nothing reads any more."""
        path = getattr(df, "_staged", None)
        if path:
            _delete(self.spark, path)
            df._staged = None
