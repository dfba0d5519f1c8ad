"""Stored tables in hash buckets: a change rewrites the buckets it touches
(M-3, M-7, P-4, M-10, A-12).

A table is a Parquet folder partitioned by a hash bucket of its key.  Changes
are matched by bucket: only the partitions that hold a changed key are read
(static partition pruning) and overwritten (dynamic partition overwrite); the
rest of the table is not touched.  Choose ``buckets`` so that one bucket is a
task's worth of rows; keys are unique, so buckets are even.

A batch that changes several tables first writes the new buckets of all of
them aside, under its batch id, then overwrites the tables' partitions from
there.  Whatever fails in between, running the batch again ends in the same
state: an incomplete staging is made anew, a complete one is only copied, and
a published batch is left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BUCKET = "_bucket"


@dataclass(frozen=True)
class Bucketed:
    path: str
    key: str
    buckets: int = 64

    def bucket(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def create(self, df: DataFrame) -> None:
        """Write the table for the first time."""
        (df.withColumn(BUCKET, self.bucket()).repartition(BUCKET)
         .write.partitionBy(BUCKET).parquet(self.path))

    def read(self, spark: SparkSession, only: list[int] | None = None) -> DataFrame:
        """The table, or the rows of the buckets ``only``."""
        rows = spark.read.parquet(self.path)
        return (rows if only is None else rows.filter(F.col(BUCKET).isin(only))).drop(BUCKET)

    def touched(self, changes: DataFrame, key: str | None = None) -> list[int]:
        """The buckets of the keys of ``changes``: at most ``buckets`` numbers."""
        return sorted(r[0] for r in changes.select(self.bucket(key)).distinct().collect())


@dataclass(frozen=True)
class Change:
    """``rows``: the whole new content of the buckets ``touched``."""
    table: Bucketed
    rows: DataFrame
    touched: list[int]


def _marked(spark: SparkSession, path: str) -> bool:
    try:
        return spark.read.schema("id long").parquet(path).count() > 0
    except AnalysisException:
        return False


def _mark(spark: SparkSession, path: str) -> None:
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, staging: str, batch_id: str, changes: Callable[[], dict[str, Change]]) -> list[str]:
    """Apply the changes of a batch, once: ``changes`` is called (it reads the
    tables as they are) unless the batch is staged or published already.
    Returns the names of the tables written, none for a published batch."""
    base = f"{staging.rstrip('/')}/{batch_id}"
    if _marked(spark, f"{base}/published"):
        return []
    if not _marked(spark, f"{base}/staged"):
        rows = []
        for name, c in changes().items():
            if c.touched:
                c.rows.withColumn(BUCKET, c.table.bucket()).write.mode("overwrite").parquet(f"{base}/rows/{name}")
                rows += [(name, c.table.path, c.table.key, c.table.buckets, b) for b in c.touched]
        spark.createDataFrame(rows, "name string, path string, key string, buckets int, bucket int") \
            .coalesce(1).write.mode("overwrite").parquet(f"{base}/touched")
        _mark(spark, f"{base}/staged")
    # one row per touched bucket: bounded by the tables' bucket counts
    plan: dict[str, list] = {}
    for r in spark.read.parquet(f"{base}/touched").collect():
        plan.setdefault(r["name"], []).append(r)
    for name, buckets in plan.items():
        staged, path = spark.read.parquet(f"{base}/rows/{name}"), buckets[0]["path"]
        (staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(path))
        # a bucket that lost its last row gives no partition to overwrite
        filled = {r[0] for r in staged.select(BUCKET).distinct().collect()}
        for b in sorted({r["bucket"] for r in buckets} - filled):
            staged.drop(BUCKET).limit(0).write.mode("overwrite").parquet(f"{path}/{BUCKET}={b}")
    _mark(spark, f"{base}/published")
    return sorted(plan)


def merge(spark: SparkSession, staging: str, batch_id: str, table: Bucketed, changes: DataFrame, key: str,
          apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """:func:`publish` for one table: ``apply(rows, changes)`` gives the new
    content of the touched buckets from their rows; ``key`` is the changes'
    column that names the table's key."""
    def one() -> dict[str, Change]:
        hit = table.touched(changes, key)
        return {"table": Change(table, apply(table.read(spark, hit), changes), hit)}

    return publish(spark, staging, batch_id, one)
