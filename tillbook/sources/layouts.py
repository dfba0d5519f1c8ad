"""Stored layouts that spare a shuffle or a scan.

``ByInvoice`` keeps the tables that belong to an invoice bucketed and sorted
by ``invoice_no`` into the same number of buckets, so that joins and grouped
sums on it read their rows in place (J-4, J-6, G-17, Q-8).  A bucket is one
task, so an invoice with very many rows must not lie in one: the keys with
more than ``heavy_rows`` rows in any of the tables, and NULL, are kept beside
the buckets in plain tables, for *all* of the tables.  A result that is made
invoice by invoice is then the union of the two parts.

``ByMonth`` keeps a dated table in one folder per month, so that a report
from a date on lists the folders of the months since only (B-11, G-2..G-4,
G-10, G-13).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import rules as R

HEAVY_ROWS = 1 << 20
BUCKET_ROWS = 1 << 18       # rows of the largest table that a bucket holds, about
MONTH = "_month"


class ByInvoice:
    """``name`` names the catalog tables (``<name>_<table>``) and ``path`` the
    folder of their files, both shared by all sessions that read them."""

    def __init__(self, spark: SparkSession, name: str, path: str, key: str = "invoice_no",
                 buckets: int = 64, heavy_rows: int = HEAVY_ROWS, bucket_rows: int = BUCKET_ROWS):
        """``buckets``: at least so many; ``create`` takes more where the
        largest table has more than ``bucket_rows`` rows for each."""
        self.spark, self.name, self.path = spark, name, path.rstrip("/")
        self.key, self.buckets, self.heavy_rows, self.bucket_rows = key, buckets, heavy_rows, bucket_rows

    def create(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables.  The heavy keys, at most rows / ``heavy_rows`` of
        them, are written once and split every table alike."""
        many = [df.groupBy(F.col(self.key).cast("long").alias("_heavy")).agg(F.count(F.lit(1)).alias("_n"))
                .filter((F.col("_n") > self.heavy_rows) & F.col("_heavy").isNotNull()).select("_heavy")
                for df in tables.values()]
        # no coalesce here: it would draw the counting of all keys into its few tasks
        reduce(DataFrame.unionByName, many).distinct().write.parquet(f"{self.path}/heavy_keys")
        rows = max([df.count() for df in tables.values()], default=0)
        self.buckets = max(self.buckets, -(-rows // self.bucket_rows))
        heavy = self.spark.read.schema("_heavy long").parquet(f"{self.path}/heavy_keys")
        for table, df in tables.items():
            key = F.col(self.key)
            marked = df.withColumn(self.key, key.cast("long")).join(heavy, F.col(self.key) == F.col("_heavy"), "left")
            apart = F.col("_heavy").isNotNull() | key.isNull()
            # the exchange and the buckets use one hash: a task writes whole buckets, one file each
            (marked.filter(~apart).drop("_heavy").repartition(self.buckets, self.key)
             .write.bucketBy(self.buckets, self.key).sortBy(self.key)
             .option("path", f"{self.path}/{table}").saveAsTable(f"{self.name}_{table}"))
            marked.filter(apart).drop("_heavy").write.parquet(f"{self.path}/{table}_heavy")

    def common(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{table}")

    def heavy(self, table: str) -> DataFrame:
        return self.spark.read.schema(self.common(table).schema).parquet(f"{self.path}/{table}_heavy")

    def has_heavy(self) -> bool:
        """Is any row of any table kept apart for its key's size?"""
        return bool(self.spark.read.schema("_heavy long").parquet(f"{self.path}/heavy_keys").take(1))

    def apply(self, fn: Callable[..., DataFrame], *tables: str) -> DataFrame:
        """``fn(*tables)`` over both parts; right where every row of the result
        comes from rows of one invoice (or of none)."""
        parts = [fn(*[part(t) for t in tables]) for part in (self.common, self.heavy)]
        return parts[0].unionByName(parts[1])


def month_number(day) -> Column:
    """200107 for a day in July 2001, NULL for NULL."""
    day = F.col(day) if isinstance(day, str) else day
    return (F.year(day) * 100 + F.month(day)).cast("int")


class ByMonth:
    """A table partitioned by the month of its date column ``day``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, day: str, order: tuple[str, ...] = ()):
        """``order``: further columns that tell rows of a day apart, so that a
        day with very many rows is spread over tasks and files."""
        self.spark, self.path, self.schema, self.day, self.order = spark, path, schema, day, list(order)

    def _laid_out(self, df: DataFrame):
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # sorted by day: a task meets few months, so few files are written
        return (df.select(*self.schema.names).withColumn(MONTH, month_number(self.day))
                .repartitionByRange(n, self.day, *self.order).sortWithinPartitions(MONTH, self.day, *self.order)
                .write.partitionBy(MONTH))

    def create(self, df: DataFrame) -> None:
        self._laid_out(df).parquet(self.path)

    def replace_months(self, df: DataFrame) -> None:
        """Put ``df`` in place of the months it has rows of; the folders of
        other months are not touched, and running it again changes nothing."""
        self._laid_out(df).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def read(self) -> DataFrame:
        """The whole table, with the month."""
        schema = T.StructType(self.schema.fields + [T.StructField(MONTH, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def since(self, as_of: str, kind: str) -> DataFrame:
        """B-11 on the layout: the months before the period's start are pruned
        when the query is planned; what is left is filtered by day."""
        start = R.period_start(as_of, kind)
        rows = self.read()
        if kind == "today":
            return rows.filter((F.col(MONTH) == month_number(start)) & (F.col(self.day) == start)).drop(MONTH)
        return rows.filter((F.col(MONTH) >= month_number(start)) & (F.col(self.day) >= start)).drop(MONTH)

    def on_days(self, days: DataFrame, day: str = "day") -> DataFrame:
        """The rows of the given (distinct) days.  Spark's own dynamic pruning
        asks for a broadcast side, which many days may not be; so the days'
        months, twelve numbers a year, are read first and prune when planning."""
        d = days.select(F.col(day).alias(self.day))
        months = [m[0] for m in d.select(month_number(self.day)).distinct().collect() if m[0] is not None]
        rows = self.read().filter(F.col(MONTH).isin(months))
        return rows.join(d, self.day, "left_semi").select(*self.schema.names)
