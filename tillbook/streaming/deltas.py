"""Rows that micro-batches add to a table, folded into a base now and then.

Each micro-batch writes its rows to its own partition, so a replay replaces
just that.  Left alone, a reader lists one folder per batch ever run.
``compact`` folds all batches before a given one into a *base*: a partition
named after the first batch it does not hold.  A reader takes the newest base
and the batches from its name on, so the moment a base is complete the batches
in it no longer count, whether or not they have been removed yet; a compaction
that is cut short, or run again, changes no result.

The rows are also partitioned by ``parts`` (a hash bucket of the key, say), so
a reader that wants some buckets lists and reads those only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillbook.operators.windows import materialize
from tillbook.session import delete_folder


def write_partitions(df: DataFrame, path: str, parts: list[str]) -> None:
    """Replace the partitions of ``path`` that ``df`` has rows for.  A
    partition's rows are brought together first (a large one's to several
    tasks), so its files follow its rows, not the tasks that made them."""
    (df.hint("rebalance", *[F.col(p) for p in parts]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path))


class Deltas:
    def __init__(self, spark: SparkSession, root: str, fold: Callable[[DataFrame], DataFrame],
                 parts: tuple[str, ...] = (), every: int = 16):
        """``fold`` turns rows of many batches (with ``batch_id``) into fewer
        rows of the same columns that mean the same; it must give equal
        results whether it sees rows or their folds.  ``every``: batches
        between compactions in :meth:`add`."""
        self.spark, self.fold, self.parts, self.every = spark, fold, list(parts), every
        self.batches, self.bases = f"{root.rstrip('/')}/batches", f"{root.rstrip('/')}/bases"

    def add(self, df: DataFrame, batch_id: int) -> None:
        """Write the rows of a micro-batch; what lies ``every`` batches back
        can no longer be replayed and is folded."""
        write_partitions(df.withColumn("batch_id", F.lit(batch_id)), self.batches, ["batch_id", *self.parts])
        if batch_id and batch_id % self.every == 0:
            self.compact(batch_id - 1)

    def _read(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException:
            return None

    def _newest(self) -> int:
        """The first batch that the newest base does not hold."""
        bases = self._read(self.bases)
        return 0 if bases is None else (bases.agg(F.max("upto")).first()[0] or 0)

    def read(self, before: int | None = None, where: Column | None = None) -> DataFrame | None:
        """Base and later batches (those under ``before``), with ``batch_id``
        (for the base: of its last batch); None before the first batch."""
        upto = self._newest()
        found = []
        if upto:
            base = self.spark.read.parquet(self.bases).filter(F.col("upto") == upto)
            found.append(base.withColumn("batch_id", F.lit(upto - 1)).drop("upto"))
        rows = self._read(self.batches)
        if rows is not None:
            rows = rows.filter(F.col("batch_id") >= upto)
            found.append(rows if before is None else rows.filter(F.col("batch_id") < before))
        if not found:
            return None
        found = [f if where is None else f.filter(where) for f in found]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def compact(self, below: int) -> None:
        """Fold the batches under ``below`` (all of them finished for good)."""
        upto = self._newest()
        rows = self._read(self.batches)
        if rows is None:
            return
        old = [r[0] for r in rows.select("batch_id").distinct().collect() if r[0] < below]    # one number per batch
        if below > upto and old:
            folded = materialize(self.fold(self.read(before=below)).drop("batch_id"))
            write_partitions(folded.withColumn("upto", F.lit(below)), self.bases, ["upto", *self.parts])
            upto = below
        for b in old:
            if b < upto:
                delete_folder(self.spark, f"{self.batches}/batch_id={b}")
        for r in self.spark.read.parquet(self.bases).select("upto").distinct().collect() if upto else []:
            if r[0] < upto:
                delete_folder(self.spark, f"{self.bases}/upto={r[0]}")
