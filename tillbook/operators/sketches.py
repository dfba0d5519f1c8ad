"""Active customers from one mergeable sketch per day (G-7, G-14).

A distinct count over the last 30 days reads 30 days of invoices each time.
A day's customers fit a HyperLogLog sketch; sketches of days merge into the
sketch of a window.  A finished day adds one row, a window reads at most one
row per day.  The sketch estimates: with ``2**LG_K`` registers the relative
standard error is at most 1.04 / sqrt(2**LG_K), 0.9 % here; ``BOUND`` is three
of these.  The exact count stays in ``reports.active_customers``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R

LG_K = 14
BOUND = 3 * 1.04 / 2 ** (LG_K / 2)

SKETCHES = "date date, customers binary, orders long, sales decimal(18,2)"


def daily_sketches(invoice: DataFrame) -> DataFrame:
    """One row per day: the sketch of its customer ids (NULL ids count for
    none), orders and sales.  Undated invoices are in no window and drop out."""
    return (invoice.filter(F.col("date").isNotNull()).groupBy("date")
            .agg(F.hll_sketch_agg(F.col("customer_id").cast("long"), F.lit(LG_K)).alias("customers"),
                 F.count(F.lit(1)).alias("orders"),
                 F.coalesce(F.sum("final_amount"), F.lit(0)).cast(R.WIDE_MONEY).alias("sales")))


def with_day(stored: DataFrame, invoice: DataFrame) -> DataFrame:
    """``stored`` with the days of ``invoice``: a new day adds its row, a day
    that is there already (more invoices of it) is merged with its row."""
    return (stored.unionByName(daily_sketches(invoice)).groupBy("date")
            .agg(F.hll_union_agg("customers").alias("customers"), F.sum("orders").alias("orders"),
                 F.sum("sales").cast(R.WIDE_MONEY).alias("sales")))


def active_customers(sketches: DataFrame, where: Column | None = None) -> DataFrame:
    """Estimated distinct customers of the days ``where`` (all without it), 0
    over no day; with orders and sales of the same days, which are exact."""
    rows = sketches if where is None else sketches.filter(where)
    return rows.agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).cast("long").alias("active_customers"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"),
        F.coalesce(F.sum("sales"), F.lit(0)).cast(R.WIDE_MONEY).alias("sales"))


def active_since(sketches: DataFrame, as_of: str, kind: str = "30d") -> DataFrame:
    """G-7 from the sketches, over a period of B-11."""
    start = R.period_start(as_of, kind)
    return active_customers(sketches, F.col("date") == start if kind == "today" else F.col("date") >= start)


def active_per_month(sketches: DataFrame) -> DataFrame:
    """Estimated distinct customers of every calendar month, all in one pass
    over the days' rows."""
    return (sketches.groupBy(F.trunc("date", "month").alias("month"))
            .agg(F.hll_sketch_estimate(F.hll_union_agg("customers")).cast("long").alias("active_customers")))
