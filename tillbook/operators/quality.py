"""Data-quality rules (Q-1..Q-8) and invoice validation (P-1).

Every check returns the violating rows with a ``reason`` column (one row
per violated rule), so ``ok = input - violations`` and
``rows(ok) + rows(distinct violating keys) = rows(input)``.  Checks are
column predicates or anti/semi joins; none collects anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.windows import materialize

PAID_METHODS = R.PAID_METHODS


def _explode_reasons(df: DataFrame, reasons: list[Column]) -> DataFrame:
    arr = F.array_compact(F.array(*reasons))
    return (df.withColumn("_reasons", arr).filter(F.size("_reasons") > 0)
            .withColumn("reason", F.explode("_reasons")).drop("_reasons"))


# Q-1
def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return _explode_reasons(df, [F.when(F.col(c).isNull(), F.lit(f"{c} is NULL")) for c in cols])


# Q-2
def check_positive(df: DataFrame, cols: list[str], allow_zero: bool = False) -> DataFrame:
    """CHECK (col > 0) (or >= 0); NULL passes a CHECK, as in SQL."""
    op = ">=" if allow_zero else ">"
    preds = [F.when((F.col(c) < 0) if allow_zero else (F.col(c) <= 0), F.lit(f"{c} must be {op} 0"))
             for c in cols]
    return _explode_reasons(df, preds)


# Q-3
def check_fk(child: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL ``col`` has no parent ``key`` (anti join)."""
    p = parent.select(F.col(key).alias("_fk"))
    return (child.filter(F.col(col).isNotNull())
            .join(p, F.col(col) == F.col("_fk"), "left_anti")
            .withColumn("reason", F.lit(f"{col} has no parent")))


# Q-4
def check_domain(df: DataFrame, col: str, values=None, lo=None, hi=None) -> DataFrame:
    """Value outside a list (or a closed range); NULL passes."""
    if values is not None:
        bad = ~F.col(col).isin(*values)
        why = f"{col} not in allowed values"
    else:
        bad = ~F.col(col).between(lo, hi)
        why = f"{col} not between {lo} and {hi}"
    return df.filter(bad).withColumn("reason", F.lit(why))


# Q-5
def check_unique(df: DataFrame, col: str) -> DataFrame:
    """Rows whose non-NULL ``col`` value occurs more than once.

    The count is a partial aggregate; the duplicated keys (a small set
    when the rule mostly holds) are semi-joined back to the rows.
    """
    dup = (df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
           .filter(F.col("_n") > 1).select(col))
    return df.join(dup, col, "left_semi").withColumn("reason", F.lit(f"{col} is not unique"))


# Q-6
def check_length(df: DataFrame, limits: dict[str, int], money: list[str] | None = None) -> DataFrame:
    """VARCHAR(n) overflows and NUMERIC(10,2) range (|x| >= 1e8)."""
    preds = [F.when(F.length(F.col(c)) > n, F.lit(f"{c} longer than {n}")) for c, n in limits.items()]
    preds += [F.when(F.abs(F.col(c)) >= 100000000, F.lit(f"{c} out of NUMERIC(10,2) range"))
              for c in (money or [])]
    return _explode_reasons(df, preds)


# Q-7
def check_required(df: DataFrame, cols: list[str], digits: list[str] | None = None) -> DataFrame:
    """Required form fields (NULL or blank) and digits-only fields."""
    preds = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""),
                    F.lit(f"{c} is required")) for c in cols]
    preds += [F.when(F.col(c).isNotNull() & ~R.is_digits(F.col(c)), F.lit(f"{c} must be digits"))
              for c in (digits or [])]
    return _explode_reasons(df, preds)


# Q-8
def reconcile_totals(invoice: DataFrame, lines: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Invoices whose total_amount differs from the sum of line totals by
    more than ``tolerance`` (invoices without lines count 0)."""
    sums = lines.groupBy("invoice_no").agg(F.sum("total").alias("_lines"))
    lt = F.coalesce(F.col("_lines"), F.lit(0)).cast(R.WIDE_MONEY)
    return (invoice.select("invoice_no", "total_amount").join(sums, "invoice_no", "left")
            .select("invoice_no", "total_amount", lt.alias("lines_total"),
                    (F.col("total_amount") - lt).cast(R.WIDE_MONEY).alias("difference"))
            .filter(F.abs(F.col("difference")) > tolerance))


# P-1
def validate_invoices(headers: DataFrame, lines: DataFrame | None = None, once: bool = False):
    """Invoice form checks, batch form.  Returns ``(ok, rejects)``.

    Rejected (first failing rule is the reason): a required field blank
    (date, terms, sale_by, customer_mobile, customer_name) or no line;
    |total x pct / 100 - discount| > 0.01; |total - discount - final| >
    0.01; a paid method with final > 0 but paid <= 0.  Method 'unpaid'
    forces paid to 0 on accepted rows.  ``once`` writes the checked rows, so
    that whatever reads the two frames does not check them again.
    """
    h = headers
    if lines is not None:
        has = lines.groupBy("invoice_no").agg(F.lit(True).alias("_has_lines"))
        h = h.join(has, "invoice_no", "left")
    else:
        h = h.withColumn("_has_lines", F.lit(True))
    blank = [F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
             for c in ("date", "terms", "sale_by", "customer_mobile", "customer_name")]
    missing = reduce(lambda a, b: a | b, blank) | F.col("_has_lines").isNull()
    calc_disc = F.col("total_amount") * F.col("discount_percent") / 100
    reason = (F.when(missing, "required field missing or no product")
              .when(F.abs(calc_disc - F.col("discount")) > 0.01, "discount does not match percentage")
              .when(F.abs(F.col("total_amount") - F.col("discount") - F.col("final_amount")) > 0.01,
                    "final amount does not match total minus discount")
              .when(F.col("payment_method").isin(*PAID_METHODS) & (F.col("final_amount") > 0)
                    & (F.col("total_paid") <= 0), "paid method needs total_paid > 0"))
    tagged = h.withColumn("reason", reason).drop("_has_lines")
    tagged = materialize(tagged) if once else tagged
    ok = (tagged.filter(F.col("reason").isNull()).drop("reason")
          .withColumn("total_paid", F.when(F.col("payment_method") == "unpaid", F.lit(0).cast(R.MONEY))
                      .otherwise(F.col("total_paid"))))
    return ok, tagged.filter(F.col("reason").isNotNull())
