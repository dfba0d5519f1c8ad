"""Business rules as column expressions (H-1 .. H-22).

Every function here maps Columns to a Column, so it runs inside whole-stage
codegen wherever it is used: no Python UDF is involved.  Money is
``decimal(10,2)`` on input; results are cast explicitly so that Spark, DuckDB
and PostgreSQL agree on the type as well as the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"
WIDE_MONEY = "decimal(18,2)"
PERCENT = "decimal(5,2)"

# Fixed values of the reference's rules (stated once, in natural order).
PAID_METHODS = ("cash", "credit_card", "bank_transfer", "upi")
TRANSACTION_TYPES = ("Debit", "Credit")
# availability scale: ratio quantity / safety level -> level
AVAILABILITY_STEPS = ((1.0, 5), (0.85, 4), (0.50, 3), (0.25, 2))
INVENTORY_DEFAULTS = {
    "quantity": 0,
    "unit": "pcs",
    "category": "General",
    "hscode": "Unknown",
    "expiry_date": "1900-01-01",
    "availability": 1,
}
# form option lists (product entry and invoice forms)
FORM_UNITS = ("Piece", "Kilogram", "Liter", "Dozen", "Box")
FORM_CATEGORIES = ("Electronics", "Clothing", "Home & Kitchen", "Sports", "Beauty")
FORM_SAFETY_LEVELS = (1, 5)
FORM_TERMS_DAYS = ("5", "10", "15", "20", "30")
FORM_PAYMENT_METHODS = ("cash", "credit_card", "bank_transfer", "upi", "unpaid")
DESCRIPTION_PREFIX = {
    "invoice": "Invoice Creation - ",
    "full": "Payment Received (Full) - ",
    "partial": "Payment Received (Partial) - ",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# H-1
def net_profit(sell, cost) -> Column:
    return (_c(sell) - _c(cost)).cast(MONEY)


# H-2
def profit_pct(sell, cost, cap: float | None = 999.99) -> Column:
    """(sell - cost) / cost * 100 rounded to 2 places, as NUMERIC(5,2).

    ``cap`` given: the form rule (0 when cost <= 0, capped at ``cap``).
    ``cap=None``: the column rule; values the column cannot hold
    (cost 0, |pct| >= 1000) become NULL so a quality check can reject the row.
    """
    sell, cost = _c(sell), _c(cost)
    raw = F.round(F.try_divide(sell - cost, cost) * 100, 2)
    if cap is None:
        return F.when(F.abs(raw) < 1000, raw.cast(PERCENT))
    capped = F.least(raw, F.lit(cap).cast("decimal(5,2)"))
    return F.when(cost > 0, capped).otherwise(F.lit(0)).cast(PERCENT)


# H-3
def final_amount(total, discount) -> Column:
    """NULL discount gives NULL, as the generated column does."""
    return (_c(total) - _c(discount)).cast(MONEY)


# H-4
def line_total(price, qty, discount) -> Column:
    """NULL discount gives NULL, as the generated column does."""
    return (_c(price) * _c(qty) - _c(discount)).cast(MONEY)


# H-5
def sale_total(price, qty) -> Column:
    return (_c(price) * _c(qty)).cast(MONEY)


# H-6
def availability(qty, safety) -> Column:
    """Availability level 1..5 from quantity against the safety level.

    Safety NULL counts as 1; safety 0 means ratio 1 (level 5); a NULL
    quantity falls through to level 1.
    """
    s = F.coalesce(_c(safety).cast("int"), F.lit(1))
    ratio = F.when(s == 0, F.lit(1.0)).otherwise(_c(qty).cast("double") / s.cast("double"))
    expr = None
    for bound, level in AVAILABILITY_STEPS:
        expr = (F.when(ratio >= bound, F.lit(level)) if expr is None
                else expr.when(ratio >= bound, F.lit(level)))
    return expr.otherwise(F.lit(1)).cast("int")


# H-7
def availability_label(level, scheme: str = "page") -> Column:
    """'page': >=3 In Stock, >=1 Low Stock, else Out of Stock, NULL Unknown.
    'trigger': 5-4 In Stock, 3-2 Low Stock, otherwise Out of Stock."""
    lv = _c(level)
    if scheme == "page":
        return (F.when(lv.isNull(), "Unknown").when(lv >= 3, "In Stock")
                .when(lv >= 1, "Low Stock").otherwise("Out of Stock"))
    if scheme == "trigger":
        return (F.when(lv >= 4, "In Stock").when(lv >= 2, "Low Stock")
                .otherwise("Out of Stock"))
    raise ValueError(f"unknown scheme {scheme!r}")


# H-8
def payment_status(method, paid) -> Column:
    """struct(payment_status, status, total_paid) as the live BEFORE trigger sets it."""
    m, p = _c(method), _c(paid)
    is_paid = (m != F.lit("unpaid")) & (p > 0) & m.isin(*PAID_METHODS)
    zero = F.lit(0).cast(MONEY)
    return F.struct(
        F.when(is_paid, "Paid").otherwise("Unpaid").alias("payment_status"),
        F.when(is_paid, "Completed").otherwise("Pending").alias("status"),
        F.when(is_paid, p.cast(MONEY)).otherwise(zero).alias("total_paid"),
    )


# H-9
def payment_status_simple(paid) -> Column:
    """Older rule: paid NULL/0 -> Unpaid/Pending, anything else Paid/Completed."""
    p = _c(paid)
    unpaid = p.isNull() | (p == 0)
    return F.struct(
        F.when(unpaid, "Unpaid").otherwise("Paid").alias("payment_status"),
        F.when(unpaid, "Pending").otherwise("Completed").alias("status"),
    )


# H-10
def header_discount(total, pct) -> Column:
    return F.round(_c(total) * _c(pct) / 100, 2).cast(MONEY)


# H-11
def pct_line_amount(qty, price, pct) -> Column:
    return (_c(qty) * _c(price) * (1 - _c(pct) / 100))


# H-12
def signed_amount(ttype, amount, sign: str = "receivable") -> Column:
    """receivable: Debit +, Credit -; account: Credit +, Debit -; else 0."""
    t, a = _c(ttype), _c(amount)
    plus, minus = ("Debit", "Credit") if sign == "receivable" else ("Credit", "Debit")
    if sign not in ("receivable", "account"):
        raise ValueError(f"unknown sign {sign!r}")
    return F.when(t == plus, a).when(t == minus, -a).otherwise(F.lit(0).cast(MONEY))


# H-13
def restock_cost(cost, qty) -> Column:
    return (_c(cost) * _c(qty)).cast(MONEY)


# H-14
def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """COALESCE each listed column with its default, keeping column order."""
    cols = []
    for name in df.columns:
        if name in defaults:
            dtype = df.schema[name].dataType
            cols.append(F.coalesce(F.col(name), F.lit(defaults[name]).cast(dtype)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)


# H-15
def safety_to_int(text) -> Column:
    return F.nullif(_c(text).cast("string"), F.lit("")).try_cast("int")


# H-16
def clean_text(c) -> Column:
    return F.trim(_c(c))


def lower_text(c) -> Column:
    return F.lower(F.trim(_c(c)))


def is_digits(c) -> Column:
    return F.coalesce(_c(c).rlike(r"\A[0-9]+\z"), F.lit(False))


# H-17
def ledger_description(kind: str, name, number) -> Column:
    """'<prefix><name> (Invoice #<no>)'; NULL name or number gives NULL, like ``||``."""
    return F.concat(F.lit(DESCRIPTION_PREFIX[kind]), _c(name), F.lit(" (Invoice #"),
                    _c(number).cast("string"), F.lit(")"))


# H-18
def period_start(as_of: str, kind: str) -> Column:
    """Inclusive lower bound of a report period (no upper bound)."""
    d = F.to_date(F.lit(as_of))
    if kind == "today":
        return d
    if kind == "month":
        return F.trunc(d, "month")
    if kind == "week":
        return F.date_sub(d, 7)
    if kind == "30d":
        return F.date_sub(d, 30)
    raise ValueError(f"unknown period {kind!r}")


# H-19
def doc_number(year, n) -> Column:
    """Year and serial; the serial has at least five digits and is never cut."""
    serial = _c(n).cast("string")
    return F.concat(_c(year).cast("string"),
                    F.when(F.length(serial) < 5, F.lpad(serial, 5, "0")).otherwise(serial))


def doc_serial(number) -> Column:
    """The number after the four-digit year; NULL if it is not one."""
    return F.substr(_c(number).cast("string"), F.lit(5)).try_cast("long")


# H-20
def iso_date(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd")


def money_text(c) -> Column:
    """Two-decimal text ('1234.50'), rounded half up, no grouping."""
    return F.round(_c(c).cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string")


# H-22
def pricing_columns(sell, cost, qty) -> list[Column]:
    s, c, q = _c(sell), _c(cost), _c(qty)
    return [
        net_profit(s, c).alias("margin"),
        profit_pct(s, c).alias("profit_percentage"),
        (c * q).cast(WIDE_MONEY).alias("stock_value"),
        (s * q).cast(WIDE_MONEY).alias("stock_selling_value"),
    ]
