"""Sales, customer, payment and stock reports (B-*, G-1..G-14, J-*, S-*).

Conventions: ``as_of`` (ISO date) replaces CURRENT_DATE; every top-k has an
explicit tie-breaker; sums of money are ``decimal(18,2)``, counts ``bigint``.
Aggregations run as partial (map-side) + final aggregates, so a hot group
costs one partial row per task.  Fact tables are aggregated *before* they are
joined to dimensions wherever the result allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R

SUM = R.WIDE_MONEY


def _sum0(c: Column, name: str) -> Column:
    """COALESCE(SUM(c), 0) as decimal(18,2)."""
    return F.coalesce(F.sum(c), F.lit(0)).cast(SUM).alias(name)


def since(df: DataFrame, col: str, as_of: str, kind: str) -> DataFrame:
    """B-11: rows dated on/after the period start; 'today' is equality."""
    start = R.period_start(as_of, kind)
    if kind == "today":
        return df.filter(F.col(col) == start)
    return df.filter(F.col(col) >= start)


# ---- G-1 .. G-13: the dashboard queries --------------------------------------

def total_customers(customer: DataFrame) -> DataFrame:
    return customer.agg(F.count(F.lit(1)).alias("total_customers"))


def total_sales_today(invoice: DataFrame, as_of: str) -> DataFrame:
    return since(invoice, "date", as_of, "today").agg(_sum0(F.col("final_amount"), "total_sales_today"))


def total_sales_month(invoice: DataFrame, as_of: str) -> DataFrame:
    return since(invoice, "date", as_of, "month").agg(_sum0(F.col("final_amount"), "total_sales_month"))


def total_sales_week(invoice: DataFrame, as_of: str) -> DataFrame:
    return since(invoice, "date", as_of, "week").agg(_sum0(F.col("final_amount"), "total_sales_week"))


def total_orders(invoice: DataFrame) -> DataFrame:
    return invoice.agg(F.count(F.lit(1)).alias("total_orders"))


def _avg_money(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c), 2), F.lit(0)).cast(SUM)


def average_order_value(invoice: DataFrame) -> DataFrame:
    return invoice.agg(_avg_money(F.col("final_amount")).alias("average_order_value"))


def _distinct(c: Column, exact: bool) -> Column:
    """COUNT(DISTINCT c); ``exact=False`` uses HyperLogLog++ (about 2 %
    error, no exchange of the distinct ids)."""
    return F.count_distinct(c) if exact else F.approx_count_distinct(c, 0.02)


def active_customers(invoice: DataFrame, as_of: str, exact: bool = True) -> DataFrame:
    """Distinct non-NULL customer ids with an invoice in the last 30 days."""
    return (since(invoice, "date", as_of, "30d")
            .agg(_distinct(F.col("customer_id"), exact).alias("active_customers")))


def best_selling_products(lines: DataFrame, product: DataFrame, k: int = 5) -> DataFrame:
    """G-8: top-k product *names* by quantity sold (equal names merge).

    Lines are summed per product id first (map-side partial aggregate), so
    the join sees one row per product instead of one per line.
    """
    per_id = lines.groupBy("product_id").agg(F.sum("quantity").alias("_q"))
    names = product.select(F.col("pro_id").alias("product_id"), "pro_name")
    return (per_id.join(names, "product_id", "inner")
            .groupBy("pro_name").agg(F.sum("_q").cast("long").alias("total_sold"))
            .orderBy(F.col("total_sold").desc(), F.col("pro_name").asc())
            .limit(k))


def top_customers(invoice: DataFrame, customer: DataFrame, k: int = 5) -> DataFrame:
    """G-9: top-k customer *names* by spend; invoices without a customer drop out."""
    per_id = (invoice.filter(F.col("customer_id").isNotNull())
              .groupBy("customer_id").agg(F.sum("final_amount").alias("_s")))
    names = customer.select(F.col("id").alias("customer_id"), "name")
    return (per_id.join(names, "customer_id", "inner")
            .groupBy("name").agg(F.sum("_s").cast(SUM).alias("total_spent"))
            .orderBy(F.col("total_spent").desc(), F.col("name").asc())
            .limit(k))


def low_stock(inventory: DataFrame, threshold: int = 10) -> DataFrame:
    """B-7 (and B-8 with 5): NULL quantity drops out, as in SQL."""
    return inventory.filter(F.col("quantity") <= threshold).select("product_name", "quantity")


def reorder_stock(inventory: DataFrame, threshold: int = 5) -> DataFrame:
    return low_stock(inventory, threshold)


def total_revenue(payment: DataFrame, as_of: str) -> DataFrame:
    """G-10: payments month-to-date by invoice date."""
    return since(payment, "invoice_date", as_of, "month").agg(_sum0(F.col("amount"), "total_revenue"))


def pending_payments(invoice: DataFrame, payment: DataFrame) -> DataFrame:
    """G-11: payment rows 'Unpaid' that have an invoice (the WHERE on the
    right side turns the LEFT JOIN into an inner join)."""
    unpaid = payment.filter(F.col("status") == "Unpaid").select("invoice_no")
    return (invoice.select("invoice_no").join(unpaid, "invoice_no", "inner")
            .agg(F.count(F.lit(1)).alias("pending_payments")))


def unpaid_invoices(invoice: DataFrame) -> DataFrame:
    """G-11b: what the tile means: invoices whose payment_status is 'Unpaid'."""
    u = invoice.filter(F.col("payment_status") == "Unpaid")
    return u.agg(F.count(F.lit(1)).alias("unpaid_invoices"),
                 _sum0(F.col("final_amount"), "unpaid_amount"))


def payment_mode_distribution(payment: DataFrame) -> DataFrame:
    """G-12: count and sum per payment mode (NULL mode is its own group)."""
    return payment.groupBy("payment_mode").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("amount").cast(SUM).alias("amount"))


def daily_sales_trend(invoice: DataFrame, as_of: str) -> DataFrame:
    """G-13: sales per day since as_of - 7 (no upper bound), ascending."""
    return (since(invoice, "date", as_of, "week").groupBy("date")
            .agg(F.sum("final_amount").cast(SUM).alias("sales"))
            .orderBy("date"))


def dashboard_kpis(invoice: DataFrame, as_of: str, exact: bool = True) -> DataFrame:
    """G-14: G-2..G-7 (and G-11b) in one scan of the invoices.

    Conditional aggregates replace six separate filtered scans; the distinct
    count of active customers (exact by default, HyperLogLog++ with
    ``exact=False``) rides on the same pass.
    """
    d, amt = F.col("date"), F.col("final_amount")
    today = R.period_start(as_of, "today")
    return invoice.agg(
        _sum0(F.when(d == today, amt), "total_sales_today"),
        _sum0(F.when(d >= R.period_start(as_of, "month"), amt), "total_sales_month"),
        _sum0(F.when(d >= R.period_start(as_of, "week"), amt), "total_sales_week"),
        F.count(F.lit(1)).alias("total_orders"),
        _avg_money(amt).alias("average_order_value"),
        _distinct(F.when(d >= R.period_start(as_of, "30d"), F.col("customer_id")), exact)
        .alias("active_customers"),
        F.count(F.when(F.col("payment_status") == "Unpaid", F.lit(1))).alias("unpaid_invoices"),
    )


# ---- B: listings, look-ups, filters ----------------------------------------

INVOICE_LIST_COLUMNS = ["invoice_no", "customer_name", "customer_mobile", "date", "terms",
                        "sale_by", "total_amount", "discount", "final_amount", "status",
                        "payment_status"]


def list_invoices(invoice: DataFrame) -> DataFrame:
    """B-2: the invoice page's 11 columns (pruned at the scan)."""
    return invoice.select(*INVOICE_LIST_COLUMNS)


def lookup(df: DataFrame, keys, col: str) -> DataFrame:
    """B-3/B-4: rows whose ``col`` is one of ``keys``.

    A Python list becomes an IN filter (pushed into the Parquet scan); a
    DataFrame of keys becomes a semi join (broadcast by AQE when small).
    """
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(col))
        return df.join(k, col, "left_semi")
    return df.filter(F.col(col).isin(list(keys)))


def suggest_products(inventory: DataFrame, needle: str, n: int = 10) -> DataFrame:
    """B-5: ILIKE '%needle%' (wildcards in the needle stay live) with
    availability >= 2, first ``n`` by product_id."""
    return (inventory.filter(F.col("product_name").ilike(f"%{needle}%")
                             & (F.col("availability") >= 2))
            .select("product_id", "product_name", "price")
            .orderBy("product_id").limit(n))


def sellable(inventory: DataFrame, min_level: int = 3) -> DataFrame:
    """B-6: products offered on the invoice form (>= 3) or in look-ups (>= 2)."""
    return inventory.filter(F.col("availability") >= min_level)


def below_safety(old: DataFrame, new: DataFrame) -> DataFrame:
    """B-9: products whose quantity fell (new < old) and is now below safety."""
    o = old.select("product_id", F.col("quantity").alias("old_quantity"))
    return (new.join(o, "product_id", "inner")
            .filter((F.col("quantity") < F.col("old_quantity"))
                    & (F.col("quantity") < F.col("safety_level")))
            .select("product_id", "product_name", "old_quantity",
                    F.col("quantity").alias("new_quantity"), "safety_level"))


def list_inventory(inventory: DataFrame) -> DataFrame:
    """B-10: inventory page with COALESCE defaults (H-14)."""
    cols = ["product_id", "product_name", "quantity", "unit", "category", "hscode",
            "expiry_date", "availability"]
    return R.with_defaults(inventory.select(*cols), R.INVENTORY_DEFAULTS)


def search_products(product: DataFrame, text: str) -> DataFrame:
    """B-15: product name contains the text, case-insensitive."""
    return product.filter(F.lower(F.col("pro_name")).contains(text.lower()))


def search_inventory(inventory: DataFrame, text: str, scheme: str = "page") -> DataFrame:
    """B-16 (as intended): trimmed, lowered text in the name or the
    availability label."""
    t = text.strip().lower()
    label = F.lower(R.availability_label(F.col("availability"), scheme))
    return inventory.filter(F.lower(F.col("product_name")).contains(t) | label.contains(t))


def page(df: DataFrame, n: int, order: list, size: int = 5) -> DataFrame:
    """B-17: page ``n`` (1-based) of ``size`` rows in ``order``.

    ORDER BY + OFFSET + LIMIT plans as a bounded top-(offset+size).  Far
    pages are better reached with ``page_after``.
    """
    return df.orderBy(*order).offset((n - 1) * size).limit(size)


def page_after(df: DataFrame, key: str, last=None, size: int = 5) -> DataFrame:
    """B-17 by key: the ``size`` rows after ``last`` in ``key`` order (the
    first page without it).  ``key`` is unique, so any page costs the same:
    a pushed filter and a top-``size``."""
    rows = df if last is None else df.filter(F.col(key) > last)
    return rows.orderBy(key).limit(size)


def list_suppliers(supplier: DataFrame) -> DataFrame:
    """S-1: supplier directory by name (id breaks ties)."""
    return supplier.orderBy(F.col("name").asc(), F.col("id").asc())


# ---- J: joins ---------------------------------------------------------------

def list_payments(payment: DataFrame, invoice: DataFrame) -> DataFrame:
    """J-4 + B-18: one row per payment with the invoice total and ISO date text."""
    inv = invoice.select("invoice_no", "total_amount")
    return (payment.join(inv, "invoice_no", "inner")
            .select("invoice_no", R.iso_date("invoice_date").alias("invoice_date"),
                    "total_amount", "amount", "payment_mode", "status"))


def restock_candidates(inventory: DataFrame, product: DataFrame) -> DataFrame:
    """J-7: inventory joined to product for restocking (cost, supplier, hscode)."""
    p = product.select(F.col("pro_id").alias("product_id"), "pro_name", "supplier_id", "cost_price")
    return (inventory.select("product_id", "unit", "category", "hscode")
            .join(p, "product_id", "inner")
            .select("product_id", "pro_name", "unit", "category", "hscode", "supplier_id",
                    "cost_price"))


def invoice_customers(invoice: DataFrame, customer: DataFrame) -> DataFrame:
    """J-2: invoices with their customer row (invoices without one drop out)."""
    c = customer.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name_master"),
                        F.col("mobile").alias("mobile_master"))
    return invoice.join(c, "customer_id", "inner")


def pricing_report(product: DataFrame, inventory: DataFrame) -> DataFrame:
    """H-22: the pricing page: margin, net profit, profit %, stock value at
    cost and at selling price, with quantity, unit and category."""
    q = inventory.select(F.col("product_id").alias("pro_id"), F.col("quantity").alias("_qty"))
    p = product.join(q, "pro_id", "left")
    qty = F.coalesce(F.col("_qty"), F.lit(0))
    return p.select("pro_id", "pro_name", "cost_price", "selling_price",
                    *R.pricing_columns(F.col("selling_price"), F.col("cost_price"), qty),
                    R.net_profit("selling_price", "cost_price").alias("net_profit"),
                    qty.cast("int").alias("quantity"), "unit", "category")
