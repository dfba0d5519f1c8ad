"""Catalog: stored layouts (J-4, J-6, G-17, Q-8 by invoice; B-11, G-2..G-4,
G-10, G-13 by month), the trigram index (B-5, B-14, B-15, B-16) and the daily
sketches (G-7, G-14).  Tables go to fresh folders under the shared
``spark.checkpoint.dir``."""

import uuid

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.oracle_views import AS_OF as D
from tillbook.operators import posting as ps
from tillbook.operators import quality as q
from tillbook.operators import reports as rp
from tillbook.operators import sketches as sk
from tillbook.operators import substrings as sub
from tillbook.session import scratch_path
from tillbook.sources.fixtures import AS_OF
from tillbook.sources.layouts import ByInvoice, ByMonth


def _fresh(r, name):
    return scratch_path(r.spark, f"{name}-{uuid.uuid4().hex}")


# ---- by invoice ---------------------------------------------------------------

def _by_invoice(r, *tables):
    # invoices of seven lines count as heavy, so both parts hold rows
    store = ByInvoice(r.spark, f"by_invoice_{uuid.uuid4().hex}", _fresh(r, "by-invoice"), buckets=8, heavy_rows=6)
    store.create({t: getattr(r, t) for t in tables})
    return store


@register("by_invoice_payments", """
SELECT p.invoice_no, strftime(p.invoice_date, '%Y-%m-%d') AS invoice_date, i.total_amount,
       p.amount, p.payment_mode, p.status
FROM r_payment p JOIN r_invoice i ON p.invoice_no = i.invoice_no""")
def by_invoice_payments(r):
    return _by_invoice(r, "invoice", "payment").apply(rp.list_payments, "payment", "invoice")


@register("by_invoice_lines", """
SELECT i.invoice_no, i.customer_name, i.date, l.line_no, l.product_id, l.quantity, l.total
FROM r_invoice i JOIN r_lines l ON i.invoice_no = l.invoice_no""")
def by_invoice_lines(r):
    def side_by_side(invoice, lines):
        return invoice.join(lines.select("invoice_no", "line_no", "product_id", "quantity", "total"), "invoice_no") \
            .select("invoice_no", "customer_name", "date", "line_no", "product_id", "quantity", "total")
    return _by_invoice(r, "invoice", "lines").apply(side_by_side, "invoice", "lines")


@register("by_invoice_totals", """
SELECT i.invoice_no, CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) AS total_amount,
       CAST(CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) - i.discount AS DECIMAL(10,2)) AS final_amount
FROM r_invoice i LEFT JOIN (SELECT invoice_no, SUM(total) AS t FROM r_lines GROUP BY 1) s
  ON i.invoice_no = s.invoice_no""")
def by_invoice_totals(r):
    return _by_invoice(r, "invoice", "lines").apply(ps.recompute_invoice_total, "invoice", "lines").select(
        "invoice_no", "total_amount", "final_amount")


@register("by_invoice_reconciled", """
SELECT i.invoice_no, i.total_amount, CAST(COALESCE(s.t, 0) AS DECIMAL(18,2)) AS lines_total,
       CAST(i.total_amount - COALESCE(s.t, 0) AS DECIMAL(18,2)) AS difference
FROM r_invoice i LEFT JOIN (SELECT invoice_no, SUM(total) AS t FROM r_lines GROUP BY invoice_no) s
  ON i.invoice_no = s.invoice_no
WHERE abs(i.total_amount - COALESCE(s.t, 0)) > 0.01""")
def by_invoice_reconciled(r):
    return _by_invoice(r, "invoice", "lines").apply(q.reconcile_totals, "invoice", "lines")


# ---- by month ---------------------------------------------------------------------

def _by_month(r, table, day):
    df = getattr(r, table)
    store = ByMonth(r.spark, _fresh(r, f"{table}-by-month"), df.schema, day, ("invoice_no",))
    store.create(df)
    return store


@register("by_month_sales", f"""
SELECT 'today' AS period, CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS sales, COUNT(*) AS orders
FROM r_invoice WHERE date = {D}
UNION ALL SELECT 'week', CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)), COUNT(*)
FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY
UNION ALL SELECT 'month', CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)), COUNT(*)
FROM r_invoice WHERE date >= date_trunc('month', {D})""")
def by_month_sales(r):
    store = _by_month(r, "invoice", "date")
    out = [store.since(AS_OF, kind).agg(
        F.lit(kind).alias("period"), F.coalesce(F.sum("final_amount"), F.lit(0)).cast("decimal(18,2)").alias("sales"),
        F.count(F.lit(1)).alias("orders")) for kind in ("today", "week", "month")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("by_month_revenue", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS total_revenue
FROM r_payment WHERE invoice_date >= date_trunc('month', {D})""")
def by_month_revenue(r):
    return rp.total_revenue(_by_month(r, "payment", "invoice_date").since(AS_OF, "month"), AS_OF)


@register("by_month_trend", f"""
SELECT date, CAST(SUM(final_amount) AS DECIMAL(18,2)) AS sales
FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY GROUP BY date""")
def by_month_trend(r):
    return rp.daily_sales_trend(_by_month(r, "invoice", "date").since(AS_OF, "week"), AS_OF)


@register("by_month_restock_days", """
WITH days AS (SELECT DISTINCT CAST(added_date AS DATE) AS day FROM r_add_item WHERE quantity_added >= 49)
SELECT i.date, COUNT(*) AS orders, CAST(SUM(i.final_amount) AS DECIMAL(18,2)) AS sales
FROM r_invoice i JOIN days ON i.date = days.day GROUP BY i.date""")
def by_month_restock_days(r):
    """Sales on the days that saw a large restock: days known at run time."""
    days = (r.add_item.filter(F.col("quantity_added") >= 49)
            .select(F.col("added_date").cast("date").alias("day")).distinct())
    return (_by_month(r, "invoice", "date").on_days(days).groupBy("date")
            .agg(F.count(F.lit(1)).alias("orders"), F.sum("final_amount").cast("decimal(18,2)").alias("sales")))


@register("by_month_corrected", """
SELECT date, COUNT(*) AS orders, CAST(SUM(CASE WHEN date >= DATE '2001-06-01' AND date < DATE '2001-07-01'
                                               THEN total_amount ELSE final_amount END) AS DECIMAL(18,2)) AS sales
FROM r_invoice GROUP BY date""")
def by_month_corrected(r):
    """One month is replaced (its discounts taken back), the others stay."""
    store = _by_month(r, "invoice", "date")
    june = r.invoice.filter((F.col("date") >= F.lit("2001-06-01").cast("date"))
                            & (F.col("date") < F.lit("2001-07-01").cast("date")))
    store.replace_months(june.withColumn("final_amount", F.col("total_amount")))
    return store.read().groupBy("date").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("final_amount").cast("decimal(18,2)").alias("sales"))


# ---- trigram index ------------------------------------------------------------------

def _index(r, df, key, fields):
    index = sub.TrigramIndex(r.spark, _fresh(r, "trigrams"), buckets=16)
    index.add(df, key, fields)
    return index


NEEDLES = ("Plate", "ed w", "old bolt", "zzz", "in", "small gizmo", "%l b")


@register("indexed_products", " UNION ALL ".join(
    f"SELECT '{n}' AS needle, pro_id, pro_name FROM r_product WHERE contains(lower(pro_name), lower('{n}'))" for n in NEEDLES))
def indexed_products(r):
    index = _index(r, r.product, "pro_id", ["pro_name"])
    found = [sub.search_products(r.product, index, n).select(F.lit(n).alias("needle"), "pro_id", "pro_name") for n in NEEDLES]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@register("indexed_suggestions", " UNION ALL ".join(
    f"(SELECT '{n}' AS needle, product_id, product_name, price FROM r_inventory "
    f"WHERE product_name ILIKE '%{n}%' AND availability >= 2 ORDER BY product_id LIMIT 10)" for n in ("RED", "d_b", "bolt")))
def indexed_suggestions(r):
    index = _index(r, r.inventory, "product_id", ["product_name"])
    found = [sub.suggest_products(r.inventory, index, n).select(F.lit(n).alias("needle"), "product_id", "product_name", "price")
             for n in ("RED", "d_b", "bolt")]
    return found[0].unionByName(found[1]).unionByName(found[2])


_LABEL_SQL = """CASE WHEN availability IS NULL THEN 'unknown' WHEN availability >= 3 THEN 'in stock'
                     WHEN availability >= 1 THEN 'low stock' ELSE 'out of stock' END"""


@register("indexed_inventory", " UNION ALL ".join(
    f"SELECT '{n}' AS needle, product_id, product_name FROM r_inventory "
    f"WHERE contains(lower(product_name), '{n}') OR contains({_LABEL_SQL}, '{n}')" for n in ("ring", "low")))
def indexed_inventory(r):
    index = _index(r, r.inventory, "product_id", ["product_name"])
    found = [sub.search_inventory(r.inventory, index, f" {n.upper()} ").select(F.lit(n).alias("needle"), "product_id", "product_name")
             for n in ("ring", "low")]
    return found[0].unionByName(found[1])


@register("indexed_ledger", """
SELECT c.name AS customer_name, l.customer_mobile, l.transaction_date, l.invoice_no, l.amount, l.transaction_type
FROM r_ledger_e l LEFT JOIN r_customer c ON l.customer_mobile = c.mobile
WHERE (contains(l.customer_mobile, '012') OR contains(lower(c.name), '012')) AND l.transaction_type = 'Debit'""")
def indexed_ledger(r):
    names = r.customer.select(F.col("mobile").alias("customer_mobile"), F.col("name").alias("customer_name"))
    index = _index(r, names, "customer_mobile", ["customer_mobile", "customer_name"])
    rows = r.ledger_entries.drop("customer_name").join(names, "customer_mobile", "left")
    return sub.filter_ledger(rows, index, text="012", ttype="Debit").select(
        "customer_name", "customer_mobile", "transaction_date", "invoice_no", "amount", "transaction_type")


# ---- daily sketches -----------------------------------------------------------------

def _sketches(r):
    path = _fresh(r, "daily-sketches")
    sk.daily_sketches(r.invoice).write.parquet(path)
    return r.spark.read.parquet(path)


def _near(estimate, exact):
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * sk.BOUND)


@register("sketched_active_customers", f"""
SELECT period, active_customers, TRUE AS within_bound, orders, sales FROM (
  SELECT 'today' AS period, COUNT(DISTINCT customer_id) AS active_customers, COUNT(*) AS orders,
         CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS sales FROM r_invoice WHERE date = {D}
  UNION ALL SELECT 'week', COUNT(DISTINCT customer_id), COUNT(*), CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2))
  FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY
  UNION ALL SELECT '30d', COUNT(DISTINCT customer_id), COUNT(*), CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2))
  FROM r_invoice WHERE date >= {D} - INTERVAL 30 DAY)""")
def sketched_active_customers(r):
    """The exact count, and whether the sketches' estimate lies within the bound."""
    sketches = _sketches(r)
    out = []
    for kind in ("today", "week", "30d"):
        exact = rp.since(r.invoice, "date", AS_OF, kind).agg(F.count_distinct("customer_id").alias("exact"))
        both = sk.active_since(sketches, AS_OF, kind).unionByName(exact, allowMissingColumns=True)
        row = both.agg(*[F.max(c).alias(c) for c in both.columns])
        out.append(row.select(F.lit(kind).alias("period"), F.col("exact").alias("active_customers"),
                              _near("active_customers", "exact").alias("within_bound"), "orders", "sales"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("sketched_active_by_month", """
SELECT CAST(date_trunc('month', date) AS DATE) AS month, COUNT(DISTINCT customer_id) AS active_customers,
       TRUE AS within_bound FROM r_invoice GROUP BY 1""")
def sketched_active_by_month(r):
    exact = r.invoice.groupBy(F.trunc("date", "month").alias("month")).agg(F.count_distinct("customer_id").alias("exact"))
    return sk.active_per_month(_sketches(r)).join(exact, "month").select(
        "month", F.col("exact").alias("active_customers"), _near("active_customers", "exact").alias("within_bound"))
