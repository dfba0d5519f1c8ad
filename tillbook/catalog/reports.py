"""Catalog: dashboard and list reports (G-1..G-14, B-*, J-*, S-*, H-22)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.oracle_views import AS_OF as D
from tillbook.operators import ledger as lg
from tillbook.operators import reports as rp
from tillbook.sources.fixtures import AS_OF


def avg_money_sql(expr: str) -> str:
    """DuckDB text for Spark's ROUND(AVG(decimal(10,2)), 2) as decimal(18,2).

    Spark averages a decimal exactly to 6 places (HALF_UP), then ROUND
    rounds that to 2 (HALF_UP).  DuckDB's AVG returns DOUBLE, so the oracle
    redoes it in integer cents to stay exact.  Values here are positive.
    """
    micro = (f"((CAST(SUM({expr}) * 100 AS HUGEINT) * 20000 + COUNT({expr})) "
             f"// (2 * COUNT({expr})))")
    cents = f"(({micro} * 2 + 10000) // 20000)"
    return (f"CAST(COALESCE(CAST({cents} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)), 0) "
            f"AS DECIMAL(18,2))")


def pct_sql(sell: str, cost: str) -> str:
    """DuckDB text for ROUND((sell - cost) / cost * 100, 2) computed exactly.

    DuckDB divides decimals in DOUBLE; this works in integer cents and
    rounds half up, as Spark's decimal division does.  cost > 0, sell >= cost.
    """
    num = f"CAST(({sell} - {cost}) * 100 AS BIGINT)"
    den = f"CAST({cost} * 100 AS BIGINT)"
    q = f"(({num} * 20000 + {den}) // (2 * {den}))"
    return f"(CAST({q} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)))"


# ---- G-1 .. G-14 ----------------------------------------------------------

@register("total_customers", "SELECT CAST(COUNT(*) AS BIGINT) AS total_customers FROM r_customer")
def total_customers(r):
    return rp.total_customers(r.customer)


@register("total_sales_today", f"""
SELECT CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS total_sales_today
FROM r_invoice WHERE date = {D}""")
def total_sales_today(r):
    return rp.total_sales_today(r.invoice, AS_OF)


@register("total_sales_month", f"""
SELECT CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS total_sales_month
FROM r_invoice WHERE date >= date_trunc('month', {D})""")
def total_sales_month(r):
    return rp.total_sales_month(r.invoice, AS_OF)


@register("total_sales_week", f"""
SELECT CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS total_sales_week
FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY""")
def total_sales_week(r):
    return rp.total_sales_week(r.invoice, AS_OF)


@register("total_orders", "SELECT CAST(COUNT(*) AS BIGINT) AS total_orders FROM r_invoice")
def total_orders(r):
    return rp.total_orders(r.invoice)


@register("average_order_value", f"""
SELECT {avg_money_sql('final_amount')} AS average_order_value FROM r_invoice""")
def average_order_value(r):
    return rp.average_order_value(r.invoice)


@register("active_customers", f"""
SELECT CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS active_customers
FROM r_invoice WHERE date >= {D} - INTERVAL 30 DAY""")
def active_customers(r):
    return rp.active_customers(r.invoice, AS_OF)


@register("best_selling_products", """
SELECT p.pro_name, CAST(SUM(l.quantity) AS BIGINT) AS total_sold
FROM r_lines l JOIN r_product p ON l.product_id = p.pro_id
GROUP BY p.pro_name ORDER BY total_sold DESC, p.pro_name LIMIT 5""")
def best_selling_products(r):
    return rp.best_selling_products(r.lines, r.product, 5)


@register("top_customers", """
SELECT c.name, CAST(SUM(i.final_amount) AS DECIMAL(18,2)) AS total_spent
FROM r_invoice i JOIN r_customer c ON i.customer_id = c.id
GROUP BY c.name ORDER BY total_spent DESC, c.name LIMIT 5""")
def top_customers(r):
    return rp.top_customers(r.invoice, r.customer, 5)


@register("low_stock", "SELECT product_name, quantity FROM r_inventory WHERE quantity <= 10")
def low_stock(r):
    return rp.low_stock(r.inventory, 10)


@register("reorder_stock", "SELECT product_name, quantity FROM r_inventory WHERE quantity <= 5")
def reorder_stock(r):
    return rp.reorder_stock(r.inventory, 5)


@register("total_revenue", f"""
SELECT CAST(COALESCE(SUM(amount), 0) AS DECIMAL(18,2)) AS total_revenue
FROM r_payment WHERE invoice_date >= date_trunc('month', {D})""")
def total_revenue(r):
    return rp.total_revenue(r.payment, AS_OF)


@register("pending_payments", """
SELECT CAST(COUNT(*) AS BIGINT) AS pending_payments
FROM r_invoice i LEFT JOIN r_payment p ON i.invoice_no = p.invoice_no
WHERE p.status = 'Unpaid'""")
def pending_payments(r):
    return rp.pending_payments(r.invoice, r.payment)


@register("unpaid_invoices", """
SELECT CAST(COUNT(*) AS BIGINT) AS unpaid_invoices,
       CAST(COALESCE(SUM(final_amount), 0) AS DECIMAL(18,2)) AS unpaid_amount
FROM r_invoice WHERE payment_status = 'Unpaid'""")
def unpaid_invoices(r):
    return rp.unpaid_invoices(r.invoice)


@register("payment_mode_distribution", """
SELECT payment_mode, CAST(COUNT(*) AS BIGINT) AS payments,
       CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
FROM r_payment GROUP BY payment_mode""")
def payment_mode_distribution(r):
    return rp.payment_mode_distribution(r.payment)


@register("daily_sales_trend", f"""
SELECT date, CAST(SUM(final_amount) AS DECIMAL(18,2)) AS sales
FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY GROUP BY date ORDER BY date""")
def daily_sales_trend(r):
    return rp.daily_sales_trend(r.invoice, AS_OF)


@register("dashboard_kpis", f"""
SELECT CAST(COALESCE(SUM(CASE WHEN date = {D} THEN final_amount END), 0) AS DECIMAL(18,2)) AS total_sales_today,
       CAST(COALESCE(SUM(CASE WHEN date >= date_trunc('month', {D}) THEN final_amount END), 0) AS DECIMAL(18,2)) AS total_sales_month,
       CAST(COALESCE(SUM(CASE WHEN date >= {D} - INTERVAL 7 DAY THEN final_amount END), 0) AS DECIMAL(18,2)) AS total_sales_week,
       CAST(COUNT(*) AS BIGINT) AS total_orders,
       {avg_money_sql('final_amount')} AS average_order_value,
       CAST(COUNT(DISTINCT CASE WHEN date >= {D} - INTERVAL 30 DAY THEN customer_id END) AS BIGINT) AS active_customers,
       CAST(COUNT(CASE WHEN payment_status = 'Unpaid' THEN 1 END) AS BIGINT) AS unpaid_invoices
FROM r_invoice""")
def dashboard_kpis(r):
    return rp.dashboard_kpis(r.invoice, AS_OF)


# ---- B: listings, look-ups, filters ----------------------------------------

@register("list_customers", "SELECT id, name, mobile FROM r_customer")
def list_customers(r):
    return r.customer.select("*")


@register("list_products", "SELECT * FROM r_product")
def list_products(r):
    return r.product.select("*")


@register("list_invoices", """
SELECT invoice_no, customer_name, customer_mobile, date, terms, sale_by, total_amount,
       discount, final_amount, status, payment_status FROM r_invoice""")
def list_invoices(r):
    return rp.list_invoices(r.invoice)


@register("lookup_customers_by_mobile", f"""
SELECT * FROM r_customer
WHERE mobile IN (SELECT customer_mobile FROM r_invoice WHERE date >= {D} - INTERVAL 7 DAY)""")
def lookup_customers_by_mobile(r):
    keys = rp.since(r.invoice, "date", AS_OF, "week").select("customer_mobile")
    return rp.lookup(r.customer, keys, "mobile")


@register("lookup_products_by_name", f"""
SELECT * FROM r_product WHERE pro_name IN (
  SELECT p.pro_name FROM r_lines l JOIN r_invoice i ON l.invoice_no = i.invoice_no
  JOIN r_product p ON p.pro_id = l.product_id WHERE i.date = {D})""")
def lookup_products_by_name(r):
    day = rp.since(r.invoice, "date", AS_OF, "today").select("invoice_no")
    sold = (r.lines.join(day, "invoice_no", "left_semi")
            .join(r.product.select(F.col("pro_id").alias("product_id"), "pro_name"), "product_id")
            .select("pro_name"))
    return rp.lookup(r.product, sold, "pro_name")


@register("suggest_products", """
SELECT product_id, product_name, price FROM r_inventory
WHERE product_name ILIKE '%red%' AND availability >= 2 ORDER BY product_id LIMIT 10""")
def suggest_products(r):
    return rp.suggest_products(r.inventory, "red", 10)


@register("sellable_products", """
SELECT product_id, product_name, price, availability FROM r_inventory WHERE availability >= 3""")
def sellable_products(r):
    return rp.sellable(r.inventory, 3).select("product_id", "product_name", "price", "availability")


@register("list_inventory", """
SELECT product_id, product_name, COALESCE(quantity, 0) AS quantity, COALESCE(unit, 'pcs') AS unit,
       COALESCE(category, 'General') AS category, COALESCE(hscode, 'Unknown') AS hscode,
       COALESCE(expiry_date, DATE '1900-01-01') AS expiry_date,
       COALESCE(availability, 1) AS availability
FROM r_inventory""")
def list_inventory(r):
    return rp.list_inventory(r.inventory)


@register("search_products", """
SELECT * FROM r_product WHERE contains(lower(pro_name), 'plate')""")
def search_products(r):
    return rp.search_products(r.product, "Plate")


@register("search_inventory", """
SELECT * EXCLUDE (ratio) FROM r_inventory
WHERE contains(lower(product_name), 'low')
   OR contains(lower(CASE WHEN availability IS NULL THEN 'Unknown' WHEN availability >= 3 THEN 'In Stock'
                          WHEN availability >= 1 THEN 'Low Stock' ELSE 'Out of Stock' END), 'low')""")
def search_inventory(r):
    return rp.search_inventory(r.inventory, "  LOW ")


@register("inventory_page", """
SELECT product_id, product_name, quantity FROM r_inventory ORDER BY product_id LIMIT 5 OFFSET 10""")
def inventory_page(r):
    return rp.page(r.inventory.select("product_id", "product_name", "quantity"), 3, ["product_id"], 5)


@register("inventory_page_after", """
SELECT product_id, product_name, quantity FROM r_inventory WHERE product_id > 10 ORDER BY product_id LIMIT 5""")
def inventory_page_after(r):
    return rp.page_after(r.inventory.select("product_id", "product_name", "quantity"), "product_id", 10, 5)


@register("list_suppliers", "SELECT id, name FROM r_supplier ORDER BY name, id")
def list_suppliers(r):
    return rp.list_suppliers(r.supplier)


# ---- J: joins -----------------------------------------------------------------

@register("list_payments", """
SELECT p.invoice_no, strftime(p.invoice_date, '%Y-%m-%d') AS invoice_date, i.total_amount,
       p.amount, p.payment_mode, p.status
FROM r_payment p JOIN r_invoice i ON p.invoice_no = i.invoice_no""")
def list_payments(r):
    return rp.list_payments(r.payment, r.invoice)


@register("restock_candidates", """
SELECT i.product_id, a.pro_name, i.unit, i.category, i.hscode, a.supplier_id, a.cost_price
FROM r_inventory i JOIN r_product a ON i.product_id = a.pro_id""")
def restock_candidates(r):
    return rp.restock_candidates(r.inventory, r.product)


@register("invoice_customers", """
SELECT i.invoice_no, i.customer_id, c.name AS customer_name_master, i.final_amount
FROM r_invoice i JOIN r_customer c ON i.customer_id = c.id""")
def invoice_customers(r):
    return (rp.invoice_customers(r.invoice, r.customer)
            .select("invoice_no", "customer_id", "customer_name_master", "final_amount"))


@register("list_ledger", """
SELECT t.transaction_date, t.customer_mobile, COALESCE(c.name, 'Unknown') AS customer_name,
       t.amount, t.transaction_type, t.balance
FROM r_ledger t LEFT JOIN r_customer c ON t.customer_mobile = c.mobile
ORDER BY t.transaction_date DESC NULLS FIRST""")
def list_ledger(r):
    return lg.list_ledger(r.ledger, r.customer)


@register("filter_ledger", """
SELECT * FROM (
  SELECT t.*, COALESCE(c.name, 'Unknown') AS customer_name
  FROM r_ledger t LEFT JOIN r_customer c ON t.customer_mobile = c.mobile)
WHERE (contains(lower(customer_mobile), '00001') OR contains(lower(customer_name), '00001'))
  AND transaction_type = 'Credit'""")
def filter_ledger(r):
    return lg.filter_ledger(_named_ledger(r), text="00001", ttype="Credit")


@register("filter_ledger_customer_date", """
SELECT t.*, COALESCE(c.name, 'Unknown') AS customer_name
FROM r_ledger t LEFT JOIN r_customer c ON t.customer_mobile = c.mobile
WHERE customer_mobile = (SELECT min(customer_mobile) FROM r_ledger_e)
  AND CAST(transaction_date AS DATE) = (SELECT CAST(min(transaction_date) AS DATE) FROM r_ledger_e
      WHERE customer_mobile = (SELECT min(customer_mobile) FROM r_ledger_e))""")
def filter_ledger_customer_date(r):
    first = r.ledger_entries.agg(F.min(F.struct("customer_mobile", "transaction_date")).alias("m")).first()["m"]
    return lg.filter_ledger(_named_ledger(r), customer=first["customer_mobile"],
                            date=first["transaction_date"].date().isoformat())


def _named_ledger(r):
    names = r.customer.select(F.col("mobile").alias("customer_mobile"), F.col("name").alias("_n"))
    return (r.ledger.join(names, "customer_mobile", "left")
            .withColumn("customer_name", F.coalesce(F.col("_n"), F.lit("Unknown"))).drop("_n"))


@register("ledger_customers", "SELECT DISTINCT customer_mobile FROM r_ledger")
def ledger_customers(r):
    return lg.ledger_customers(r.ledger_entries)


@register("pricing_report", f"""
SELECT p.pro_id, p.pro_name, p.cost_price, p.selling_price,
       CAST(p.selling_price - p.cost_price AS DECIMAL(10,2)) AS margin,
       CAST(CASE WHEN p.cost_price > 0 THEN LEAST({pct_sql('p.selling_price', 'p.cost_price')},
           CAST(999.99 AS DECIMAL(5,2))) ELSE 0 END AS DECIMAL(5,2)) AS profit_percentage,
       CAST(p.cost_price * COALESCE(i.quantity, 0) AS DECIMAL(18,2)) AS stock_value,
       CAST(p.selling_price * COALESCE(i.quantity, 0) AS DECIMAL(18,2)) AS stock_selling_value,
       CAST(p.selling_price - p.cost_price AS DECIMAL(10,2)) AS net_profit,
       COALESCE(i.quantity, 0) AS quantity, p.unit, p.category
FROM r_product p LEFT JOIN r_inventory i ON i.product_id = p.pro_id""")
def pricing_report(r):
    return rp.pricing_report(r.product, r.inventory)
