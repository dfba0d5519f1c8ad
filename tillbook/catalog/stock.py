"""Catalog: stock positions, checks and numbering (H-6, H-7, P-3, P-4, M-5,
M-10..M-12, B-9, W-5, W-6)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.oracle_views import AS_OF as D
from tillbook.functions import rules as R
from tillbook.operators import numbering as nb
from tillbook.operators import reports as rp
from tillbook.operators import stock as st
from tillbook.sources.fixtures import AS_OF

LINE_ORDER = ["invoice_no", "line_no", "quantity"]


def sales_batch(r):
    return r.lines


_LABELS = """
CASE WHEN availability IS NULL THEN 'Unknown' WHEN availability >= 3 THEN 'In Stock'
     WHEN availability >= 1 THEN 'Low Stock' ELSE 'Out of Stock' END AS label_page,
CASE WHEN availability >= 4 THEN 'In Stock' WHEN availability >= 2 THEN 'Low Stock'
     ELSE 'Out of Stock' END AS label_trigger"""


@register("inventory_availability",
          "SELECT product_id, quantity, safety_level, availability FROM r_inventory")
def inventory_availability(r):
    return r.inventory.select("product_id", "quantity", "safety_level", "availability")


@register("availability_labels", f"SELECT product_id, availability, {_LABELS} FROM r_inventory")
def availability_labels(r):
    return r.inventory.select("product_id", "availability",
                              R.availability_label("availability", "page").alias("label_page"),
                              R.availability_label("availability", "trigger").alias("label_trigger"))


@register("check_stock_line", f"""
WITH batch AS (SELECT * FROM r_lines),
x AS (SELECT b.*, COALESCE(i.quantity >= b.quantity, FALSE) AS line_ok
      FROM batch b LEFT JOIN r_inventory i ON b.product_id = i.product_id)
SELECT invoice_no, bool_and(line_ok) AS invoice_ok,
       CAST(COUNT(CASE WHEN NOT line_ok THEN 1 END) AS BIGINT) AS short_lines
FROM x GROUP BY invoice_no""")
def check_stock_line(r):
    return st.stock_verdicts(sales_batch(r), r.inventory, "line")


@register("check_stock_cumulative", f"""
WITH batch AS (SELECT * FROM r_lines),
x AS (SELECT b.*, i.quantity AS stock,
             SUM(b.quantity) OVER (PARTITION BY b.product_id ORDER BY b.invoice_no, b.line_no, b.quantity
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS demand
      FROM batch b LEFT JOIN r_inventory i ON b.product_id = i.product_id),
y AS (SELECT *, COALESCE(stock >= demand, FALSE) AS line_ok FROM x)
SELECT invoice_no, bool_and(line_ok) AS invoice_ok,
       CAST(COUNT(CASE WHEN NOT line_ok THEN 1 END) AS BIGINT) AS short_lines
FROM y GROUP BY invoice_no""")
def check_stock_cumulative(r):
    return st.stock_verdicts(sales_batch(r), r.inventory, "cumulative", LINE_ORDER)


def served_sql(lines: str) -> str:
    """``served`` (invoice_no): invoices of ``lines`` accepted one after the
    other; a recursion step takes the next invoice that could ever fit, and
    ``turns`` keeps what is used of each product and who was accepted."""
    return f"""
need AS MATERIALIZED (SELECT b.invoice_no, b.product_id, SUM(b.quantity) AS need, any_value(i.quantity) AS stock
  FROM {lines} b LEFT JOIN r_inventory i ON b.product_id = i.product_id GROUP BY 1, 2),
claims AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY invoice_no) AS k, invoice_no, list(struct_pack(p := product_id, need := need, stock := stock)) AS asks
  FROM need GROUP BY invoice_no HAVING bool_and(COALESCE(need <= stock, FALSE))),
turns(kind, id, used, k) USING KEY (kind, id) AS (
  SELECT 'turn', CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT)
  UNION
  (WITH c AS (SELECT claims.* FROM claims, (SELECT max(k) AS k FROM turns) t WHERE claims.k = t.k + 1),
   a AS (SELECT k, unnest(asks, recursive := true) FROM c),
   j AS (SELECT a.*, COALESCE(t.used, 0) AS used FROM a LEFT JOIN recurring.turns t ON t.kind = 'product' AND t.id = a.p),
   v AS (SELECT bool_and(used + need <= stock) AS ok FROM j)
   SELECT 'product', j.p, j.used + j.need, j.k FROM j, v WHERE v.ok
   UNION ALL SELECT 'turn', 0, 0, k FROM c
   UNION ALL SELECT 'invoice', invoice_no, 0, k FROM c, v WHERE v.ok)),
served AS (SELECT id AS invoice_no FROM turns WHERE kind = 'invoice')"""


@register("check_stock_sequential", f"""
WITH RECURSIVE {served_sql("r_lines")}
SELECT invoice_no, invoice_no IN (SELECT invoice_no FROM served) AS invoice_ok,
       CAST(COUNT(CASE WHEN invoice_no NOT IN (SELECT invoice_no FROM served) THEN 1 END) AS BIGINT) AS short_lines
FROM r_lines GROUP BY invoice_no""")
def check_stock_sequential(r):
    return st.stock_verdicts(sales_batch(r), r.inventory, "sequential")


_AVAIL = """CAST(CASE WHEN q_ratio >= 1.0 THEN 5 WHEN q_ratio >= 0.85 THEN 4 WHEN q_ratio >= 0.50 THEN 3
                  WHEN q_ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER)"""
# the products' own safety levels, one above what the inventory stores
_SAFETY_SQL = "r_newsafety AS (SELECT pro_id, TRY_CAST(safety_level AS INTEGER) + 1 AS sl FROM r_product)"


def raised_safety(r):
    """Products whose safety level changed since the inventory stored it."""
    return r.product.withColumn("safety_level", (F.col("safety_level").cast("int") + 1).cast("string"))


def moved_sql(moves: str, sign: str) -> str:
    """Inventory after summed ``moves``: changed rows take the product's
    safety level, others keep their availability."""
    return f"""{_SAFETY_SQL},
moved AS (SELECT product_id, SUM(q) AS d FROM ({moves}) GROUP BY product_id),
n AS (SELECT i.product_id, i.product_name, i.quantity AS old_quantity, i.availability AS old_availability,
             CAST(i.quantity {sign} COALESCE(m.d, 0) AS INTEGER) AS new_q,
             m.product_id IS NOT NULL AS hit, COALESCE(p.sl, 1) AS new_sl,
             CASE WHEN m.product_id IS NOT NULL THEN COALESCE(p.sl, 1) ELSE i.safety_level END AS safety_level
      FROM r_inventory i LEFT JOIN moved m ON i.product_id = m.product_id
      LEFT JOIN r_newsafety p ON i.product_id = p.pro_id),
inv2 AS (SELECT product_id, product_name, old_quantity, new_q AS quantity, safety_level,
                CASE WHEN hit THEN {_AVAIL} ELSE old_availability END AS availability
         FROM (SELECT *, CASE WHEN new_sl = 0 THEN 1.0 ELSE CAST(new_q AS DOUBLE) / CAST(new_sl AS DOUBLE) END
                      AS q_ratio FROM n))"""


_SOLD_SQL = moved_sql("SELECT product_id, quantity AS q FROM r_lines", "-")
_RESTOCK_SQL = moved_sql("SELECT product_id, quantity_added AS q FROM r_add_item", "+")


@register("apply_sales", f"WITH {_SOLD_SQL} SELECT product_id, quantity, availability FROM inv2")
def apply_sales(r):
    return st.apply_sales(r.inventory, sales_batch(r), raised_safety(r)).select(
        "product_id", "quantity", "availability")


@register("apply_restock", f"WITH {_RESTOCK_SQL} SELECT product_id, quantity, safety_level, availability FROM inv2")
def apply_restock(r):
    inv, _rej = st.apply_restock(r.inventory, r.add_item, raised_safety(r))
    return inv.select("product_id", "quantity", "safety_level", "availability")


@register("apply_restock_rejects", """
SELECT ref_order, ref_line, product_id, 'product not in inventory' AS reason FROM r_add_item
WHERE product_id NOT IN (SELECT product_id FROM r_inventory WHERE availability >= 3)""")
def apply_restock_rejects(r):
    # stock of the well supplied products only: the others' restocks have no inventory row
    _inv, rej = st.apply_restock(r.inventory.filter("availability >= 3"), r.add_item, r.product)
    return rej.select("ref_order", "ref_line", "product_id", "reason")


@register("mirror_quantity", f"""
WITH {_RESTOCK_SQL}
SELECT p.pro_id, CASE WHEN r.product_id IS NOT NULL THEN r.quantity ELSE p.quantity END AS quantity
FROM r_product p LEFT JOIN inv2 r ON p.pro_id = r.product_id""")
def mirror_quantity(r):
    inv, _rej = st.apply_restock(r.inventory, r.add_item, r.product)
    return st.mirror_quantity(inv, r.product).select("pro_id", "quantity")


@register("below_safety", f"""
WITH {_SOLD_SQL}
SELECT product_id, product_name, old_quantity, quantity AS new_quantity, safety_level FROM inv2
WHERE quantity < old_quantity AND quantity < safety_level""")
def below_safety(r):
    new = st.apply_sales(r.inventory, sales_batch(r), raised_safety(r))
    return rp.below_safety(r.inventory, new)


_NEW_PRODUCTS = """
existing AS (SELECT * EXCLUDE (ratio) FROM r_inventory WHERE availability >= 3),
p AS (SELECT pro_id AS product_id, pro_name AS product_name, selling_price AS price, quantity, unit,
             category, TRY_CAST(NULLIF(safety_level, '') AS INTEGER) AS safety_level, expiry_date,
             hc_code AS hscode FROM r_product),
fresh AS (SELECT p.*, CAST(CASE WHEN q_ratio >= 1.0 THEN 5 WHEN q_ratio >= 0.85 THEN 4
                                WHEN q_ratio >= 0.50 THEN 3 WHEN q_ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER)
                      AS availability
          FROM (SELECT *, CASE WHEN COALESCE(safety_level, 1) = 0 THEN 1.0
                               ELSE CAST(quantity AS DOUBLE) / CAST(COALESCE(safety_level, 1) AS DOUBLE) END
                          AS q_ratio FROM p) p
          WHERE product_id NOT IN (SELECT product_id FROM existing))"""


@register("product_to_inventory_ignore", f"""
WITH {_NEW_PRODUCTS}
SELECT product_id, quantity, availability FROM existing
UNION ALL SELECT product_id, quantity, availability FROM fresh""")
def product_to_inventory_ignore(r):
    existing = r.inventory.filter(F.col("availability") >= 3)
    return st.product_to_inventory(r.product, existing, "ignore").select(
        "product_id", "quantity", "availability")


@register("product_to_inventory_add", f"""
WITH {_NEW_PRODUCTS},
n AS (SELECT e.product_id, e.safety_level, CAST(e.quantity + COALESCE(p.quantity, 0) AS INTEGER) AS new_q
      FROM existing e LEFT JOIN p ON e.product_id = p.product_id)
SELECT product_id, new_q AS quantity, {_AVAIL} AS availability
FROM (SELECT *, CASE WHEN COALESCE(safety_level, 1) = 0 THEN 1.0
                  ELSE CAST(new_q AS DOUBLE) / CAST(COALESCE(safety_level, 1) AS DOUBLE) END AS q_ratio FROM n)
UNION ALL SELECT product_id, quantity, availability FROM fresh""")
def product_to_inventory_add(r):
    existing = r.inventory.filter(F.col("availability") >= 3)
    return st.product_to_inventory(r.product, existing, "add").select(
        "product_id", "quantity", "availability")


_RESTOCK_ORDER = ["added_date", "ref_order", "ref_line", "product_id", "quantity_added"]


@register("restock_supplier_invoices", """
SELECT CAST(y AS VARCHAR) || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0') ELSE CAST(n AS VARCHAR) END
         AS invoice_no, supplier_id, product_id, quantity, total_amount, invoice_date
FROM (SELECT year(a.added_date) AS y, row_number() OVER (
         PARTITION BY year(a.added_date)
         ORDER BY a.added_date, a.ref_order, a.ref_line, a.product_id, a.quantity_added) AS n,
       p.supplier_id, a.product_id, a.quantity_added AS quantity,
       CAST(p.cost_price * a.quantity_added AS DECIMAL(10,2)) AS total_amount,
       a.added_date AS invoice_date
FROM r_add_item a JOIN r_inventory i ON a.product_id = i.product_id
JOIN r_product p ON a.product_id = p.pro_id
WHERE a.quantity_added > 0)""")
def restock_supplier_invoices(r):
    _add, sup, _rej = st.restock(r.add_item, r.inventory, r.product, None, _RESTOCK_ORDER)
    return sup.drop("status", "payment_status")


# restock requests with comments, some for nothing or for unknown products;
# numbers go on after an existing serial close to six digits
_REQUESTS_SQL = """
req AS (SELECT ref_order, ref_line, CASE WHEN ref_order % 19 = 0 THEN product_id + 100000000 ELSE product_id END AS product_id,
               CASE WHEN ref_order % 17 = 0 THEN 0 ELSE quantity_added END AS quantity_added, added_date,
               'order ' || CAST(ref_order AS VARCHAR) AS comments FROM r_add_item),
good AS (SELECT a.*, p.supplier_id, p.cost_price, year(a.added_date) AS y FROM req a
         JOIN r_inventory i ON a.product_id = i.product_id JOIN r_product p ON a.product_id = p.pro_id
         WHERE a.quantity_added > 0),
num AS (SELECT *, 99990 + row_number() OVER (PARTITION BY y ORDER BY added_date, ref_order, ref_line, product_id,
                                             quantity_added) AS n FROM good),
done AS (SELECT *, CAST(y AS VARCHAR) || CASE WHEN n < 100000 THEN lpad(CAST(n AS VARCHAR), 5, '0')
                                              ELSE CAST(n AS VARCHAR) END AS invoice_no FROM num)"""


def _restock_job(r):
    a = r.add_item
    req = a.withColumns({
        "product_id": F.when(F.col("ref_order") % 19 == 0, F.col("product_id") + 100000000).otherwise(F.col("product_id")),
        "quantity_added": F.when(F.col("ref_order") % 17 == 0, 0).otherwise(F.col("quantity_added")),
        "comments": F.concat(F.lit("order "), F.col("ref_order").cast("string"))})
    years = a.select(F.concat(F.year("added_date").cast("string"), F.lit("99990")).alias("invoice_no"))
    return st.restock_job(req, r.inventory, r.product, years, _RESTOCK_ORDER)


@register("restock_job_items", f"""
WITH {_REQUESTS_SQL}
SELECT invoice_no, product_id, quantity_added, supplier_id, comments FROM done""")
def restock_job_items(r):
    return _restock_job(r)["add_item"].select("invoice_no", "product_id", "quantity_added", "supplier_id", "comments")


@register("restock_job_invoices", f"""
WITH {_REQUESTS_SQL}
SELECT invoice_no, product_id, quantity_added AS quantity,
       CAST(cost_price * quantity_added AS DECIMAL(10,2)) AS total_amount FROM done""")
def restock_job_invoices(r):
    return _restock_job(r)["supplier_invoice"].select("invoice_no", "product_id", "quantity", "total_amount")


@register("restock_job_rejects", f"""
WITH {_REQUESTS_SQL}
SELECT ref_order, ref_line, CASE WHEN quantity_added <= 0 THEN 'quantity must be > 0' ELSE 'product not found' END AS reason
FROM req WHERE quantity_added <= 0 OR product_id NOT IN (SELECT product_id FROM r_inventory)""")
def restock_job_rejects(r):
    return _restock_job(r)["rejects"].select("ref_order", "ref_line", "reason")


@register("restock_job_product", f"""
WITH {_REQUESTS_SQL},
added AS (SELECT product_id, SUM(quantity_added) AS a FROM done GROUP BY product_id)
SELECT p.pro_id, CASE WHEN a.product_id IS NOT NULL THEN CAST(i.quantity + a.a AS INTEGER) ELSE p.quantity END AS quantity
FROM r_product p LEFT JOIN added a ON p.pro_id = a.product_id LEFT JOIN r_inventory i ON p.pro_id = i.product_id""")
def restock_job_product(r):
    return _restock_job(r)["product"].select("pro_id", "quantity")


@register("invoice_identity_ids", """
SELECT invoice_no, CAST(99999 + row_number() OVER (ORDER BY date, invoice_no) AS BIGINT) AS id
FROM r_invoice""")
def invoice_identity_ids(r):
    return nb.assign_ids(r.invoice.select("invoice_no", "date"), ["date", "invoice_no"],
                         start=100000).select("invoice_no", "id")
