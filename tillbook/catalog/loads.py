"""Catalog: bulk loads, upserts, updates, deletes (M-1..M-14, H-21, J-8, J-9).

The import "files" are derived from the driver tables so their size grows
with the scale factor:
  customer file  - one row per order: the ordering customer's name and
                   mobile (every third mobile padded with blanks)
  supplier file  - one row per supplier
  product file   - two rows per part: the part, then a second delivery of it
                   under an upper-cased name; size-50 parts carry a bad price
Existing tables are split by a business attribute (market segment, size).
"""

import uuid

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.functions import rules as R
from tillbook.operators import loads as ld
from tillbook.session import scratch_path
from tillbook.sources.fixtures import mobile_of

EXISTING_SEGMENTS = ("AUTOMOBILE", "BUILDING")

# ---- derived inputs ---------------------------------------------------------


def customer_file(r):
    o, c = r.raw("orders"), r.raw("customer").select("c_custkey", "c_name")
    mob = mobile_of(o.o_custkey)
    return (o.join(c, o.o_custkey == c.c_custkey, "inner")
            .select(o.o_orderkey.alias("ord"), c.c_name.alias("name"),
                    F.when(o.o_orderkey % 3 == 0, F.concat(F.lit("  "), mob, F.lit(" ")))
                     .otherwise(mob).alias("mobile"),
                    o.o_orderpriority.alias("address"),
                    F.concat(F.lower(F.regexp_replace(c.c_name, "[^A-Za-z0-9]", "")),
                             F.lit("@example.com")).alias("mail")))


def existing_customers(r):
    c = r.raw("customer")
    return (c.filter(c.c_mktsegment.isin(*EXISTING_SEGMENTS))
            .select(c.c_custkey.alias("id"), c.c_name.alias("name"),
                    mobile_of(c.c_custkey).alias("mobile")))


_CUSTOMER_FILE_SQL = """
existing AS (SELECT c_custkey AS id, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile
             FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')),
rows AS (SELECT o.o_orderkey AS ord, c.c_name AS name,
                CASE WHEN o.o_orderkey % 3 = 0 THEN '  ' || lpad(CAST(o.o_custkey AS VARCHAR), 10, '0') || ' '
                     ELSE lpad(CAST(o.o_custkey AS VARCHAR), 10, '0') END AS mobile,
                o.o_orderpriority AS address,
                lower(regexp_replace(c.c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS mail
         FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
trimmed AS (SELECT ord, name, trim(mobile) AS mobile, address, mail FROM rows),
fresh AS (SELECT * FROM trimmed WHERE mobile NOT IN (SELECT mobile FROM existing)),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mobile ORDER BY ord) AS rn FROM fresh)
           WHERE rn = 1)"""


@register("import_customers", f"""
WITH {_CUSTOMER_FILE_SQL}
SELECT CAST((SELECT max(id) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT) AS id,
       name, mobile, address, mail FROM firsts""")
def import_customers(r):
    new, _skipped = ld.import_customers(customer_file(r), existing_customers(r))
    return new


@register("import_customers_skipped", f"""
WITH {_CUSTOMER_FILE_SQL}
SELECT CAST(COUNT(*) AS BIGINT) AS skipped FROM trimmed
WHERE ord NOT IN (SELECT ord FROM firsts)""")
def import_customers_skipped(r):
    _new, skipped = ld.import_customers(customer_file(r), existing_customers(r))
    return skipped.agg(F.count(F.lit(1)).alias("skipped"))


@register("ensure_customers", f"""
WITH {_CUSTOMER_FILE_SQL},
created AS (SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY ord) AS id, mobile FROM firsts),
allc AS (SELECT id, mobile FROM existing UNION ALL SELECT id, mobile FROM created)
SELECT t.ord, t.mobile, CAST(a.id AS BIGINT) AS customer_id FROM trimmed t LEFT JOIN allc a ON t.mobile = a.mobile""")
def ensure_customers(r):
    rows = customer_file(r).withColumn("mobile", F.trim("mobile")).select("ord", "mobile", "name")
    _cust, with_ids = ld.ensure_customers(rows, existing_customers(r))
    return with_ids.select("ord", "mobile", "customer_id")


def supplier_file(r):
    s = r.raw("supplier")
    return s.select(s.s_suppkey.alias("ord"), s.s_name.alias("name"),
                    F.concat(F.lit("Net "), ((s.s_suppkey % 4 + 1) * 15).cast("string"),
                             F.lit(" days")).alias("terms"),
                    F.lpad(s.s_suppkey.cast("string"), 10, "9").alias("mobile"),
                    F.concat(F.lit("s"), s.s_suppkey.cast("string"), F.lit("@example.com")).alias("mail"),
                    F.concat(s.s_name, F.lit(" Pvt Ltd")).alias("company"))


@register("import_suppliers", """
SELECT CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS id,
       s_name AS name, 'Net ' || CAST((s_suppkey % 4 + 1) * 15 AS VARCHAR) || ' days' AS terms,
       lpad(CAST(s_suppkey AS VARCHAR), 10, '9') AS mobile,
       's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS mail, s_name || ' Pvt Ltd' AS company
FROM supplier""")
def import_suppliers(r):
    return ld.import_suppliers(supplier_file(r), r.supplier)


def product_file(r):
    p = r.raw("part")
    sell = p.p_retailprice.cast(R.MONEY)
    cost = (sell * F.lit(0.70).cast("decimal(3,2)")).cast(R.MONEY)
    base = dict(pro_id=p.p_partkey, cost_price=F.when(p.p_size == 50, F.lit("n/a"))
                .otherwise(cost.cast("string")),
                selling_price=sell.cast("string"), unit=F.lit("pcs"), category=p.p_type,
                safety_level=p.p_size.cast("string"),
                expiry_date=F.date_add(F.lit("2001-01-01").cast("date"), (p.p_partkey % 400).cast("int"))
                .cast("string"),
                supplier_id=(p.p_partkey % 120).cast("string"),
                terms_from_invoice=F.lit("Net 30"),
                hc_code=F.concat(F.lit("HC"), p.p_partkey.cast("string")))
    first = p.select((p.p_partkey * 2).alias("ord"), p.p_name.alias("pro_name"),
                     p.p_size.cast("string").alias("quantity"),
                     *[v.alias(k) for k, v in base.items()])
    again = p.select((p.p_partkey * 2 + 1).alias("ord"), F.upper(p.p_name).alias("pro_name"),
                     (p.p_size % 7).cast("string").alias("quantity"),
                     *[v.alias(k) for k, v in base.items()])
    return first.unionByName(again)


def existing_products(r):
    keep = r.raw("part").filter(F.col("p_size") <= 25).select(F.col("p_partkey").alias("pro_id"))
    return r.product.join(keep, "pro_id", "left_semi")


_PRODUCT_FILE_SQL = """
base AS (SELECT p_partkey AS pro_id,
                CASE WHEN p_size = 50 THEN NULL
                     ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.70 AS DECIMAL(3,2)) AS DECIMAL(10,2)) END
                  AS cost_price,
                CAST(p_retailprice AS DECIMAL(10,2)) AS selling_price, p_type AS category,
                CAST(p_size AS VARCHAR) AS safety_level, CAST(p_partkey % 120 AS INTEGER) AS supplier_id,
                p_name, p_size FROM part),
rows AS (SELECT pro_id * 2 AS ord, pro_id, p_name AS pro_name, p_size AS quantity, * EXCLUDE (pro_id, p_name, p_size)
         FROM base
         UNION ALL
         SELECT pro_id * 2 + 1, pro_id, upper(p_name), p_size % 7, * EXCLUDE (pro_id, p_name, p_size) FROM base),
ok AS (SELECT rows.*, s.s_name AS supplier_name FROM rows JOIN supplier s ON rows.supplier_id = s.s_suppkey
       WHERE cost_price IS NOT NULL),
sums AS (SELECT pro_id, SUM(quantity) AS q FROM ok GROUP BY pro_id),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pro_id ORDER BY ord) AS rn FROM ok) WHERE rn = 1),
existing AS (SELECT * FROM r_product WHERE pro_id IN (SELECT p_partkey FROM part WHERE p_size <= 25)),
product2 AS (
  SELECT e.pro_id, e.pro_name, CAST(e.quantity + COALESCE(s.q, 0) AS INTEGER) AS quantity, e.safety_level
  FROM existing e LEFT JOIN sums s ON e.pro_id = s.pro_id
  UNION ALL
  SELECT f.pro_id, f.pro_name, CAST(s.q AS INTEGER), f.safety_level
  FROM firsts f JOIN sums s ON f.pro_id = s.pro_id WHERE f.pro_id NOT IN (SELECT pro_id FROM existing))"""


# the updated inventory quantities are mirrored back to the products
@register("import_products_product", f"""
WITH {_PRODUCT_FILE_SQL}
SELECT p.pro_id, p.pro_name,
       CASE WHEN s.q IS NOT NULL AND i.product_id IS NOT NULL THEN CAST(COALESCE(i.quantity, 0) + s.q AS INTEGER)
            ELSE p.quantity END AS quantity
FROM product2 p LEFT JOIN sums s ON p.pro_id = s.pro_id LEFT JOIN r_inventory i ON p.pro_id = i.product_id""")
def import_products_product(r):
    p2, _inv2, _rej = ld.import_products(product_file(r), existing_products(r), r.supplier, r.inventory)
    return p2.select("pro_id", "pro_name", "quantity")


@register("import_products_inventory", f"""
WITH {_PRODUCT_FILE_SQL},
n AS (SELECT i.product_id,
             CAST(CASE WHEN s.q IS NOT NULL THEN COALESCE(i.quantity, 0) + s.q ELSE i.quantity END AS INTEGER) AS quantity,
             s.q IS NOT NULL AS hit, i.availability AS old_availability,
             COALESCE(TRY_CAST(p.safety_level AS INTEGER), 1) AS sl
      FROM r_inventory i LEFT JOIN sums s ON i.product_id = s.pro_id
      LEFT JOIN product2 p ON i.product_id = p.pro_id),
x AS (SELECT *, CASE WHEN sl = 0 THEN 1.0 ELSE CAST(quantity AS DOUBLE) / CAST(sl AS DOUBLE) END AS q_ratio FROM n)
SELECT product_id, quantity, CASE WHEN NOT hit THEN old_availability ELSE
       CAST(CASE WHEN q_ratio >= 1.0 THEN 5 WHEN q_ratio >= 0.85 THEN 4 WHEN q_ratio >= 0.50 THEN 3
                 WHEN q_ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER) END AS availability
FROM x""")
def import_products_inventory(r):
    _p2, inv2, _rej = ld.import_products(product_file(r), existing_products(r), r.supplier, r.inventory)
    return inv2.select("product_id", "quantity", "availability")


@register("import_products_rejects", f"""
WITH {_PRODUCT_FILE_SQL}
SELECT ord, CASE WHEN cost_price IS NULL THEN 'cost_price is not a number' ELSE 'missing supplier' END AS reason
FROM rows WHERE cost_price IS NULL OR supplier_id NOT IN (SELECT s_suppkey FROM supplier)""")
def import_products_rejects(r):
    _p2, _inv2, rej = ld.import_products(product_file(r), existing_products(r), r.supplier, r.inventory)
    return rej


@register("import_products_counts", f"""
WITH {_PRODUCT_FILE_SQL},
t AS (SELECT CASE WHEN cost_price IS NULL THEN 'cost_price is not a number'
                  WHEN supplier_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'missing supplier'
                  ELSE 'accepted' END AS outcome FROM rows)
SELECT outcome, COUNT(*) AS counted, COUNT(*) AS written FROM t GROUP BY outcome""")
def import_products_counts(r):
    """Rows by outcome, as counted while they were written and as written."""
    path = scratch_path(r.spark, f"product-load-{uuid.uuid4().hex}")
    counts = ld.write_tagged(ld.tag_products(product_file(r), r.supplier), path, "b1", ld.PRODUCT_REASONS)
    outcome = F.coalesce("reason", F.lit("accepted"))
    written = r.spark.read.parquet(path).select(outcome.alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("written"))
    counted = r.spark.createDataFrame([(k, n) for k, n in counts.items() if n and k not in ("read", "rejected")],
                                      "outcome string, counted long")
    return counted.join(written, "outcome", "full")


# the same file with broken cells: ids as "007", prices too large, NaN and
# huge quantities, unreadable ids, NaN safety levels
def messy_product_file(r):
    k = F.col("pro_id").cast("long")
    f = product_file(r).filter("cost_price <> 'n/a'")
    return f.withColumns({
        "pro_id": F.when(k % 23 == 0, F.lit("abc")).when(k % 2 == 0, F.concat(F.lit("00"), k.cast("string")))
        .when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string")),
        "selling_price": F.when(k % 29 == 0, F.lit("1000000000")).otherwise(F.col("selling_price")),
        "quantity": F.when(k % 31 == 0, F.lit("NaN")).when(k % 37 == 0, F.lit("1e12")).otherwise(F.col("quantity")),
        "safety_level": F.when(k % 41 == 0, F.lit("NaN")).otherwise(F.col("safety_level"))})


_MESSY_SQL = """
base AS (SELECT p_partkey AS k, p_size, p_name, CAST(p_partkey % 120 AS INTEGER) AS supplier_id FROM part
         WHERE p_size <> 50),
rows AS (SELECT k * 2 AS ord, k, p_name AS pro_name, p_size AS q, p_size, supplier_id FROM base
         UNION ALL SELECT k * 2 + 1, k, upper(p_name), p_size % 7, p_size, supplier_id FROM base),
tagged AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'pro_id is not a whole number'
                          WHEN k % 29 = 0 THEN 'selling_price is out of range'
                          WHEN k % 31 = 0 THEN 'quantity is not a number'
                          WHEN k % 37 = 0 THEN 'quantity is out of range'
                          WHEN supplier_id NOT IN (SELECT id FROM r_supplier) THEN 'missing supplier' END AS reason
           FROM rows)"""


@register("import_products_messy", f"""
WITH {_MESSY_SQL},
sums AS (SELECT k, SUM(q) AS q, arg_min(pro_name, ord) AS pro_name,
                CASE WHEN k % 41 = 0 THEN '0' ELSE CAST(min(p_size) AS VARCHAR) END AS safety_level
         FROM tagged WHERE reason IS NULL GROUP BY k),
existing AS (SELECT * FROM r_product WHERE pro_id IN (SELECT p_partkey FROM part WHERE p_size <= 25))
SELECT e.pro_id, e.pro_name, e.safety_level,
       CASE WHEN s.k IS NOT NULL AND i.product_id IS NOT NULL THEN CAST(COALESCE(i.quantity, 0) + s.q AS INTEGER)
            ELSE e.quantity END AS quantity
FROM existing e LEFT JOIN sums s ON e.pro_id = s.k LEFT JOIN r_inventory i ON e.pro_id = i.product_id
UNION ALL
SELECT s.k, s.pro_name, s.safety_level, CAST(COALESCE(i.quantity, 0) + s.q AS INTEGER)
FROM sums s JOIN r_inventory i ON s.k = i.product_id WHERE s.k NOT IN (SELECT pro_id FROM existing)""")
def import_products_messy(r):
    p2, _inv2, _rej = ld.import_products(messy_product_file(r), existing_products(r), r.supplier, r.inventory)
    return p2.select("pro_id", "pro_name", "safety_level", "quantity")


@register("import_products_messy_rejects", f"""
WITH {_MESSY_SQL} SELECT ord, reason FROM tagged WHERE reason IS NOT NULL""")
def import_products_messy_rejects(r):
    _p2, _inv2, rej = ld.import_products(messy_product_file(r), existing_products(r), r.supplier, r.inventory)
    return rej


@register("upsert_by_name", f"""
WITH {_PRODUCT_FILE_SQL},
v AS (SELECT * FROM rows WHERE supplier_id IN (SELECT s_suppkey FROM supplier)),
names AS (SELECT pro_name, min(pro_id) AS pid FROM existing GROUP BY pro_name),
added AS (SELECT n.pid, SUM(v.quantity) AS q FROM v JOIN names n ON v.pro_name = n.pro_name GROUP BY n.pid),
fresh AS (SELECT * FROM v WHERE pro_name NOT IN (SELECT pro_name FROM names)),
ff AS (SELECT pro_name, min(ord) AS ord, SUM(quantity) AS q FROM fresh GROUP BY pro_name)
SELECT e.pro_id, e.pro_name, CAST(e.quantity + COALESCE(a.q, 0) AS INTEGER) AS quantity
FROM existing e LEFT JOIN added a ON e.pro_id = a.pid
UNION ALL
SELECT CAST((SELECT max(pro_id) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT), trim(pro_name),
       CAST(q AS INTEGER)
FROM ff""")
def upsert_by_name(r):
    ok, _bad = ld.coerce_products(product_file(r).withColumn(
        "cost_price", F.coalesce(F.col("cost_price").try_cast("double").cast("string"), F.lit("0"))))
    p2, _inv2, _rej = ld.upsert_by_name(ok, existing_products(r), r.inventory, r.supplier)
    return p2.select("pro_id", "pro_name", "quantity")


@register("upsert_by_name_inventory", f"""
WITH {_PRODUCT_FILE_SQL},
v AS (SELECT * FROM rows WHERE supplier_id IN (SELECT s_suppkey FROM supplier)),
names AS (SELECT pro_name, min(pro_id) AS pid FROM existing GROUP BY pro_name),
added AS (SELECT n.pid, SUM(v.quantity) AS q FROM v JOIN names n ON v.pro_name = n.pro_name GROUP BY n.pid),
fresh AS (SELECT * FROM v WHERE pro_name NOT IN (SELECT pro_name FROM names)),
ff AS (SELECT pro_name, min(ord) AS ord, SUM(quantity) AS q FROM fresh GROUP BY pro_name)
SELECT i.product_id, CAST(i.quantity + COALESCE(a.q, 0) AS INTEGER) AS quantity
FROM r_inventory i LEFT JOIN added a ON i.product_id = a.pid
UNION ALL
SELECT CAST((SELECT max(pro_id) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT), CAST(q AS INTEGER) FROM ff""")
def upsert_by_name_inventory(r):
    ok, _bad = ld.coerce_products(product_file(r).withColumn(
        "cost_price", F.coalesce(F.col("cost_price").try_cast("double").cast("string"), F.lit("0"))))
    _p2, inv2, _rej = ld.upsert_by_name(ok, existing_products(r), r.inventory, r.supplier)
    return inv2.select("product_id", "quantity")


# the same stock with what its products say of it
@register("upsert_by_name_availability", f"""
WITH {_PRODUCT_FILE_SQL},
v AS (SELECT * FROM rows WHERE supplier_id IN (SELECT s_suppkey FROM supplier)),
names AS (SELECT pro_name, min(pro_id) AS pid FROM existing GROUP BY pro_name),
added AS (SELECT n.pid, SUM(v.quantity) AS q FROM v JOIN names n ON v.pro_name = n.pro_name GROUP BY n.pid),
ff AS (SELECT pro_name, min(ord) AS ord, SUM(quantity) AS q, arg_min(selling_price, ord) AS price,
              CAST(arg_min(safety_level, ord) AS INTEGER) AS sl
       FROM v WHERE pro_name NOT IN (SELECT pro_name FROM names) GROUP BY pro_name),
n AS (SELECT i.product_id, i.price, CAST(i.quantity + COALESCE(a.q, 0) AS INTEGER) AS quantity, a.pid IS NOT NULL AS hit,
             i.availability AS old, COALESCE(p.p_size + 1, 1) AS sl, i.safety_level AS old_sl
      FROM r_inventory i LEFT JOIN added a ON i.product_id = a.pid
      LEFT JOIN part p ON i.product_id = p.p_partkey AND p.p_size <= 25
      UNION ALL
      SELECT CAST((SELECT max(pro_id) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT), price,
             CAST(q AS INTEGER), TRUE, NULL, sl, NULL FROM ff),
x AS (SELECT *, CAST(quantity AS DOUBLE) / CAST(sl AS DOUBLE) AS ratio FROM n)
SELECT product_id, price, quantity, CASE WHEN hit THEN sl ELSE old_sl END AS safety_level,
       CASE WHEN NOT hit THEN old ELSE CAST(CASE WHEN ratio >= 1.0 THEN 5 WHEN ratio >= 0.85 THEN 4 WHEN ratio >= 0.50 THEN 3
                 WHEN ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER) END AS availability
FROM x""")
def upsert_by_name_availability(r):
    ok, _bad = ld.coerce_products(product_file(r).withColumn(
        "cost_price", F.coalesce(F.col("cost_price").try_cast("double").cast("string"), F.lit("0"))))
    # products whose safety level changed since the inventory stored it
    raised = existing_products(r).withColumn("safety_level", (F.col("safety_level").cast("int") + 1).cast("string"))
    _p2, inv2, _rej = ld.upsert_by_name(ok, raised, r.inventory, r.supplier)
    return inv2.select("product_id", "price", "quantity", "safety_level", "availability")


@register("upsert_by_name_rejects", f"""
WITH {_PRODUCT_FILE_SQL}
SELECT ord, 'invalid supplier_id' AS reason FROM rows WHERE supplier_id NOT IN (SELECT s_suppkey FROM supplier)""")
def upsert_by_name_rejects(r):
    ok, _bad = ld.coerce_products(product_file(r).withColumn(
        "cost_price", F.coalesce(F.col("cost_price").try_cast("double").cast("string"), F.lit("0"))))
    _p2, _inv2, rejects = ld.upsert_by_name(ok, existing_products(r), r.inventory, r.supplier)
    return rejects.select("ord", "reason")


@register("ensure_customers_table", f"""
WITH {_CUSTOMER_FILE_SQL}
SELECT CAST(id AS BIGINT) AS id, name, mobile FROM existing
UNION ALL
SELECT CAST((SELECT max(id) FROM existing) + row_number() OVER (ORDER BY ord) AS BIGINT), name, mobile FROM firsts""")
def ensure_customers_table(r):
    rows = customer_file(r).withColumn("mobile", F.trim("mobile")).select("ord", "mobile", "name")
    customers, _ids = ld.ensure_customers(rows, existing_customers(r))
    return customers.select("id", "name", "mobile")


@register("import_ledger", """
SELECT transaction_date, invoice_no, customer_id, amount, transaction_type, description FROM r_ledger
UNION ALL
SELECT ts, NULL, user_id, amount, 'Credit', 'Imported payment' FROM r_payment_events""")
def import_ledger(r):
    cols = ["transaction_date", "invoice_no", "customer_id", "amount", "transaction_type", "description"]
    e = r.payment_events.select(F.col("ts").alias("transaction_date"),
                                F.lit(None).cast("long").alias("invoice_no"),
                                F.col("user_id").alias("customer_id"), "amount",
                                F.lit("Credit").alias("transaction_type"),
                                F.lit("Imported payment").alias("description"))
    return ld.import_ledger(e, r.ledger_entries.select(*cols)).select(*cols)


@register("apply_customer_updates", """
WITH ch AS (SELECT customer_id AS id, upper(customer_name) AS name, invoice_no AS ord
            FROM r_invoice),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM ch) WHERE rn = 1)
SELECT c.id, CASE WHEN l.id IS NOT NULL THEN l.name ELSE c.name END AS name, c.mobile
FROM r_customer c LEFT JOIN last l ON c.id = l.id""")
def apply_customer_updates(r):
    changes = r.invoice.select(F.col("customer_id").alias("id"), F.upper("customer_name").alias("name"),
                            F.col("invoice_no").alias("ord"))
    return ld.apply_updates(r.customer, changes, "id", order="ord")


@register("delete_products_cascade", """
SELECT invoice_no, line_no, product_id, quantity FROM r_lines
WHERE product_id NOT IN (SELECT product_id FROM r_inventory WHERE availability = 1)""")
def delete_products_cascade(r):
    gone = r.inventory.filter(F.col("availability") == 1).select("product_id")
    out = ld.delete_cascade(gone, "product_id", {"lines": (r.lines, "product_id"),
                                                  "inventory": (r.inventory, "product_id")})
    return out["lines"].select("invoice_no", "line_no", "product_id", "quantity")


@register("delete_products_cascade_inventory", """
SELECT product_id, quantity FROM r_inventory
WHERE product_id NOT IN (SELECT product_id FROM r_inventory WHERE availability = 1)""")
def delete_products_cascade_inventory(r):
    gone = r.inventory.filter(F.col("availability") == 1).select("product_id")
    return ld.delete_cascade(gone, "product_id", {"inventory": (r.inventory, "product_id")})["inventory"].select(
        "product_id", "quantity")


_GONE_SQL = "gone AS (SELECT invoice_no FROM r_invoice WHERE payment_status = 'Unpaid')"


def _deleted_invoices(r):
    gone = r.invoice.filter(F.col("payment_status") == "Unpaid").select("invoice_no")
    return ld.delete_cascade(gone, "invoice_no", {"lines": (r.lines, "invoice_no"), "payment": (r.payment, "invoice_no"),
                                                  "invoice": (r.invoice, "invoice_no")})


@register("delete_invoices_cascade_lines", f"""
WITH {_GONE_SQL}
SELECT invoice_no, line_no, total FROM r_lines WHERE invoice_no NOT IN (SELECT invoice_no FROM gone)""")
def delete_invoices_cascade_lines(r):
    return _deleted_invoices(r)["lines"].select("invoice_no", "line_no", "total")


@register("delete_invoices_cascade_payments", f"""
WITH {_GONE_SQL}
SELECT invoice_no, amount FROM r_payment WHERE invoice_no NOT IN (SELECT invoice_no FROM gone)""")
def delete_invoices_cascade_payments(r):
    return _deleted_invoices(r)["payment"].select("invoice_no", "amount")


@register("delete_customers_cascade_ledger", """
SELECT invoice_no, step, customer_id, amount FROM r_ledger
WHERE customer_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')""")
def delete_customers_cascade_ledger(r):
    gone = r.raw("customer").filter(F.col("c_mktsegment") == "HOUSEHOLD").select(F.col("c_custkey").alias("id"))
    return ld.delete_cascade(gone, "id", {"ledger": (r.ledger_entries, "customer_id")})["ledger"].select(
        "invoice_no", "step", "customer_id", "amount")


@register("delete_customers_set_null", """
SELECT invoice_no, CASE WHEN customer_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD')
                        THEN NULL ELSE customer_id END AS customer_id
FROM r_invoice""")
def delete_customers_set_null(r):
    gone = r.raw("customer").filter(F.col("c_mktsegment") == "HOUSEHOLD").select(
        F.col("c_custkey").alias("id"))
    return ld.delete_set_null(gone, "id", r.invoice.select("invoice_no", "customer_id"), "customer_id")


@register("normalise_inventory", """
SELECT product_id, safety_level, COALESCE(unit, 'pcs') AS unit, COALESCE(category, 'General') AS category
FROM r_inventory""")
def normalise_inventory(r):
    return ld.normalise_inventory(r.inventory).select("product_id", "safety_level", "unit", "category")
