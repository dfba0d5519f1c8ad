"""Catalog: data-quality rules and invoice validation (Q-1..Q-8, P-1)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.functions import rules as R
from tillbook.operators import quality as q

_INV_NN = ["quantity", "unit", "category", "hscode", "expiry_date"]


@register("not_null_violations", " UNION ALL ".join(
    f"SELECT product_id, '{c} is NULL' AS reason FROM r_inventory WHERE {c} IS NULL" for c in _INV_NN))
def not_null_violations(r):
    return q.check_not_null(r.inventory, _INV_NN).select("product_id", "reason")


@register("positive_violations", """
SELECT invoice_no, 'total_paid must be > 0' AS reason FROM r_invoice1 WHERE paid0 <= 0
UNION ALL
SELECT invoice_no, 'discount must be > 0' FROM r_invoice1 WHERE discount <= 0""")
def positive_violations(r):
    return q.check_positive(r.invoice_draft, ["total_paid", "discount"]).select("invoice_no", "reason")


@register("fk_violations", """
SELECT pro_id, supplier_id, 'supplier_id has no parent' AS reason FROM r_product
WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM r_supplier)""")
def fk_violations(r):
    return q.check_fk(r.product, "supplier_id", r.supplier, "id").select("pro_id", "supplier_id", "reason")


@register("line_fk_violations", """
SELECT invoice_no, line_no, product_id, 'invoice_no has no parent' AS reason FROM r_lines
WHERE invoice_no NOT IN (SELECT invoice_no FROM r_invoice WHERE customer_id IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY'))""")
def line_fk_violations(r):
    # invoices of the MACHINERY customers are missing: their lines have no parent
    there = r.raw("customer").filter("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("customer_id"))
    parents = r.invoice.join(there, "customer_id", "left_semi")
    return q.check_fk(r.lines, "invoice_no", parents, "invoice_no").select(
        "invoice_no", "line_no", "product_id", "reason")


@register("domain_violations", """
SELECT pro_id AS id, 'category not in allowed values' AS reason FROM r_product
WHERE category NOT IN ('Electronics', 'Clothing', 'Home & Kitchen', 'Sports', 'Beauty')
UNION ALL
SELECT pro_id, 'safety_level not between 1 and 5' FROM r_product
WHERE NOT (CAST(safety_level AS INTEGER) BETWEEN 1 AND 5)
UNION ALL
SELECT invoice_no, 'terms not in allowed values' FROM r_invoice
WHERE terms NOT IN ('5', '10', '15', '20', '30')
UNION ALL
SELECT invoice_no, 'transaction_type not in allowed values' FROM r_ledger
WHERE transaction_type NOT IN ('Debit', 'Credit')""")
def domain_violations(r):
    p = r.product.withColumn("id", F.col("pro_id"))
    a = q.check_domain(p, "category", R.FORM_CATEGORIES).select("id", "reason")
    lo, hi = R.FORM_SAFETY_LEVELS
    b = q.check_domain(p.withColumn("safety_level", F.col("safety_level").cast("int")),
                       "safety_level", lo=lo, hi=hi).select("id", "reason")
    c = (q.check_domain(r.invoice, "terms", R.FORM_TERMS_DAYS)
         .select(F.col("invoice_no").alias("id"), "reason"))
    d = (q.check_domain(r.ledger, "transaction_type", R.TRANSACTION_TYPES)
         .select(F.col("invoice_no").alias("id"), "reason"))
    return a.unionByName(b).unionByName(c).unionByName(d)


@register("unique_violations", """
SELECT pro_name, CAST(COUNT(*) AS BIGINT) AS rows_with_name FROM r_product
WHERE pro_name IN (SELECT pro_name FROM r_product GROUP BY pro_name HAVING COUNT(*) > 1)
GROUP BY pro_name""")
def unique_violations(r):
    return (q.check_unique(r.product, "pro_name").groupBy("pro_name")
            .agg(F.count(F.lit(1)).alias("rows_with_name")))


# mobiles cut to eight digits repeat; names, mobiles and amounts made too large for their columns
@register("unique_mobile_violations", """
SELECT right(m, 2) AS mobile FROM (SELECT mobile AS m FROM r_customer)
WHERE right(m, 2) IN (SELECT right(mobile, 2) FROM r_customer GROUP BY 1 HAVING COUNT(*) > 1)""")
def unique_mobile_violations(r):
    return q.check_unique(r.customer.withColumn("mobile", F.right("mobile", F.lit(2))), "mobile").select("mobile")


@register("length_violations", """
SELECT id, 'name longer than 18' AS reason FROM r_customer WHERE length(name || CASE WHEN id % 3 = 0 THEN ' & Sons' ELSE '' END) > 18
UNION ALL
SELECT id, 'mobile longer than 15' FROM r_customer WHERE id % 4 = 0""")
def length_violations(r):
    c = r.customer.withColumns({
        "name": F.concat("name", F.when(F.col("id") % 3 == 0, " & Sons").otherwise("")),
        "mobile": F.when(F.col("id") % 4 == 0, F.concat(F.lit("+00000"), "mobile")).otherwise(F.col("mobile"))})
    return q.check_length(c, {"name": 18, "mobile": 15}).select("id", "reason")


@register("money_range_violations", """
SELECT invoice_no, 'final_amount out of NUMERIC(10,2) range' AS reason FROM r_invoice
WHERE abs(CAST(final_amount AS DECIMAL(18,2)) * 1000) >= 100000000""")
def money_range_violations(r):
    big = r.invoice.withColumn("final_amount", (F.col("final_amount") * 1000).cast("decimal(18,2)"))
    return q.check_length(big, {}, money=["final_amount"]).select("invoice_no", "reason")


@register("required_violations", """
SELECT ord, 'mobile must be digits' AS reason FROM (
  SELECT o_orderkey AS ord,
         CASE WHEN o_orderkey % 3 = 0 THEN '  ' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || ' '
              ELSE lpad(CAST(o_custkey AS VARCHAR), 10, '0') END AS mobile FROM orders)
WHERE NOT regexp_full_match(mobile, '[0-9]+')""")
def required_violations(r):
    from tillbook.catalog.loads import customer_file
    return q.check_required(customer_file(r), ["name", "mobile"], digits=["mobile"]).select("ord", "reason")


@register("reconcile_totals", """
SELECT i.invoice_no, i.total_amount, CAST(COALESCE(s.t, 0) AS DECIMAL(18,2)) AS lines_total,
       CAST(i.total_amount - COALESCE(s.t, 0) AS DECIMAL(18,2)) AS difference
FROM r_invoice i LEFT JOIN (SELECT invoice_no, SUM(total) AS t FROM r_lines GROUP BY invoice_no) s
  ON i.invoice_no = s.invoice_no
WHERE abs(i.total_amount - COALESCE(s.t, 0)) > 0.01""")
def reconcile_totals(r):
    return q.reconcile_totals(r.invoice, r.lines)


_VALIDATE_SQL = """
WITH h AS (SELECT i.*, i.invoice_no IN (SELECT invoice_no FROM r_lines) AS has_lines FROM r_invoice1 i),
t AS (SELECT *, CASE
   WHEN date IS NULL OR terms IS NULL OR trim(terms) = '' OR sale_by IS NULL OR trim(sale_by) = ''
        OR customer_mobile IS NULL OR trim(customer_mobile) = '' OR customer_name IS NULL
        OR trim(customer_name) = '' OR NOT has_lines THEN 'required field missing or no product'
   WHEN abs(total_amount * discount_percent / 100 - discount) > 0.01 THEN 'discount does not match percentage'
   WHEN abs(total_amount - discount - final_amount) > 0.01 THEN 'final amount does not match total minus discount'
   WHEN payment_method IN ('cash', 'credit_card', 'bank_transfer', 'upi') AND final_amount > 0 AND paid0 <= 0
        THEN 'paid method needs total_paid > 0' END AS reason FROM h)"""


@register("validate_invoices_rejects", _VALIDATE_SQL + """
SELECT invoice_no, reason FROM t WHERE reason IS NOT NULL""")
def validate_invoices_rejects(r):
    _ok, rej = q.validate_invoices(r.invoice_draft, r.lines)
    return rej.select("invoice_no", "reason")


@register("validate_invoices_ok", _VALIDATE_SQL + """
SELECT invoice_no, CASE WHEN payment_method = 'unpaid' THEN CAST(0 AS DECIMAL(10,2)) ELSE paid0 END AS total_paid
FROM t WHERE reason IS NULL""")
def validate_invoices_ok(r):
    ok, _rej = q.validate_invoices(r.invoice_draft, r.lines)
    return ok.select("invoice_no", "total_paid")
