"""Catalog: the declared key graph (Q-3, M-8, M-9).  Every table of the
schema, restock rows and supplier invoices included."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.operators import references as ref
from tillbook.operators import stock as st

_ORDER = ["added_date", "ref_order", "ref_line", "product_id", "quantity_added"]


def tables(r) -> dict[str, DataFrame]:
    add_item, supplier_invoice, _rejects = st.restock(r.add_item, r.inventory, r.product, None, _ORDER)
    return {"supplier": r.supplier, "customer": r.customer, "product": r.product, "inventory": r.inventory,
            "add_item": add_item, "invoice": r.invoice, "supplier_invoice": supplier_invoice, "lines": r.lines,
            "payment": r.payment, "ledger": r.ledger_entries}


# parents that are missing: some suppliers, customers, products and invoices
_CHILDREN = (("product", "supplier_id", "r_product", "supplier_id", "supplier"),
             ("inventory", "product_id", "r_inventory", "product_id", "product"),
             ("add_item", "product_id", "r_add_item", "product_id", "product"),
             ("add_item", "supplier_id", "r_restocked", "supplier_id", "supplier"),
             ("invoice", "customer_id", "r_invoice", "customer_id", "customer"),
             ("supplier_invoice", "supplier_id", "r_restocked", "supplier_id", "supplier"),
             ("supplier_invoice", "product_id", "r_add_item", "product_id", "product"),
             ("lines", "invoice_no", "r_lines", "invoice_no", "invoice"),
             ("lines", "product_id", "r_lines", "product_id", "product"),
             ("payment", "invoice_no", "r_payment", "invoice_no", "invoice"),
             ("ledger", "customer_mobile", "r_ledger_e", "customer_mobile", "mobile"))
_PARENTS_SQL = """
r_restocked AS (SELECT a.product_id, p.supplier_id FROM r_add_item a JOIN r_product p ON a.product_id = p.pro_id),
there_supplier AS (SELECT id AS k FROM r_supplier WHERE id % 7 <> 3),
there_customer AS (SELECT id AS k FROM r_customer WHERE id % 11 <> 5),
there_mobile AS (SELECT mobile AS k FROM r_customer WHERE id % 11 <> 5),
there_product AS (SELECT pro_id AS k FROM r_product WHERE pro_id % 13 <> 2),
there_invoice AS (SELECT invoice_no AS k FROM r_invoice WHERE invoice_no % 17 <> 9)"""


@register("reference_violations", f"WITH {_PARENTS_SQL}" + "\nUNION ALL\n".join(f"""
SELECT '{child}' AS child, '{column}' AS "column", CAST({col} AS VARCHAR) AS value, CAST(COUNT(*) AS BIGINT) AS rows
FROM {source} WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT k FROM there_{parent}) GROUP BY {col}"""
                                                                     for child, column, source, col, parent in _CHILDREN))
def reference_violations(r):
    t = tables(r)
    missing = {"supplier": "id % 7 <> 3", "customer": "id % 11 <> 5", "product": "pro_id % 13 <> 2",
               "invoice": "invoice_no % 17 <> 9"}
    # a table is whole as a child and has gaps as a parent
    found = []
    for k in ref.REFERENCES:
        pair = {k.child: t[k.child], k.parent: t[k.parent].filter(missing[k.parent])}
        found.append(ref.violations(pair, (k,)))
    return reduce(DataFrame.unionByName, found)


def _left(changed: dict[str, DataFrame], keys: dict[str, str]) -> DataFrame:
    """Rows left of every changed table per key, and those without a supplier."""
    parts = []
    for name, df in changed.items():
        none = F.col("supplier_id").isNull() if "supplier_id" in df.columns else F.lit(False)
        parts.append(df.groupBy(F.col(keys[name]).cast("long").alias("key")).agg(
            F.count(F.lit(1)).alias("rows"), F.count(F.when(none, 1)).alias("no_supplier"))
            .withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


@register("delete_suppliers_everywhere", f"""
WITH {_PARENTS_SQL},
gone AS (SELECT id FROM r_supplier WHERE id % 3 = 1)
SELECT 'supplier' AS table_name, id AS key, CAST(1 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS no_supplier
FROM r_supplier WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'product', pro_id, 1, CASE WHEN supplier_id IN (SELECT id FROM gone) THEN 1 ELSE 0 END FROM r_product
UNION ALL
SELECT t, product_id, COUNT(*), COUNT(CASE WHEN supplier_id IN (SELECT id FROM gone) THEN 1 END)
FROM r_restocked, (VALUES ('add_item'), ('supplier_invoice')) v(t) GROUP BY t, product_id""")
def delete_suppliers_everywhere(r):
    out = ref.delete(tables(r), "supplier", r.supplier.filter("id % 3 = 1").select("id"), "id")
    return _left(out, {"supplier": "id", "product": "pro_id", "add_item": "product_id", "supplier_invoice": "product_id"})


@register("delete_products_everywhere", f"""
WITH {_PARENTS_SQL},
gone AS (SELECT product_id FROM r_inventory WHERE availability = 1)
SELECT 'product' AS table_name, pro_id AS key, CAST(1 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS no_supplier
FROM r_product WHERE pro_id NOT IN (SELECT product_id FROM gone)
UNION ALL
SELECT 'inventory', product_id, 1, 0 FROM r_inventory WHERE product_id NOT IN (SELECT product_id FROM gone)
UNION ALL
SELECT 'lines', invoice_no, COUNT(*), 0 FROM r_lines WHERE product_id NOT IN (SELECT product_id FROM gone) GROUP BY invoice_no
UNION ALL
SELECT t, product_id, COUNT(*), 0 FROM r_restocked, (VALUES ('add_item'), ('supplier_invoice')) v(t)
WHERE product_id NOT IN (SELECT product_id FROM gone) GROUP BY t, product_id""")
def delete_products_everywhere(r):
    gone = r.inventory.filter("availability = 1").select("product_id")
    out = ref.delete(tables(r), "product", gone, "pro_id")
    return _left(out, {"product": "pro_id", "inventory": "product_id", "lines": "invoice_no", "add_item": "product_id",
                       "supplier_invoice": "product_id"})


# a customer's ledger goes with them, their invoices stay without them
@register("delete_customers_everywhere", """
WITH gone AS (SELECT id, mobile FROM r_customer WHERE id % 4 = 2)
SELECT 'customer' AS table_name, id AS key, CAST(1 AS BIGINT) AS rows FROM r_customer WHERE id NOT IN (SELECT id FROM gone)
UNION ALL
SELECT 'invoice', CASE WHEN customer_id IN (SELECT id FROM gone) THEN NULL ELSE customer_id END, COUNT(*)
FROM r_invoice GROUP BY 2
UNION ALL
SELECT 'ledger', customer_id, COUNT(*) FROM r_ledger_e WHERE customer_mobile NOT IN (SELECT mobile FROM gone) GROUP BY 2""")
def delete_customers_everywhere(r):
    out = ref.delete(tables(r), "customer", r.customer.filter("id % 4 = 2").select("id"), "id")
    return _left(out, {"customer": "id", "invoice": "customer_id", "ledger": "customer_id"}).select(
        "table_name", "key", "rows")
