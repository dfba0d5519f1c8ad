"""Catalog: invoice documents, combined and printed lines (A-11, G-18, G-19,
G-22, W-4)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.operators import documents as dc
from tillbook.operators.posting import build_lines

_ITEMS_SQL = """
it AS (SELECT l.invoice_no, l.line_no, l.product_id, l.quantity, p.pro_name AS name, i.unit, l.price, l.discount, l.total,
              row_number() OVER (PARTITION BY l.invoice_no ORDER BY l.line_no, l.product_id, l.quantity) AS pos
       FROM r_lines l JOIN r_product p ON l.product_id = p.pro_id LEFT JOIN r_inventory i ON l.product_id = i.product_id)"""
PAGE = 3


def built_lines(r):
    """Lines as posted, with the unit from inventory (P-2)."""
    return build_lines(r.lines.drop("total"), r.inventory)



@register("invoice_document_pages", f"""
WITH {_ITEMS_SQL},
pg AS (SELECT invoice_no, CAST(floor((pos - 1) / {PAGE}) AS INTEGER) AS page, COUNT(*) AS n,
              SUM(quantity) AS q, arg_min(name, pos) AS first_item FROM it GROUP BY 1, 2)
SELECT i.invoice_no, i.customer_name, i.final_amount, COALESCE(pg.page, 0) AS page,
       CAST(COALESCE(pg.n, 0) AS INTEGER) AS n_items, CAST(COALESCE(pg.q, 0) AS BIGINT) AS items_quantity,
       CAST(COUNT(*) OVER (PARTITION BY i.invoice_no) AS INTEGER) AS page_count,
       CAST(COALESCE(SUM(pg.n) OVER (PARTITION BY i.invoice_no), 0) AS BIGINT) AS item_count, pg.first_item
FROM r_invoice i LEFT JOIN pg ON i.invoice_no = pg.invoice_no""")
def invoice_document_pages(r):
    docs = dc.invoice_documents(r.invoice, built_lines(r), r.product, PAGE)
    return docs.select(
        "invoice_no", "customer_name", "final_amount", "page", "page_count", "item_count",
        F.size("items").alias("n_items"),
        F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["quantity"])
         .alias("items_quantity"),
        F.get(F.col("items"), 0)["name"].alias("first_item"))


@register("invoice_document_json", f"""
WITH {_ITEMS_SQL},
pg AS (SELECT invoice_no, CAST(floor((pos - 1) / {PAGE}) AS INTEGER) AS page,
              COUNT(*) AS n,
              string_agg('{{"name":"' || name || '","quantity":' || CAST(quantity AS VARCHAR)
                         || ',"unit":' || COALESCE('"' || unit || '"', 'null') || ',"price":' || CAST(price AS VARCHAR) || ',"discount":' || CAST(discount AS VARCHAR)
                         || ',"total":' || CAST(total AS VARCHAR) || '}}', ',' ORDER BY pos) AS items
       FROM it GROUP BY 1, 2)
SELECT i.invoice_no, COALESCE(pg.page, 0) AS page,
       '{{"invoice_no":' || CAST(i.invoice_no AS VARCHAR) || ',"customer_name":"' || i.customer_name
       || '","customer_mobile":"' || i.customer_mobile || '","date":"' || strftime(i.date, '%Y-%m-%d')
       || '","final_amount":' || CAST(i.final_amount AS VARCHAR) || ',"status":"' || i.status
       || '","payment_status":"' || i.payment_status || '","page":' || CAST(COALESCE(pg.page, 0) AS VARCHAR)
       || ',"page_count":' || CAST(COUNT(*) OVER (PARTITION BY i.invoice_no) AS VARCHAR)
       || ',"item_count":' || CAST(COALESCE(SUM(pg.n) OVER (PARTITION BY i.invoice_no), 0) AS VARCHAR)
       || ',"items":[' || COALESCE(pg.items, '') || ']}}' AS json
FROM r_invoice i LEFT JOIN pg ON i.invoice_no = pg.invoice_no""")
def invoice_document_json(r):
    return dc.documents_json(dc.invoice_documents(r.invoice, built_lines(r), r.product, PAGE))


@register("number_lines", """
SELECT invoice_no, line_no, product_id, quantity,
       CAST(row_number() OVER (PARTITION BY invoice_no ORDER BY line_no, product_id, quantity) AS BIGINT) AS serial
FROM r_lines""")
def number_lines(r):
    return dc.number_lines(r.lines).select("invoice_no", "line_no", "product_id", "quantity", "serial")


@register("combine_lines", f"""
WITH {_ITEMS_SQL}
SELECT invoice_no, lower(name) AS name_key, arg_min(name, pos) AS name, CAST(SUM(quantity) AS BIGINT) AS quantity,
       arg_min_null(unit, pos) AS unit, price, arg_min(discount, pos) AS discount,
       CAST(SUM(total) AS DECIMAL(18,2)) AS total, CAST(SUM(discount) AS DECIMAL(18,2)) AS discount_sum
FROM it GROUP BY invoice_no, lower(name), price""")
def combine_lines(r):
    return dc.combine_lines(dc.document_items(built_lines(r), r.product))


def print_lines(r):
    li = r.raw("lineitem")
    price = r.product.select(F.col("pro_id").alias("l_partkey"), "selling_price")
    return (li.join(price, "l_partkey").select(
        F.col("l_orderkey").alias("invoice_no"), F.col("l_quantity").cast("int").alias("quantity"),
        F.col("selling_price").alias("price"),
        (F.col("l_discount") * 100).cast("decimal(5,2)").alias("discount_pct")))


@register("invoice_print_totals", """
WITH pl AS (SELECT l_orderkey AS invoice_no, CAST(l_quantity AS INTEGER) AS quantity, p.selling_price AS price,
                   CAST(l_discount * 100 AS DECIMAL(5,2)) AS pct
            FROM lineitem JOIN r_product p ON l_partkey = p.pro_id),
t AS (SELECT invoice_no, SUM(quantity * price * (100 - pct) * CAST(0.01 AS DECIMAL(3,2))) AS t FROM pl GROUP BY 1)
SELECT invoice_no, CAST(round(t, 2) AS DECIMAL(18,2)) AS total_excl_gst,
       CAST(round(t * CAST(0.10 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS gst,
       CAST(round(t * CAST(1.10 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS total_incl_gst
FROM t""")
def invoice_print_totals(r):
    return dc.invoice_print_totals(print_lines(r))


@register("invoice_draft_totals", """
WITH s AS (SELECT invoice_no, CAST(SUM(total) AS DECIMAL(18,2)) AS lines_total FROM r_lines GROUP BY 1),
j AS (SELECT s.*, i.discount_percent, i.total_paid,
             CAST(round(s.lines_total * i.discount_percent * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) AS d
      FROM s JOIN r_invoice i ON s.invoice_no = i.invoice_no)
SELECT invoice_no, lines_total, d AS header_discount, CAST(lines_total - d AS DECIMAL(18,2)) AS final_amount,
       total_paid FROM j""")
def invoice_draft_totals(r):
    return dc.invoice_draft_totals(r.lines, r.invoice)
