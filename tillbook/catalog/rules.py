"""Catalog: scalar business rules applied over whole tables (H-1..H-20)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.reports import pct_sql
from tillbook.functions import rules as R


@register("product_profit", f"""
SELECT pro_id, CAST(selling_price - cost_price AS DECIMAL(10,2)) AS net_profit,
       CAST(CASE WHEN cost_price > 0 THEN LEAST({pct_sql('selling_price', 'cost_price')}, 999.99) ELSE 0 END
            AS DECIMAL(5,2)) AS profit_pct_form,
       CAST(CASE WHEN cost_price <> 0 AND abs({pct_sql('selling_price', 'cost_price')}) < 1000
                 THEN {pct_sql('selling_price', 'cost_price')} END AS DECIMAL(5,2)) AS profit_pct_column
FROM r_product""")
def product_profit(r):
    p = r.product
    return p.select("pro_id", R.net_profit("selling_price", "cost_price").alias("net_profit"),
                    R.profit_pct("selling_price", "cost_price").alias("profit_pct_form"),
                    R.profit_pct("selling_price", "cost_price", cap=None).alias("profit_pct_column"))


@register("header_discount", """
SELECT invoice_no, discount,
       CAST(round(total_amount * discount_percent * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(10,2)) AS header_discount,
       CAST(total_amount - discount AS DECIMAL(10,2)) AS final_amount
FROM r_invoice""")
def header_discount(r):
    i = r.invoice
    return i.select("invoice_no", "discount",
                    R.header_discount("total_amount", "discount_percent").alias("header_discount"),
                    R.final_amount("total_amount", "discount").alias("final_amount"))


@register("line_amounts", """
SELECT invoice_no, line_no, product_id, quantity,
       CAST(price * quantity AS DECIMAL(10,2)) AS sale_total,
       CAST(price * quantity - discount AS DECIMAL(10,2)) AS line_total
FROM r_lines""")
def line_amounts(r):
    li = r.lines
    return li.select("invoice_no", "line_no", "product_id", "quantity",
                     R.sale_total("price", "quantity").alias("sale_total"),
                     R.line_total("price", "quantity", "discount").alias("line_total"))


@register("signed_amounts", """
SELECT invoice_no, step,
       CAST(CASE WHEN transaction_type = 'Debit' THEN amount WHEN transaction_type = 'Credit' THEN -amount
                 ELSE 0 END AS DECIMAL(10,2)) AS receivable,
       CAST(CASE WHEN transaction_type = 'Credit' THEN amount WHEN transaction_type = 'Debit' THEN -amount
                 ELSE 0 END AS DECIMAL(10,2)) AS account
FROM r_ledger_e""")
def signed_amounts(r):
    e = r.ledger
    return e.select("invoice_no", "step",
                    R.signed_amount("transaction_type", "amount", "receivable").alias("receivable"),
                    R.signed_amount("transaction_type", "amount", "account").alias("account"))


@register("ledger_text", """
SELECT invoice_no, step, strftime(transaction_date, '%Y-%m-%d') AS date_text,
       printf('%.2f', amount) AS amount_text, printf('%.2f', balance) AS balance_text
FROM r_ledger""")
def ledger_text(r):
    led = r.ledger
    return led.select("invoice_no", "step", R.iso_date("transaction_date").alias("date_text"),
                      R.money_text("amount").alias("amount_text"),
                      R.money_text("balance").alias("balance_text"))


@register("customer_text_checks", """
SELECT id, trim(name) AS name_clean, lower(trim(name)) AS name_lower,
       COALESCE(regexp_full_match(mobile, '[0-9]+'), FALSE) AS mobile_digits
FROM r_customer""")
def customer_text_checks(r):
    c = r.customer
    return c.select("id", R.clean_text("name").alias("name_clean"),
                    R.lower_text("name").alias("name_lower"),
                    R.is_digits("mobile").alias("mobile_digits"))


@register("safety_levels", """
SELECT pro_id, TRY_CAST(NULLIF(safety_level, '') AS INTEGER) AS safety_int FROM r_product""")
def safety_levels(r):
    return r.product.select("pro_id", R.safety_to_int("safety_level").alias("safety_int"))


@register("pct_line_amounts", """
SELECT l_orderkey AS invoice_no, l_linenumber AS line_no, l_partkey AS product_id,
       CAST(CAST(l_quantity AS INTEGER) * p.selling_price * (100 - CAST(l_discount * 100 AS DECIMAL(5,2)))
            * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,4)) AS amount
FROM lineitem JOIN r_product p ON l_partkey = p.pro_id""")
def pct_line_amounts(r):
    li = r.raw("lineitem")
    price = r.product.select(F.col("pro_id").alias("l_partkey"), "selling_price")
    j = li.join(price, "l_partkey")
    pct = (F.col("l_discount") * 100).cast("decimal(5,2)")
    return j.select(F.col("l_orderkey").alias("invoice_no"), F.col("l_linenumber").alias("line_no"),
                    F.col("l_partkey").alias("product_id"),
                    R.pct_line_amount(F.col("l_quantity").cast("int"), F.col("selling_price"), pct)
                    .cast("decimal(18,4)").alias("amount"))
