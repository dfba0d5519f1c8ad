"""Catalog: streaming versions (R-1..R-5), each checked against its batch
twin.  Feeds are the driver-derived tables written as sequential appends
(one per year or week) into a fresh folder under ``spark.checkpoint.dir``;
the query runs with ``availableNow`` over several micro-batches."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.loads import _CUSTOMER_FILE_SQL, customer_file, existing_customers
from tillbook.catalog.stock import moved_sql, raised_safety
from tillbook.functions import rules as R
from tillbook.streaming import streams as sm


def _feed(r, df, part, name):
    path = sm.new_root(r.spark, f"feed-{name}")
    sm.write_feed(df.withColumn("_part", part), path, "_part")
    return path, df


@register("stream_daily_sales", """
SELECT date, CAST(SUM(final_amount) AS DECIMAL(18,2)) AS sales FROM r_invoice GROUP BY date""")
def stream_daily_sales(r):
    inv = r.invoice.select("invoice_no", "date", "final_amount")
    path, like = _feed(r, inv, F.year("date"), "invoices")
    return sm.stream_daily_sales(r.spark, path, like)


_MOVES_SQL = moved_sql("SELECT product_id, -quantity AS q FROM r_lines UNION ALL "
                       "SELECT product_id, quantity_added FROM r_add_item", "+")


@register("stream_stock", f"WITH {_MOVES_SQL} SELECT product_id, quantity, availability FROM inv2")
def stream_stock(r):
    inv_dates = r.invoice.select("invoice_no", "date")
    sales = (r.lines.join(inv_dates, "invoice_no")
             .select("product_id", (-F.col("quantity")).alias("delta"),
                     F.col("date").cast("timestamp_ntz").alias("ts")))
    restock = r.add_item.select("product_id", F.col("quantity_added").alias("delta"),
                                F.col("added_date").alias("ts"))
    moves = sales.unionByName(restock)
    path, like = _feed(r, moves, F.year("ts"), "moves")
    out = sm.stream_stock(r.spark, path, like, r.inventory, raised_safety(r))
    return out.select("product_id", "quantity", "availability")


@register("stream_ledger", "SELECT * FROM r_ledger")
def stream_ledger(r):
    path, like = _feed(r, r.invoice, F.year("date"), "ledger-invoices")
    return sm.stream_ledger(r.spark, path, like)


@register("stream_payment_modes", """
SELECT CASE user_id % 4 WHEN 0 THEN 'cash' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'bank_transfer'
            ELSE 'upi' END AS payment_mode,
       CAST(COUNT(*) AS BIGINT) AS payments, CAST(SUM(amount) AS DECIMAL(18,2)) AS amount
FROM r_payment_events GROUP BY 1""")
def stream_payment_modes(r):
    m = F.col("user_id") % 4
    mode = F.when(m == 0, R.PAID_METHODS[0]).when(m == 1, R.PAID_METHODS[1]) \
        .when(m == 2, R.PAID_METHODS[2]).otherwise(R.PAID_METHODS[3])
    pay = r.payment_events.select("ts", "user_id", "amount", mode.alias("payment_mode"))
    path, like = _feed(r, pay, F.floor((F.dayofmonth("ts") - 1) / 8), "payments")
    return sm.stream_payment_modes(r.spark, path, like)


@register("stream_customers", f"""
WITH {_CUSTOMER_FILE_SQL}
SELECT mobile, ord, name, address, mail FROM firsts""")
def stream_customers(r):
    o = r.raw("orders").select(F.col("o_orderkey").alias("ord"), "o_orderdate")
    rows = customer_file(r).join(o, "ord").withColumn("_y", F.year("o_orderdate")).drop("o_orderdate")
    path = sm.new_root(r.spark, "feed-customers")
    sm.write_feed(rows.withColumnRenamed("_y", "_part"), path, "_part")
    like = rows.drop("_y")
    return sm.stream_customers(r.spark, path, like, existing_customers(r))


# customers by Spark's own de-duplication state
@register("stream_customers_within", f"""
WITH {_CUSTOMER_FILE_SQL}
SELECT mobile, CAST(COUNT(*) AS BIGINT) AS rows FROM firsts GROUP BY mobile""")
def stream_customers_within(r):
    o = r.raw("orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    rows = customer_file(r).join(o, "ord")
    path = sm.new_root(r.spark, "feed-customers-within")
    sm.write_feed(rows.withColumn("_part", F.year("ts")), path, "_part")
    # the delay covers the whole feed, so every mobile comes once, whichever row it is
    out = sm.stream_customers_within(r.spark, path, rows, existing_customers(r),
                                     sm.new_root(r.spark, "customers-within-out"), delay="10000 days")
    return out.groupBy("mobile").agg(F.count(F.lit(1)).alias("rows"))
