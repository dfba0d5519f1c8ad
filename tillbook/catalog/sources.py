"""Catalog: file sources and sinks exercised on data derived from the driver
tables (A-1, A-3, A-5, A-10, A-12).  Files go to a fresh folder under the
shared ``spark.checkpoint.dir``."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.catalog import register
from tillbook.catalog.loads import customer_file, existing_products, product_file
from tillbook.catalog.oracle_views import AS_OF as D
from tillbook.catalog.stock import moved_sql, raised_safety
from tillbook.operators import ledger as lg
from tillbook.operators import loads as ld
from tillbook.operators import stock as st
from tillbook.session import scratch_path
from tillbook.sources import files
from tillbook.sources.fixtures import AS_OF
from tillbook.sources.tables import Bucketed, merge

SEQ = T.StructType([T.StructField("ord", T.LongType())])


def _scratch(r, name):
    return scratch_path(r.spark, f"{name}-{uuid.uuid4().hex}")


@register("csv_customers_roundtrip", """
SELECT o.o_orderkey AS ord, c.c_name AS name,
       CASE WHEN o.o_orderkey % 3 = 0 THEN '  ' || lpad(CAST(o.o_custkey AS VARCHAR), 10, '0') || ' '
            ELSE lpad(CAST(o.o_custkey AS VARCHAR), 10, '0') END AS mobile,
       o.o_orderpriority AS address,
       lower(regexp_replace(c.c_name, '[^A-Za-z0-9]', '', 'g')) || '@example.com' AS mail
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""")
def csv_customers_roundtrip(r):
    path = _scratch(r, "customers-csv")
    customer_file(r).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    df, _bad = files.read_customers_csv(r.spark, path, ord_col=None, extra=SEQ)
    return df.select("ord", "name", "mobile", "address", "mail")


@register("csv_products_import", """
WITH base AS (SELECT p_partkey AS pro_id, p_name, p_size, CAST(p_partkey % 120 AS INTEGER) AS supplier_id,
                     CASE WHEN p_size = 50 THEN NULL ELSE 1 END AS price_ok FROM part),
rows AS (SELECT pro_id, p_size AS quantity, supplier_id, price_ok FROM base
         UNION ALL SELECT pro_id, p_size % 7, supplier_id, price_ok FROM base),
ok AS (SELECT * FROM rows WHERE price_ok IS NOT NULL AND supplier_id IN (SELECT s_suppkey FROM supplier))
SELECT pro_id, CAST(SUM(quantity) AS INTEGER) AS quantity_added FROM ok GROUP BY pro_id""")
def csv_products_import(r):
    path = _scratch(r, "products-csv")
    product_file(r).write.option("header", True).csv(path)
    rows, _malformed = files.read_products_csv(r.spark, path, ord_col=None, extra=SEQ)
    ok, _bad = ld.coerce_products(rows)
    ok, _bad2 = ld.enrich_supplier(ok, r.supplier)
    return ok.groupBy("pro_id").agg(F.sum("quantity").cast("int").alias("quantity_added")) \
        .select(F.col("pro_id").cast("long").alias("pro_id"), "quantity_added")


@register("ledger_csv_export", """
SELECT trim(CAST(t.transaction_date AS VARCHAR)) AS transaction_date, t.customer_mobile,
       COALESCE(c.name, 'Unknown') AS customer_name, CAST(t.amount AS VARCHAR) AS amount,
       t.transaction_type, CAST(t.balance AS VARCHAR) AS balance
FROM r_ledger t LEFT JOIN r_customer c ON t.customer_mobile = c.mobile""")
def ledger_csv_export(r):
    path = _scratch(r, "ledger-csv")
    files.export_ledger_csv(lg.list_ledger(r.ledger, r.customer), path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (
        "transaction_date", "customer_mobile", "customer_name", "amount", "transaction_type", "balance")])
    return r.spark.read.schema(schema).option("header", True).csv(path)


@register("replace_table_versions", """
SELECT pro_id, CAST(quantity + 1 AS INTEGER) AS quantity FROM r_product""")
def replace_table_versions(r):
    root = _scratch(r, "tables")
    table = Bucketed(f"{root}/product", "pro_id", 16)
    table.create(r.product)
    # an update that reads every bucket and overwrites it; run twice, applied once
    for _ in range(2):
        merge(r.spark, f"{root}/staging", "all", table, r.product, "pro_id",
              lambda rows, _changes: rows.withColumn("quantity", (F.col("quantity") + 1).cast("int")))
    return table.read(r.spark).select("pro_id", "quantity")


# one product of a hundred gets a new price and another supplier, stored in buckets
@register("update_touched_buckets", """
SELECT pro_id, pro_name, CASE WHEN pro_id % 100 = 0 THEN CAST(selling_price + 1 AS DECIMAL(10,2)) ELSE selling_price END
         AS selling_price,
       CASE WHEN pro_id % 100 = 0 THEN 7 ELSE supplier_id END AS supplier_id
FROM r_product""")
def update_touched_buckets(r):
    root = _scratch(r, "updated")
    table = Bucketed(f"{root}/product", "pro_id", 16)
    table.create(r.product)
    changes = r.product.filter("pro_id % 100 = 0").select(
        "pro_id", (F.col("selling_price") + 1).cast("decimal(10,2)").alias("selling_price"),
        F.lit(7).alias("supplier_id"))
    merge(r.spark, f"{root}/staging", "b1", table, changes, "pro_id",
          lambda rows, chg: ld.apply_updates(rows, chg, "pro_id"))
    return table.read(r.spark).select("pro_id", "pro_name", "selling_price", "supplier_id")


# sales and restocks of the last thirty days posted to the stored inventory, one batch each
_RECENT_SQL = moved_sql(f"""SELECT product_id, -quantity AS q FROM r_lines
  WHERE invoice_no IN (SELECT invoice_no FROM r_invoice WHERE date >= {D} - INTERVAL 30 DAY)
  UNION ALL SELECT product_id, quantity_added FROM r_add_item WHERE added_date >= CAST({D} - INTERVAL 30 DAY AS TIMESTAMP)""", "+")


@register("stored_stock_movements", f"WITH {_RECENT_SQL} SELECT product_id, quantity, availability FROM inv2")
def stored_stock_movements(r):
    root, since = _scratch(r, "stock"), F.date_sub(F.lit(AS_OF).cast("date"), 30)
    table = Bucketed(f"{root}/inventory", "product_id", 16)
    table.create(r.inventory)
    sold = r.lines.join(r.invoice.filter(F.col("date") >= since).select("invoice_no"), "invoice_no", "left_semi")
    added = r.add_item.filter(F.col("added_date") >= since.cast("timestamp_ntz"))
    merge(r.spark, f"{root}/staging", "sales", table, sold, "product_id",
          lambda rows, lines: st.apply_sales(rows, lines, raised_safety(r)).select(*r.inventory.columns))
    merge(r.spark, f"{root}/staging", "restock", table, added, "product_id",
          lambda rows, items: st.apply_restock(rows, items, raised_safety(r))[0].select(*r.inventory.columns))
    return table.read(r.spark).select("product_id", "quantity", "availability")


@register("csv_suppliers_import", """
SELECT CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS id,
       s_name AS name, 'Net ' || CAST((s_suppkey % 4 + 1) * 15 AS VARCHAR) || ' days, "quoted", a' AS terms,
       lpad(CAST(s_suppkey AS VARCHAR), 10, '9') AS mobile,
       's' || CAST(s_suppkey AS VARCHAR) || '@example.com' AS mail, s_name || ' Pvt Ltd' AS company
FROM supplier""")
def csv_suppliers_import(r):
    from tillbook.catalog.loads import supplier_file
    path = _scratch(r, "suppliers-csv")
    f = supplier_file(r).withColumn("terms", F.concat("terms", F.lit(', "quoted", a')))
    # the file's own id / timestamp columns are present and ignored by the load
    (f.withColumn("id", F.col("ord").cast("int"))
     .withColumn("timestamp", F.lit("2024-02-23 10:00:00").cast("timestamp_ntz"))
     .write.option("header", True).option("escape", '"').csv(path))
    rows, _bad = files.read_suppliers_csv(r.spark, path, ord_col=None, extra=SEQ)
    return ld.import_suppliers(rows, r.supplier)


@register("csv_ledger_import", """
SELECT transaction_date, invoice_no, CAST(NULL AS INTEGER) AS supplier_id, amount, transaction_type,
       description, balance, customer_id FROM r_ledger
UNION ALL
SELECT transaction_date, invoice_no, CAST(NULL AS INTEGER), amount, transaction_type, description, balance,
       customer_id FROM r_ledger""")
def csv_ledger_import(r):
    path = _scratch(r, "ledger-import-csv")
    cols = [f.name for f in files.LEDGER_CSV.fields]
    src = r.ledger.withColumn("supplier_id", F.lit(None).cast("int"))
    src.select(*cols).write.option("header", True).csv(path)
    incoming, _bad = files.read_ledger_csv(r.spark, path)
    root = _scratch(r, "ledger-table")
    files.append_table(src, root, "ledger", files.LEDGER_CSV)
    files.append_table(incoming, root, "ledger", files.LEDGER_CSV)
    return files.load_table(r.spark, root, "ledger")


@register("product_import_job", """
WITH base AS (SELECT p_partkey AS pro_id, p_size, CAST(p_partkey % 120 AS INTEGER) AS supplier_id FROM part),
rows AS (SELECT pro_id, p_size AS quantity, supplier_id, p_size FROM base
         UNION ALL SELECT pro_id, p_size % 7, supplier_id, p_size FROM base),
ok AS (SELECT * FROM rows WHERE p_size <> 50 AND supplier_id IN (SELECT s_suppkey FROM supplier)),
sums AS (SELECT pro_id, SUM(quantity) AS q FROM ok GROUP BY pro_id),
n AS (SELECT i.product_id,
             CAST(CASE WHEN s.q IS NOT NULL THEN COALESCE(i.quantity, 0) + s.q ELSE i.quantity END AS INTEGER) AS quantity,
             CASE WHEN p.p_size <= 25 OR s.q IS NOT NULL THEN p.p_size ELSE 1 END AS sl,
             s.q IS NOT NULL AS hit, i.availability AS old_availability
      FROM r_inventory i LEFT JOIN sums s ON i.product_id = s.pro_id
      JOIN part p ON i.product_id = p.p_partkey),
x AS (SELECT *, CASE WHEN sl = 0 THEN 1.0 ELSE CAST(quantity AS DOUBLE) / CAST(sl AS DOUBLE) END AS q_ratio FROM n)
SELECT product_id, quantity, CASE WHEN NOT hit THEN old_availability ELSE
       CAST(CASE WHEN q_ratio >= 1.0 THEN 5 WHEN q_ratio >= 0.85 THEN 4 WHEN q_ratio >= 0.50 THEN 3
                 WHEN q_ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER) END AS availability
FROM x""")
def product_import_job(r):
    from tillbook.plans.product_import import import_products_file, inventory_table, product_table
    root = _scratch(r, "retail-tables")
    product_table(root, 16).create(existing_products(r))
    inventory_table(root, 16).create(r.inventory)
    files.append_table(r.supplier, root, "supplier")
    path = _scratch(r, "products-file")
    product_file(r).write.option("header", True).csv(path)
    import_products_file(r.spark, path, root, "file-1", SEQ, 16)
    import_products_file(r.spark, path, root, "file-1", SEQ, 16)      # a rerun adds nothing
    return inventory_table(root, 16).read(r.spark).select("product_id", "quantity", "availability")


# a folder of two files with different column orders that share every mobile:
# the first row of a mobile, by file name and then position, is imported
@register("csv_customers_two_orders", """
SELECT CAST((SELECT max(c_custkey) FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING'))
            + row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS id, c_name AS name,
       lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile, 'first' AS address
FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')""")
def csv_customers_two_orders(r):
    from tillbook.catalog.loads import existing_customers
    path = _scratch(r, "customers-two-csv")
    rows = r.customer.select("id", "name", "mobile", F.lit("first").alias("address"), F.lit("x@y").alias("mail"))
    again = rows.withColumns({"name": F.concat(F.lit("again "), "name"), "address": F.lit("second")})
    # folders whose names put the first file first
    for part, df, cols in (("p=1", rows, ["name", "mobile", "address", "mail"]),
                           ("p=2", again, ["mail", "mobile", "name", "address"])):
        (df.coalesce(1).sortWithinPartitions("id").select(*cols).write.option("header", True)
         .csv(f"{path}/{part}"))
    file, _bad = files.read_customers_csv(r.spark, f"{path}/*")
    new, _skipped = ld.import_customers(file, existing_customers(r))
    return new.select("id", "name", "mobile", "address")


# two files of one folder with different column orders, and cells that are not numbers
def _mixed_ledger_folder(r):
    path = _scratch(r, "ledger-mixed-csv")
    cols = [f.name for f in files.LEDGER_CSV.fields]
    src = r.ledger.withColumn("supplier_id", F.lit(None).cast("int")).select(*cols)
    src.filter("transaction_type = 'Credit'").write.option("header", True).csv(path)
    (src.filter("transaction_type = 'Debit'").withColumn("amount", F.when(
        F.col("invoice_no") % 7 == 0, F.lit("abc")).otherwise(F.col("amount").cast("string")))
     .select(*reversed(cols)).write.mode("append").option("header", True).csv(path))
    return path


@register("csv_ledger_mixed_files", """
SELECT transaction_date, invoice_no, amount, transaction_type, balance, customer_id FROM r_ledger
WHERE transaction_type = 'Credit' OR invoice_no % 7 <> 0""")
def csv_ledger_mixed_files(r):
    rows, _bad = files.read_ledger_csv(r.spark, _mixed_ledger_folder(r))
    return rows.select("transaction_date", "invoice_no", "amount", "transaction_type", "balance", "customer_id")


@register("csv_ledger_mixed_rejects", """
SELECT 'amount is not a decimal(10,2)' AS reason, CAST(COUNT(*) AS BIGINT) AS rejected FROM r_ledger
WHERE transaction_type = 'Debit' AND invoice_no % 7 = 0""")
def csv_ledger_mixed_rejects(r):
    _rows, bad = files.read_ledger_csv(r.spark, _mixed_ledger_folder(r))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("rejected"))


@register("list_input_files", "SELECT o_orderstatus AS name FROM orders GROUP BY o_orderstatus")
def list_input_files(r):
    path = _scratch(r, "uploads")
    (r.raw("orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
     .write.partitionBy("status").option("header", True).csv(path))
    return files.list_inputs(r.spark, path).select(
        F.regexp_extract("path", "status=([^/]*)/", 1).alias("name")).distinct()
