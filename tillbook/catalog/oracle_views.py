"""The retail schema as DuckDB CTEs over the driver's raw tables.

This is the *oracle* side: plain SQL written independently of the Spark
code (which builds the same tables with the DataFrame API in
``tillbook.sources.fixtures``).  Every oracle query is ``WITH <these CTEs>
SELECT ...``; DuckDB inlines only the CTEs a query references.
"""

AS_OF = "DATE '2001-07-15'"

_CTES = {
    "r_customer": """
  SELECT c_custkey AS id, c_name AS name, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile
  FROM customer""",
    "r_supplier": """
  SELECT s_suppkey AS id, s_name AS name FROM supplier""",
    "r_product": """
  SELECT p_partkey AS pro_id, p_name AS pro_name,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.70 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS cost_price,
         CAST(p_retailprice AS DECIMAL(10,2)) AS selling_price,
         p_type AS category, CAST(p_size AS VARCHAR) AS safety_level,
         CAST(p_partkey % 120 AS INTEGER) AS supplier_id,
         CAST((p_partkey * 7) % 60 AS INTEGER) AS quantity, 'pcs' AS unit,
         DATE '2001-01-01' + CAST(p_partkey % 400 AS INTEGER) AS expiry_date,
         'HC' || CAST(p_partkey AS VARCHAR) AS hc_code
  FROM part""",
    "r_inv0": """
  SELECT p_partkey AS product_id, p_name AS product_name,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price,
         CAST(CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE (p_partkey * 7) % 60 END AS INTEGER) AS quantity,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE 'pcs' END AS unit,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS category,
         TRY_CAST(NULLIF(CAST(p_size AS VARCHAR), '') AS INTEGER) AS safety_level,
         CASE WHEN p_partkey % 7 = 0 THEN NULL
              ELSE DATE '2001-01-01' + CAST(p_partkey % 400 AS INTEGER) END AS expiry_date,
         CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 'HC' || CAST(p_partkey AS VARCHAR) END AS hscode
  FROM part""",
    "r_inventory": """
  SELECT *,
         CAST(CASE WHEN ratio >= 1.0 THEN 5 WHEN ratio >= 0.85 THEN 4 WHEN ratio >= 0.50 THEN 3
                   WHEN ratio >= 0.25 THEN 2 ELSE 1 END AS INTEGER) AS availability
  FROM (SELECT *, CASE WHEN COALESCE(safety_level, 1) = 0 THEN 1.0
                       ELSE CAST(quantity AS DOUBLE) / CAST(COALESCE(safety_level, 1) AS DOUBLE) END AS ratio
        FROM r_inv0)""",
    "r_invoice0": """
  SELECT o_orderkey AS invoice_no, o_custkey AS customer_id, c.c_name AS customer_name,
         lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_mobile,
         CAST(o_orderdate AS DATE) AS date,
         CASE o_orderkey % 5 WHEN 0 THEN '5' WHEN 1 THEN '10' WHEN 2 THEN '15' WHEN 3 THEN '20' ELSE '30' END AS terms,
         o_orderpriority AS sale_by,
         CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
         CAST((o_orderkey % 4) * 5 AS INTEGER) AS discount_percent,
         CAST(CAST(o_totalprice AS DECIMAL(10,2)) * CAST((o_orderkey % 4) * 5 AS DECIMAL(3,0))
              * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS discount,
         CASE o_orderkey % 5 WHEN 0 THEN 'cash' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'bank_transfer'
              WHEN 3 THEN 'upi' ELSE 'unpaid' END AS payment_method,
         o_orderstatus
  FROM orders LEFT JOIN customer c ON o_custkey = c.c_custkey""",
    "r_invoice1": """
  SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN final_amount
                                    WHEN 'P' THEN final_amount * 0.5 ELSE 0 END AS DECIMAL(10,2)) AS paid0
  FROM (SELECT *, CAST(total_amount - discount AS DECIMAL(10,2)) AS final_amount FROM r_invoice0)""",
    "r_invoice": """
  SELECT invoice_no, customer_id, customer_name, customer_mobile, date, terms, sale_by,
         total_amount, discount_percent, discount, final_amount, payment_method,
         CASE WHEN is_paid THEN 'Completed' ELSE 'Pending' END AS status,
         CASE WHEN is_paid THEN 'Paid' ELSE 'Unpaid' END AS payment_status,
         CASE WHEN is_paid THEN paid0 ELSE CAST(0 AS DECIMAL(10,2)) END AS total_paid
  FROM (SELECT *, COALESCE(payment_method IN ('cash', 'credit_card', 'bank_transfer', 'upi')
                           AND paid0 > 0, FALSE) AS is_paid FROM r_invoice1)""",
    "r_lines": """
  SELECT l_orderkey AS invoice_no, l_linenumber AS line_no, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity, p.selling_price AS price,
         CAST(p.selling_price * CAST(l_quantity AS INTEGER) * CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS discount,
         CAST(p.selling_price * CAST(l_quantity AS INTEGER)
              - CAST(p.selling_price * CAST(l_quantity AS INTEGER) * CAST(l_discount AS DECIMAL(3,2)) AS DECIMAL(10,2))
              AS DECIMAL(10,2)) AS total
  FROM lineitem JOIN r_product p ON l_partkey = p.pro_id""",
    "r_payment": """
  SELECT invoice_no, date AS invoice_date, total_paid AS amount, customer_name,
         payment_method AS payment_mode, payment_status AS status, customer_id
  FROM r_invoice WHERE payment_status = 'Paid' AND total_paid > 0""",
    "r_ledger_e": """
  SELECT CAST(date AS TIMESTAMP) AS transaction_date, customer_mobile, customer_id, invoice_no,
         0 AS step, final_amount AS amount, 'Debit' AS transaction_type,
         'Invoice Creation - ' || customer_name || ' (Invoice #' || CAST(invoice_no AS VARCHAR) || ')' AS description
  FROM r_invoice
  UNION ALL
  SELECT CAST(date AS TIMESTAMP) + INTERVAL 1 SECOND, customer_mobile, customer_id, invoice_no,
         1, total_paid, 'Credit',
         CASE WHEN payment_status = 'Paid' THEN 'Payment Received (Full) - '
              ELSE 'Payment Received (Partial) - ' END
         || customer_name || ' (Invoice #' || CAST(invoice_no AS VARCHAR) || ')'
  FROM r_invoice
  WHERE payment_status IN ('Paid', 'Partially Paid') AND total_paid > 0""",
    "r_ledger": """
  SELECT *, CAST(SUM(CASE WHEN transaction_type = 'Debit' THEN amount
                          WHEN transaction_type = 'Credit' THEN -amount ELSE 0 END)
                 OVER (PARTITION BY customer_mobile ORDER BY transaction_date, invoice_no, step
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
  FROM r_ledger_e""",
    "r_add_item": """
  SELECT l_orderkey AS ref_order, l_linenumber AS ref_line, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity_added, l_shipdate AS added_date
  FROM lineitem WHERE l_returnflag = 'R'""",
    "r_payment_events": """
  SELECT event_id, ts, user_id, CAST(value AS DECIMAL(10,2)) AS amount
  FROM events WHERE event_type = 'purchase'""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <retail CTEs>[, extra CTEs] <body>``."""
    ctes = dict(_CTES)
    if extra:
        ctes.update(extra)
    parts = [f"{name} AS ({sql}\n)" for name, sql in ctes.items()]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
