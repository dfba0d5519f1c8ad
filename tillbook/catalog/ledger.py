"""Catalog: invoice posting and the customer ledger (P-2, P-5..P-12, W-1,
W-2, G-15..G-17, G-21, J-13, U-1..U-3, and the whole posting job)."""

from pyspark.sql import functions as F

from tillbook.catalog import register
from tillbook.catalog.oracle_views import AS_OF as D
from tillbook.catalog.stock import moved_sql, raised_safety, served_sql
from tillbook.operators import ledger as lg
from tillbook.operators import posting as ps
from tillbook.sources.fixtures import AS_OF

# ---- posting ------------------------------------------------------------------


@register("post_payment_status", """
SELECT invoice_no, payment_method, total_paid, payment_status, status FROM r_invoice""")
def post_payment_status(r):
    return ps.apply_payment_status(r.invoice_draft).select(
        "invoice_no", "payment_method", "total_paid", "payment_status", "status")


@register("payment_status_simple", """
SELECT invoice_no, paid0 AS total_paid,
       CASE WHEN paid0 IS NULL OR paid0 = 0 THEN 'Unpaid' ELSE 'Paid' END AS payment_status,
       CASE WHEN paid0 IS NULL OR paid0 = 0 THEN 'Pending' ELSE 'Completed' END AS status
FROM r_invoice1""")
def payment_status_simple(r):
    return ps.apply_payment_status(r.invoice_draft, "simple").select(
        "invoice_no", "total_paid", "payment_status", "status")


@register("post_payments", "SELECT * FROM r_payment")
def post_payments(r):
    return r.payment


@register("settle_invoices", """
SELECT i.invoice_no, CAST(COALESCE(p.paid, 0) AS DECIMAL(18,2)) AS paid_amount,
       CASE WHEN COALESCE(p.paid, 0) >= i.total_amount THEN 'Paid'
            WHEN COALESCE(p.paid, 0) > 0 THEN 'Partially Paid' ELSE 'Unpaid' END AS settlement_status
FROM r_invoice i
LEFT JOIN (SELECT invoice_no, SUM(paid0) AS paid FROM r_invoice1 WHERE paid0 > 0 GROUP BY invoice_no) p
  ON i.invoice_no = p.invoice_no""")
def settle_invoices(r):
    # payments as submitted (before the live status rule): the draft's paid amounts
    pays = (r.invoice_draft.filter(F.col("total_paid") > 0)
            .select("invoice_no", F.col("total_paid").alias("amount")))
    return ps.settle_invoices(r.invoice, pays, basis="total")


@register("backfill_unpaid", """
SELECT invoice_no, date AS invoice_date, final_amount AS amount, customer_name,
       'Pending' AS payment_mode, 'Pending' AS status, customer_id
FROM r_invoice WHERE payment_status = 'Unpaid'""")
def backfill_unpaid(r):
    return ps.backfill_unpaid(r.invoice)


@register("backfill_paid", """
SELECT invoice_no, date AS invoice_date, total_paid AS amount, customer_name,
       'Cash' AS payment_mode, 'Completed' AS status, customer_id
FROM r_invoice WHERE total_paid > 0""")
def backfill_paid(r):
    return ps.backfill_paid(r.invoice)


# existing payments: those of invoices dated before 2000; the batch: every invoice
@register("upsert_payments", """
WITH base AS (SELECT * FROM r_payment WHERE invoice_date < DATE '2000-01-01'),
src AS (SELECT i.invoice_no, i.date, i.final_amount, i.payment_method, c.name AS cname
        FROM r_invoice i LEFT JOIN r_customer c ON i.customer_id = c.id
        WHERE i.customer_id IS NOT NULL AND i.payment_status = 'Paid' AND i.final_amount > 0)
SELECT b.invoice_no, b.invoice_date,
       CASE WHEN s.invoice_no IS NOT NULL THEN s.final_amount ELSE b.amount END AS amount,
       b.customer_name,
       CASE WHEN s.invoice_no IS NOT NULL THEN s.payment_method ELSE b.payment_mode END AS payment_mode,
       CASE WHEN s.invoice_no IS NOT NULL THEN 'Completed' ELSE b.status END AS status,
       b.customer_id
FROM base b LEFT JOIN src s ON b.invoice_no = s.invoice_no
UNION ALL
SELECT s.invoice_no, s.date, s.final_amount, s.cname, s.payment_method, 'Completed', CAST(NULL AS BIGINT)
FROM src s WHERE s.invoice_no NOT IN (SELECT invoice_no FROM base)""")
def upsert_payments(r):
    base = r.payment.filter(F.col("invoice_date") < F.lit("2000-01-01").cast("date"))
    out, _rejects = ps.upsert_payments(r.invoice, base, r.customer)
    return out


# every tenth customer is unknown to the invoices
@register("upsert_payments_rejects", """
SELECT invoice_no, 'customer is NULL' AS reason FROM r_invoice WHERE customer_id % 10 = 0""")
def upsert_payments_rejects(r):
    invoice = r.invoice.withColumn("customer_id", F.when(F.col("customer_id") % 10 != 0, F.col("customer_id")))
    _out, rejects = ps.upsert_payments(invoice, r.payment, r.customer)
    return rejects


# ---- ledger -------------------------------------------------------------------

@register("post_ledger", "SELECT * FROM r_ledger")
def post_ledger(r):
    return r.ledger


@register("running_balance_account", """
SELECT transaction_date, customer_mobile, invoice_no, step, amount, transaction_type,
       CAST(SUM(CASE WHEN transaction_type = 'Credit' THEN amount
                     WHEN transaction_type = 'Debit' THEN -amount ELSE 0 END)
            OVER (PARTITION BY customer_mobile ORDER BY transaction_date, invoice_no, step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
FROM r_ledger_e""")
def running_balance_account(r):
    entries = r.ledger_entries
    return lg.running_balance(entries, "account").select(
        "transaction_date", "customer_mobile", "invoice_no", "step", "amount",
        "transaction_type", "balance")


# opening balances: the receivable balance each customer had before 2000
@register("post_ledger_with_opening", """
WITH opening AS (
  SELECT customer_mobile, SUM(CASE WHEN transaction_type = 'Debit' THEN amount ELSE -amount END) AS ob
  FROM r_ledger_e WHERE transaction_date < TIMESTAMP '2000-01-01' GROUP BY customer_mobile)
SELECT e.invoice_no, e.step,
       CAST(COALESCE(o.ob, 0) + SUM(CASE WHEN transaction_type = 'Debit' THEN amount ELSE -amount END)
            OVER (PARTITION BY e.customer_mobile ORDER BY transaction_date, invoice_no, step
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
FROM r_ledger_e e LEFT JOIN opening o ON e.customer_mobile = o.customer_mobile
WHERE e.transaction_date >= TIMESTAMP '2000-01-01'""")
def post_ledger_with_opening(r):
    cutoff = F.lit("2000-01-01").cast("date")
    old = r.ledger.filter(F.col("transaction_date") < cutoff.cast("timestamp_ntz"))
    opening = lg.ledger_balance(old).withColumnRenamed("balance", "opening_balance")
    batch = r.invoice.filter(F.col("date") >= cutoff)
    return lg.post_ledger(batch, opening).select("invoice_no", "step", "balance")


@register("latest_balance", """
SELECT customer_mobile, balance FROM (
  SELECT customer_mobile, balance, row_number() OVER (PARTITION BY customer_mobile
         ORDER BY transaction_date DESC, invoice_no DESC, step DESC) AS rn FROM r_ledger)
WHERE rn = 1""")
def latest_balance(r):
    return lg.latest_balance(r.ledger)


@register("ledger_balance", """
SELECT c.mobile AS customer_mobile, CAST(COALESCE(b.bal, 0) AS DECIMAL(18,2)) AS balance
FROM r_customer c LEFT JOIN (
  SELECT customer_mobile, SUM(CASE WHEN transaction_type = 'Debit' THEN amount
                                   WHEN transaction_type = 'Credit' THEN -amount ELSE 0 END) AS bal
  FROM r_ledger GROUP BY customer_mobile) b ON c.mobile = b.customer_mobile""")
def ledger_balance(r):
    return lg.ledger_balance(r.ledger_entries, customers=r.customer.select(
        F.col("mobile").alias("customer_mobile")))


@register("outstanding_unsigned", """
SELECT customer_id, CAST(SUM(amount) AS DECIMAL(18,2)) AS outstanding FROM r_ledger GROUP BY customer_id""")
def outstanding_unsigned(r):
    return lg.outstanding_unsigned(r.ledger_entries)


@register("post_ledger_single", """
WITH e AS (
  SELECT CAST(date AS TIMESTAMP) AS transaction_date, customer_mobile, customer_id, invoice_no, 0 AS step,
         CAST(CASE WHEN payment_status = 'Partially Paid' THEN final_amount - total_paid
                   ELSE final_amount END AS DECIMAL(10,2)) AS amount,
         CASE WHEN payment_status = 'Paid' THEN 'Credit' ELSE 'Debit' END AS transaction_type,
         CASE WHEN payment_status = 'Paid' THEN 'Payment Received (Full) - '
              WHEN payment_status = 'Partially Paid' THEN 'Invoice Creation (Partial Payment) - '
              ELSE 'Invoice Creation (Unpaid) - ' END
         || customer_name || ' (Invoice #' || CAST(invoice_no AS VARCHAR) || ')' AS description
  FROM r_invoice),
p AS (SELECT *, COALESCE(SUM(CASE WHEN transaction_type = 'Debit' THEN amount ELSE -amount END)
                OVER (PARTITION BY customer_mobile ORDER BY transaction_date, invoice_no, step
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM e)
SELECT transaction_date, customer_mobile, customer_id, invoice_no, step, amount, transaction_type,
       description,
       CAST(CASE WHEN transaction_type = 'Credit' THEN CASE WHEN prev = 0 THEN 0 ELSE prev - amount END
                 ELSE prev + amount END AS DECIMAL(18,2)) AS balance
FROM p""")
def post_ledger_single(r):
    return lg.post_ledger_single(r.invoice)


@register("post_ledger_flip", """
WITH led AS (SELECT * FROM r_ledger WHERE transaction_date < TIMESTAMP '2000-01-01'),
inv AS (SELECT invoice_no, customer_id, date, CAST(COALESCE(final_amount, 0) AS DECIMAL(10,2)) AS amt,
               lower(trim(payment_status)) AS st FROM r_invoice),
has_debit AS (SELECT DISTINCT invoice_no FROM led WHERE transaction_type = 'Debit'),
flip AS (SELECT invoice_no FROM inv WHERE st = 'paid' AND invoice_no IN (SELECT invoice_no FROM has_debit))
SELECT l.invoice_no, l.transaction_date, l.customer_id, l.amount,
       CASE WHEN f.invoice_no IS NOT NULL THEN 'Credit' ELSE l.transaction_type END AS transaction_type,
       CASE WHEN f.invoice_no IS NOT NULL THEN 'Payment received for invoice' ELSE l.description END AS description
FROM led l LEFT JOIN flip f ON l.invoice_no = f.invoice_no
UNION ALL
SELECT invoice_no, CAST(date AS TIMESTAMP), customer_id, amt, 'Debit', 'Unpaid invoice for customer'
FROM inv WHERE st = 'unpaid' AND invoice_no NOT IN (SELECT invoice_no FROM led)
UNION ALL
SELECT invoice_no, CAST(date AS TIMESTAMP), customer_id, amt, 'Credit', 'Paid invoice for customer'
FROM inv WHERE st = 'paid' AND invoice_no NOT IN (SELECT invoice_no FROM has_debit)""")
def post_ledger_flip(r):
    led = r.ledger.filter(F.col("transaction_date") < F.lit("2000-01-01").cast("timestamp_ntz"))
    out = lg.post_ledger_flip(r.invoice, led)
    return out.select("invoice_no", "transaction_date", "customer_id", "amount",
                      "transaction_type", "description")


# payments to log, two per unpaid invoice: first far too much (rejected, and
# changing nothing), then the invoice's full amount; and one without an amount
def _payments(r):
    unpaid = ps.backfill_unpaid(r.invoice).select("invoice_no", "invoice_date", "amount")
    big = unpaid.select((F.col("invoice_no") * 3).alias("payment_id"), "invoice_no", "invoice_date",
                        (F.col("amount") + 50000000).cast("decimal(10,2)").alias("amount"))
    full = unpaid.select((F.col("invoice_no") * 3 + 1).alias("payment_id"), "invoice_no", "invoice_date", "amount")
    none = unpaid.select((F.col("invoice_no") * 3 + 2).alias("payment_id"), "invoice_no", "invoice_date",
                         F.lit(None).cast("decimal(10,2)").alias("amount"))
    return big.unionByName(full).unionByName(none)


_PAY_SQL = """
WITH p AS (SELECT invoice_no, date AS invoice_date, final_amount AS amount, customer_id AS cid
      FROM r_invoice WHERE payment_status = 'Unpaid' AND final_amount > 0 AND customer_id IS NOT NULL),
bal AS (SELECT customer_id, SUM(CASE WHEN transaction_type = 'Debit' THEN amount
                                     WHEN transaction_type = 'Credit' THEN -amount ELSE 0 END) AS b
        FROM r_ledger_e GROUP BY customer_id),
run AS (SELECT p.*, CAST(COALESCE(bal.b, 0) - SUM(p.amount) OVER (PARTITION BY p.cid
              ORDER BY p.invoice_date, p.invoice_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
              AS DECIMAL(18,2)) AS balance
        FROM p LEFT JOIN bal ON p.cid = bal.customer_id)"""


# the full amounts of a customer's unpaid invoices never exceed the balance
@register("log_payments", _PAY_SQL + """
SELECT CAST(invoice_date AS TIMESTAMP) AS transaction_date, invoice_no, cid AS customer_id, amount,
       'Credit' AS transaction_type, 'Payment received for Invoice ' || CAST(invoice_no AS VARCHAR) AS description,
       balance
FROM run WHERE balance >= 0""")
def log_payments(r):
    credits, _rejects, _paid = lg.log_payments(_payments(r), r.invoice, r.ledger_entries)
    return credits


@register("log_payments_rejects", _PAY_SQL + """
SELECT invoice_no, CAST(amount + 50000000 AS DECIMAL(10,2)) AS amount, 'payment exceeds balance' AS reason FROM p
UNION ALL
SELECT invoice_no, NULL, 'amount must be > 0' FROM r_invoice WHERE payment_status = 'Unpaid'""")
def log_payments_rejects(r):
    _credits, rejects, _paid = lg.log_payments(_payments(r), r.invoice, r.ledger_entries)
    return rejects


@register("log_payments_paid", _PAY_SQL + "SELECT DISTINCT invoice_no FROM run WHERE balance = 0")
def log_payments_paid(r):
    _credits, _rejects, paid = lg.log_payments(_payments(r), r.invoice, r.ledger_entries)
    return paid


# one payment per invoice still due, of between half and three times its
# amount: a customer's earlier payments decide which later ones fit
def _contested(r):
    return ps.backfill_unpaid(r.invoice).select(
        F.col("invoice_no").alias("payment_id"), "invoice_no", "invoice_date",
        (F.col("amount") * (1 + F.col("invoice_no") % 6) / 2).cast("decimal(10,2)").alias("amount"))


_CONTESTED_SQL = """
WITH RECURSIVE p AS (
  SELECT invoice_no, date, CAST((CAST(final_amount * 100 AS BIGINT) * (1 + invoice_no % 6) + 1) // 2
                                / CAST(100 AS DECIMAL(5,2)) AS DECIMAL(10,2)) AS amount, customer_id AS cid,
         row_number() OVER (PARTITION BY customer_id ORDER BY date, invoice_no) AS i
  FROM r_invoice WHERE payment_status = 'Unpaid' AND final_amount > 0 AND customer_id IS NOT NULL),
bal AS (SELECT customer_id AS cid, CAST(SUM(CASE WHEN transaction_type = 'Debit' THEN amount
                                                 WHEN transaction_type = 'Credit' THEN -amount ELSE 0 END) AS DECIMAL(18,2)) AS b
        FROM r_ledger_e GROUP BY customer_id),
turn AS (
  SELECT cid, CAST(0 AS BIGINT) AS i, b AS balance, CAST(NULL AS BIGINT) AS invoice_no, CAST(NULL AS DECIMAL(10,2)) AS amount,
         FALSE AS ok FROM bal
  UNION ALL
  SELECT t.cid, p.i, CAST(CASE WHEN p.amount <= t.balance THEN t.balance - p.amount ELSE t.balance END AS DECIMAL(18,2)),
         p.invoice_no, p.amount, p.amount <= t.balance
  FROM turn t JOIN p ON p.cid = t.cid AND p.i = t.i + 1)"""


@register("log_payments_contested", _CONTESTED_SQL + """
SELECT invoice_no, cid AS customer_id, amount, balance FROM turn WHERE ok""")
def log_payments_contested(r):
    credits, _rejects, _paid = lg.log_payments(_contested(r), r.invoice, r.ledger_entries)
    return credits.select("invoice_no", "customer_id", "amount", "balance")


@register("log_payments_contested_rejects", _CONTESTED_SQL + """
SELECT invoice_no, amount, 'payment exceeds balance' AS reason FROM turn WHERE NOT ok AND invoice_no IS NOT NULL""")
def log_payments_contested_rejects(r):
    _credits, rejects, _paid = lg.log_payments(_contested(r), r.invoice, r.ledger_entries)
    return rejects


# manual entries: purchase events credited to the customer whose mobile is the user id
_ENTRIES_SQL = """
WITH rows AS (
  SELECT event_id AS entry_id, ts AS transaction_date, CAST(NULL AS BIGINT) AS invoice_no,
         CASE WHEN event_id % 11 = 0 THEN 'x' || CAST(user_id AS VARCHAR) ELSE lpad(CAST(user_id AS VARCHAR), 10, '0') END
           AS customer_mobile, amount,
         CASE WHEN event_id % 13 = 0 THEN 'Refund' WHEN event_id % 3 = 0 THEN 'Debit' ELSE 'Credit' END AS transaction_type,
         'Purchase event ' || CAST(event_id AS VARCHAR) AS description
  FROM r_payment_events),
ok AS (SELECT r.*, c.id AS customer_id FROM rows r JOIN r_customer c ON r.customer_mobile = c.mobile
       WHERE r.amount > 0 AND r.transaction_type <> 'Refund'),
latest AS (SELECT customer_id, balance FROM (
  SELECT customer_id, balance, row_number() OVER (PARTITION BY customer_id
         ORDER BY transaction_date DESC, invoice_no DESC, step DESC) AS rn FROM r_ledger) WHERE rn = 1)
SELECT ok.entry_id, ok.transaction_date, ok.invoice_no, ok.customer_id, ok.amount, ok.transaction_type,
       ok.description,
       CAST(COALESCE(latest.balance, 0) + SUM(CASE WHEN transaction_type = 'Credit' THEN amount
                                                   WHEN transaction_type = 'Debit' THEN -amount ELSE 0 END)
            OVER (PARTITION BY ok.customer_id ORDER BY ok.transaction_date, ok.entry_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance
FROM ok LEFT JOIN latest ON ok.customer_id = latest.customer_id"""


def manual_entries(r):
    e = r.payment_events
    return e.select(
        F.col("event_id").alias("entry_id"), F.col("ts").alias("transaction_date"),
        F.lit(None).cast("long").alias("invoice_no"),
        F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("x"), F.col("user_id").cast("string")))
         .otherwise(F.lpad(F.col("user_id").cast("string"), 10, "0")).alias("customer_mobile"), "amount",
        F.when(F.col("event_id") % 13 == 0, "Refund").when(F.col("event_id") % 3 == 0, "Debit").otherwise("Credit").alias("transaction_type"),
        F.concat(F.lit("Purchase event "), F.col("event_id").cast("string")).alias("description"))


@register("add_ledger_entries", _ENTRIES_SQL)
def add_ledger_entries(r):
    out, _rej = lg.add_ledger_entries(manual_entries(r), r.ledger, r.customer, r.invoice)
    return out


@register("add_ledger_rejects", """
WITH rows AS (SELECT event_id AS entry_id, amount,
                     CASE WHEN event_id % 11 = 0 THEN 'x' || CAST(user_id AS VARCHAR)
                          ELSE lpad(CAST(user_id AS VARCHAR), 10, '0') END AS customer_mobile
              FROM r_payment_events)
SELECT entry_id, CASE WHEN entry_id % 13 = 0 THEN 'invalid transaction type'
                      WHEN amount <= 0 THEN 'amount must be > 0'
                      ELSE 'customer mobile does not exist' END AS reason
FROM rows r WHERE entry_id % 13 = 0 OR amount <= 0 OR customer_mobile NOT IN (SELECT mobile FROM r_customer)""")
def add_ledger_rejects(r):
    _out, rej = lg.add_ledger_entries(manual_entries(r), r.ledger, r.customer, r.invoice)
    return rej


# entries by invoice number alone; every fifth names an invoice that does not exist
@register("add_ledger_invoice_entries", """
SELECT invoice_no AS entry_id, invoice_no, CAST(NULL AS BIGINT) AS customer_id,
       CAST(-final_amount AS DECIMAL(18,2)) AS balance
FROM r_invoice WHERE invoice_no % 5 <> 0 AND final_amount > 0""")
def add_ledger_invoice_entries(r):
    rows = r.invoice.select(
        F.col("invoice_no").alias("entry_id"), F.col("date").cast("timestamp_ntz").alias("transaction_date"),
        F.when(F.col("invoice_no") % 5 == 0, F.col("invoice_no") + 1000000000).otherwise(F.col("invoice_no")).alias("invoice_no"),
        F.lit(None).cast("string").alias("customer_mobile"), F.col("final_amount").alias("amount"),
        F.lit("Debit").alias("transaction_type"), F.lit("By invoice").alias("description"))
    out, _rej = lg.add_ledger_entries(rows, r.ledger, r.customer, r.invoice)
    return out.select("entry_id", "invoice_no", "customer_id", "balance")


# invoices of which half is paid: every second unpaid one
def _partly_paid(r):
    hit = (F.col("payment_status") == "Unpaid") & (F.col("invoice_no") % 2 == 0)
    return r.invoice.withColumns({
        "total_paid": F.when(hit, (F.col("final_amount") / 2).cast("decimal(10,2)")).otherwise(F.col("total_paid")),
        "payment_status": F.when(hit, "Partially Paid").otherwise(F.col("payment_status"))})


_PARTLY_SQL = """
WITH i AS (SELECT * REPLACE (
    CASE WHEN payment_status = 'Unpaid' AND invoice_no % 2 = 0
         THEN CAST((CAST(final_amount * 100 AS BIGINT) + 1) // 2 / CAST(100 AS DECIMAL(5,2)) AS DECIMAL(10,2))
         ELSE total_paid END AS total_paid,
    CASE WHEN payment_status = 'Unpaid' AND invoice_no % 2 = 0 THEN 'Partially Paid' ELSE payment_status END AS payment_status)
  FROM r_invoice)"""


@register("post_ledger_partial", _PARTLY_SQL + """
SELECT invoice_no, 0 AS step, final_amount AS amount, 'Debit' AS transaction_type FROM i
UNION ALL
SELECT invoice_no, 1, total_paid, 'Credit' FROM i
WHERE payment_status IN ('Paid', 'Partially Paid') AND total_paid > 0""")
def post_ledger_partial(r):
    return lg.post_ledger(_partly_paid(r)).select("invoice_no", "step", "amount", "transaction_type")


@register("post_ledger_single_partial", _PARTLY_SQL + """
SELECT invoice_no, CAST(CASE WHEN payment_status = 'Partially Paid' THEN final_amount - total_paid ELSE final_amount END
                        AS DECIMAL(10,2)) AS amount,
       CASE WHEN payment_status = 'Paid' THEN 'Credit' ELSE 'Debit' END AS transaction_type FROM i""")
def post_ledger_single_partial(r):
    return lg.post_ledger_single(_partly_paid(r)).select("invoice_no", "amount", "transaction_type")


# guard: the last 30 days' entries checked against everything posted before
@register("guard_ledger_entries", f"""
WITH new AS (SELECT * FROM r_ledger WHERE transaction_date >= CAST({D} - INTERVAL 30 DAY AS TIMESTAMP)),
old AS (SELECT * FROM r_ledger WHERE transaction_date < CAST({D} - INTERVAL 30 DAY AS TIMESTAMP)),
dup AS (SELECT invoice_no FROM new GROUP BY invoice_no HAVING COUNT(*) > 1)
SELECT invoice_no, step, transaction_type,
       CASE WHEN invoice_no IN (SELECT invoice_no FROM old) THEN 'invoice already has a transaction'
            WHEN invoice_no IN (SELECT invoice_no FROM dup) THEN 'invoice repeated in batch'
            WHEN transaction_type NOT IN ('Debit', 'Credit') THEN 'invalid transaction type'
            WHEN amount IS NULL OR amount < 0 THEN 'amount must be >= 0' END AS reason
FROM new
WHERE invoice_no IN (SELECT invoice_no FROM old) OR invoice_no IN (SELECT invoice_no FROM dup)
   OR transaction_type NOT IN ('Debit', 'Credit') OR amount IS NULL OR amount < 0""")
def guard_ledger_entries(r):
    cut = F.date_sub(F.lit(AS_OF).cast("date"), 30).cast("timestamp_ntz")
    new = r.ledger.filter(F.col("transaction_date") >= cut)
    old = r.ledger.filter(F.col("transaction_date") < cut)
    return lg.guard_ledger_entries(new, old).select("invoice_no", "step", "transaction_type", "reason")


# ---- lines and the whole posting job ------------------------------------------

@register("sale_to_lines", """
SELECT l_orderkey AS invoice_no, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
       COALESCE(i.unit, 'pcs') AS unit, i.price,
       CAST(CASE WHEN l_discount = 0 THEN 0 ELSE i.price * CAST(l_quantity AS INTEGER) * CAST(l_discount AS DECIMAL(3,2)) END
            AS DECIMAL(10,2)) AS discount,
       CAST(i.price * CAST(l_quantity AS INTEGER)
            - CAST(CASE WHEN l_discount = 0 THEN 0 ELSE i.price * CAST(l_quantity AS INTEGER) * CAST(l_discount AS DECIMAL(3,2)) END
                   AS DECIMAL(10,2)) AS DECIMAL(10,2)) AS total
FROM lineitem JOIN r_inventory i ON l_partkey = i.product_id""")
def sale_to_lines(r):
    li = r.raw("lineitem")
    inv = r.inventory.select(F.col("product_id").alias("l_partkey"), "price")
    qty = F.col("l_quantity").cast("int")
    disc = F.when(F.col("l_discount") == 0, F.lit(None)).otherwise(
        (F.col("price") * qty * F.col("l_discount").cast("decimal(3,2)")).cast("decimal(10,2)"))
    sale = li.join(inv, "l_partkey").select(
        F.col("l_orderkey").alias("invoice_no"), F.col("l_partkey").alias("product_id"),
        qty.alias("quantity"), "price", disc.alias("discount"))
    units = r.inventory.select(F.col("product_id").alias("pro_id"), "unit")
    return ps.sale_to_lines(sale, units)


@register("recompute_invoice_total", """
SELECT i.invoice_no, CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) AS total_amount,
       CAST(CAST(COALESCE(s.t, 0) AS DECIMAL(10,2)) - i.discount AS DECIMAL(10,2)) AS final_amount
FROM r_invoice i LEFT JOIN (SELECT invoice_no, SUM(total) AS t FROM r_lines GROUP BY 1) s
  ON i.invoice_no = s.invoice_no""")
def recompute_invoice_total(r):
    return ps.recompute_invoice_total(r.invoice, r.lines).select(
        "invoice_no", "total_amount", "final_amount")


@register("build_lines", """
SELECT l.invoice_no, l.line_no, l.product_id, l.quantity, l.price, l.discount, i.unit,
       CAST(l.price * l.quantity - l.discount AS DECIMAL(10,2)) AS total
FROM r_lines l JOIN r_invoice v ON l.invoice_no = v.invoice_no
LEFT JOIN r_inventory i ON l.product_id = i.product_id""")
def build_lines(r):
    return ps.build_lines(r.lines.drop("total"), r.inventory).select(
        "invoice_no", "line_no", "product_id", "quantity", "price", "discount", "unit", "total")


def _posting_job(r, **options):
    from tillbook.catalog.loads import existing_customers
    from tillbook.plans.invoice_posting import post_invoices
    return post_invoices(r.invoice_draft, r.lines.drop("total"), existing_customers(r), r.inventory,
                         raised_safety(r), **({"stock_mode": "cumulative"} | options))


_POSTING_SQL = """
WITH h AS (SELECT i.*, i.invoice_no IN (SELECT invoice_no FROM r_lines) AS has_lines FROM r_invoice1 i),
t AS (SELECT *, CASE
   WHEN NOT has_lines THEN 'required field missing or no product'
   WHEN abs(total_amount * discount_percent / 100 - discount) > 0.01 THEN 'discount does not match percentage'
   WHEN abs(total_amount - discount - final_amount) > 0.01 THEN 'final amount does not match total minus discount'
   WHEN payment_method IN ('cash', 'credit_card', 'bank_transfer', 'upi') AND final_amount > 0 AND paid0 <= 0
        THEN 'paid method needs total_paid > 0' END AS reason FROM h),
ok AS (SELECT * FROM t WHERE reason IS NULL),
items AS (SELECT l.* FROM r_lines l WHERE l.invoice_no IN (SELECT invoice_no FROM ok)),
x AS (SELECT it.invoice_no, COALESCE(inv.quantity >= SUM(it.quantity) OVER (PARTITION BY it.product_id
             ORDER BY it.invoice_no, it.line_no, it.quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             FALSE) AS line_ok
      FROM items it LEFT JOIN r_inventory inv ON it.product_id = inv.product_id),
verdict AS (SELECT invoice_no, bool_and(line_ok) AS invoice_ok FROM x GROUP BY 1),
existing AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile
             FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING')),
fresh AS (SELECT customer_mobile, min(invoice_no) AS first FROM ok
          WHERE customer_mobile NOT IN (SELECT mobile FROM existing) GROUP BY 1),
ids AS (SELECT mobile AS customer_mobile, id FROM existing
        UNION ALL SELECT customer_mobile, (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY first) FROM fresh),
acc AS (SELECT ok.*, ids.id AS cid,
               CASE WHEN payment_method = 'unpaid' THEN CAST(0 AS DECIMAL(10,2)) ELSE paid0 END AS paid1
        FROM ok JOIN verdict v ON ok.invoice_no = v.invoice_no AND v.invoice_ok
        LEFT JOIN ids ON ok.customer_mobile = ids.customer_mobile)"""


@register("post_invoice_batch", _POSTING_SQL + """
SELECT invoice_no, CAST(cid AS BIGINT) AS customer_id,
       CASE WHEN payment_method IN ('cash', 'credit_card', 'bank_transfer', 'upi') AND paid1 > 0 THEN 'Paid' ELSE 'Unpaid' END
         AS payment_status,
       CASE WHEN payment_method IN ('cash', 'credit_card', 'bank_transfer', 'upi') AND paid1 > 0 THEN paid1
            ELSE CAST(0 AS DECIMAL(10,2)) END AS total_paid
FROM acc""")
def post_invoice_batch(r):
    return _posting_job(r)["invoice"].select("invoice_no", "customer_id", "payment_status", "total_paid")


_POSTED_SQL = _POSTING_SQL + ",\n" + moved_sql(
    "SELECT product_id, quantity AS q FROM r_lines WHERE invoice_no IN (SELECT invoice_no FROM acc)", "-")


@register("post_invoice_batch_stock", _POSTED_SQL + "SELECT product_id, quantity, availability FROM inv2")
def post_invoice_batch_stock(r):
    return _posting_job(r)["inventory"].select("product_id", "quantity", "availability")


@register("post_invoice_batch_product", _POSTED_SQL + """
SELECT p.pro_id, CASE WHEN m.product_id IS NOT NULL THEN i.quantity ELSE p.quantity END AS quantity
FROM r_product p LEFT JOIN moved m ON p.pro_id = m.product_id LEFT JOIN inv2 i ON p.pro_id = i.product_id""")
def post_invoice_batch_product(r):
    return _posting_job(r)["product"].select("pro_id", "quantity")


@register("post_invoice_batch_lines", _POSTING_SQL + """
SELECT l.invoice_no, l.line_no, l.product_id, i.unit, l.total FROM r_lines l
LEFT JOIN r_inventory i ON l.product_id = i.product_id WHERE l.invoice_no IN (SELECT invoice_no FROM acc)""")
def post_invoice_batch_lines(r):
    return _posting_job(r)["lines"].select("invoice_no", "line_no", "product_id", "unit", "total")


@register("post_invoice_batch_rejects", _POSTING_SQL + """
SELECT invoice_no, reason FROM t WHERE reason IS NOT NULL
UNION ALL
SELECT ok.invoice_no, 'insufficient stock' FROM ok JOIN verdict v ON ok.invoice_no = v.invoice_no
WHERE NOT v.invoice_ok""")
def post_invoice_batch_rejects(r):
    return _posting_job(r)["rejects"]


# the job as it runs by default: invoices served in turn
_IN_TURN_SQL = "WITH RECURSIVE" + _POSTING_SQL.split("WITH", 1)[1].split("\nx AS (")[0] + served_sql("items")


@register("post_invoices_in_turn", _IN_TURN_SQL + """
SELECT l.invoice_no, l.line_no, l.product_id, l.quantity, CAST(NULL AS VARCHAR) AS reason FROM items l
WHERE l.invoice_no IN (SELECT invoice_no FROM served)
UNION ALL
SELECT invoice_no, NULL, NULL, NULL, reason FROM t WHERE reason IS NOT NULL
UNION ALL
SELECT invoice_no, NULL, NULL, NULL, 'insufficient stock' FROM ok
WHERE invoice_no NOT IN (SELECT invoice_no FROM served)""")
def post_invoices_in_turn(r):
    """Lines posted and invoices refused by the job's default mode."""
    out = _posting_job(r, stock_mode="sequential")
    return (out["lines"].select("invoice_no", "line_no", "product_id", "quantity", F.lit(None).cast("string").alias("reason"))
            .unionByName(out["rejects"].select("invoice_no", "reason"), allowMissingColumns=True))


@register("post_invoices_in_turn_stock", _IN_TURN_SQL + ",\n" + moved_sql(
    "SELECT product_id, quantity AS q FROM items WHERE invoice_no IN (SELECT invoice_no FROM served)", "-")
          + "SELECT product_id, quantity, availability FROM inv2")
def post_invoices_in_turn_stock(r):
    return _posting_job(r, stock_mode="sequential")["inventory"].select("product_id", "quantity", "availability")
