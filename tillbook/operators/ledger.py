"""Customer ledger: posting, running balances, look-ups (P-7..P-12, W-1, W-2,
G-15, G-20, G-21, J-5, B-14).

Balances are prefix sums per customer.  They are computed with the
skew-safe ``running_total`` (range blocks + block offsets where a customer is
too large for a task), so one customer holding a third of the ledger still
spreads over many tasks; opening balances enter with the block offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.greedy import accept_in_order
from tillbook.operators.skew import join_per_key
from tillbook.operators.windows import last_by_order, materialize, running_total

LEDGER_ORDER = ["transaction_date", "invoice_no", "step"]
BALANCE = R.WIDE_MONEY


def entries_from_invoices(invoice: DataFrame) -> DataFrame:
    """One Debit per invoice, plus a Credit when it is (partially) paid."""
    debit = F.struct(F.lit(0).alias("step"), F.lit("Debit").alias("transaction_type"),
                     F.col("final_amount").alias("amount"),
                     R.ledger_description("invoice", "customer_name", "invoice_no").alias("description"))
    credit_desc = (F.when(F.col("payment_status") == "Paid",
                          R.ledger_description("full", "customer_name", "invoice_no"))
                   .otherwise(R.ledger_description("partial", "customer_name", "invoice_no")))
    credit = F.when(F.col("payment_status").isin("Paid", "Partially Paid") & (F.col("total_paid") > 0),
                    F.struct(F.lit(1).alias("step"), F.lit("Credit").alias("transaction_type"),
                             F.col("total_paid").alias("amount"), credit_desc.alias("description")))
    both = F.filter(F.array(debit, credit), lambda e: e.isNotNull())
    return (invoice.select("invoice_no", "customer_id", "customer_mobile", "date",
                           F.inline(both))
            .select(F.timestamp_add("SECOND", F.col("step"), F.col("date").cast("timestamp_ntz"))
                    .alias("transaction_date"),
                    "customer_mobile", "customer_id", "invoice_no", "step", "amount",
                    "transaction_type", "description"))


# W-1
def running_balance(entries: DataFrame, sign: str = "receivable", key: str = "customer_mobile",
                    order: list | None = None, opening: DataFrame | None = None,
                    out: str = "balance") -> DataFrame:
    """Running balance per ``key`` in ``order``.

    ``sign='receivable'``: Debit +, Credit - (live trigger); ``'account'``:
    Credit +, Debit - (manual entry page).  ``opening`` is an optional
    ``(key, opening_balance)`` table added to every running total of the key.
    """
    order = order or LEDGER_ORDER
    signed = R.signed_amount("transaction_type", "amount", sign)
    base = None if opening is None else opening.select(key, F.col("opening_balance").alias("_run"))
    out_df = running_total(entries, [key], order, signed, "_run", base=base)
    return out_df.withColumn(out, F.col("_run").cast(BALANCE)).drop("_run")


# P-7
def post_ledger(invoice: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Ledger rows for a batch of invoices with balances per mobile.

    Debit final_amount always (step 0); Credit total_paid when 'Paid' (Full)
    or 'Partially Paid' (Partial) and paid > 0, one second later (step 1).
    The balance continues from ``opening`` (customer_mobile, opening_balance).
    """
    return running_balance(entries_from_invoices(invoice), "receivable",
                           "customer_mobile", LEDGER_ORDER, opening)


# P-8
def post_ledger_single(invoice: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Single-entry variant: Paid -> Credit final_amount; Partially Paid ->
    Debit of the unpaid rest; otherwise Debit final_amount.

    The stored balance uses the receivable sum of the entries before it
    (``prev``): Paid -> 0 when prev is 0, else prev - amount; others prev + amount.
    """
    st = F.col("payment_status")
    amount = (F.when(st == "Partially Paid", F.col("final_amount") - F.col("total_paid"))
              .otherwise(F.col("final_amount"))).cast(R.MONEY)
    ttype = F.when(st == "Paid", "Credit").otherwise("Debit")
    desc_prefix = (F.when(st == "Paid", "Payment Received (Full) - ")
                   .when(st == "Partially Paid", "Invoice Creation (Partial Payment) - ")
                   .otherwise("Invoice Creation (Unpaid) - "))
    desc = F.concat(desc_prefix, F.col("customer_name"), F.lit(" (Invoice #"),
                    F.col("invoice_no").cast("string"), F.lit(")"))
    entries = invoice.select(
        F.col("date").cast("timestamp_ntz").alias("transaction_date"), "customer_mobile",
        "customer_id", "invoice_no", F.lit(0).alias("step"), amount.alias("amount"),
        ttype.alias("transaction_type"), desc.alias("description"))
    signed = R.signed_amount("transaction_type", "amount", "receivable")
    base = None if opening is None else opening.select("customer_mobile", F.col("opening_balance").alias("_prev"))
    prev = running_total(entries, ["customer_mobile"], LEDGER_ORDER, signed, "_prev", exclusive=True, base=base)
    p = F.col("_prev")
    bal = (F.when(F.col("transaction_type") == "Credit",
                  F.when(p == 0, F.lit(0)).otherwise(p - F.col("amount")))
           .otherwise(p + F.col("amount")))
    return prev.withColumn("balance", bal.cast(BALANCE)).drop("_prev")


# P-9
def post_ledger_flip(invoice: DataFrame, ledger: DataFrame) -> DataFrame:
    """Older ledger-on-sale rule, as a new ledger version.

    Unpaid invoice: add a Debit 'Unpaid invoice for customer' unless the
    ledger already has a row for it.  Paid invoice: if a Debit exists for the
    invoice, every row of it becomes a Credit 'Payment received for invoice';
    otherwise a Credit 'Paid invoice for customer' is added.
    """
    status = F.lower(F.trim(F.col("payment_status")))
    inv = invoice.select("invoice_no", "customer_id", "date",
                         F.coalesce(F.col("final_amount"), F.lit(0)).cast(R.MONEY).alias("_amt"),
                         status.alias("_st"))
    has_row = ledger.select("invoice_no")
    has_debit = ledger.filter(F.col("transaction_type") == "Debit").select("invoice_no")
    paid = inv.filter(F.col("_st") == "paid")
    flip_keys = paid.select("invoice_no").join(has_debit, "invoice_no", "left_semi")
    flipped = (ledger.join(flip_keys.withColumn("_flip", F.lit(True)), "invoice_no", "left")
               .withColumn("transaction_type",
                           F.when(F.col("_flip"), "Credit").otherwise(F.col("transaction_type")))
               .withColumn("description",
                           F.when(F.col("_flip"), "Payment received for invoice")
                           .otherwise(F.col("description")))
               .drop("_flip"))
    new_debits = (inv.filter(F.col("_st") == "unpaid").join(has_row, "invoice_no", "left_anti")
                  .select("invoice_no", "customer_id", "date", F.col("_amt").alias("amount"),
                          F.lit("Debit").alias("transaction_type"),
                          F.lit("Unpaid invoice for customer").alias("description")))
    new_credits = (paid.join(has_debit, "invoice_no", "left_anti")
                   .select("invoice_no", "customer_id", "date", F.col("_amt").alias("amount"),
                           F.lit("Credit").alias("transaction_type"),
                           F.lit("Paid invoice for customer").alias("description")))
    added = new_debits.unionByName(new_credits).withColumnRenamed("date", "transaction_date") \
        .withColumn("transaction_date", F.col("transaction_date").cast("timestamp_ntz"))
    return flipped.unionByName(added, allowMissingColumns=True)


# P-10
def log_payments(payment: DataFrame, invoice: DataFrame, ledger: DataFrame):
    """Payments -> ledger Credits, with rejects (variant trigger).

    Reasons: no invoice number, amount <= 0 or NULL, no customer for the
    invoice, invoice already 'paid', payment exceeds the customer's
    outstanding balance.  Outstanding = receivable ledger sum (G-15 rather
    than the variant's unsigned sum) minus the payments *accepted* earlier,
    in (invoice_date, invoice_no, payment_id) order; a rejected payment
    changes nothing.  ``payment_id`` must be unique.  Returns ``(credits,
    rejects, paid_invoices)``; ``paid_invoices`` are invoices whose payment
    brings the customer's balance to 0.
    """
    if "payment_id" not in payment.columns:
        raise ValueError("payments need a payment_id: it is the order of payments of one invoice")
    inv = invoice.select("invoice_no", F.col("customer_id").alias("_cid"),
                         F.col("payment_status").alias("_ist"))
    p = payment.join(inv, "invoice_no", "left")
    reason = (F.when(F.col("invoice_no").isNull(), "invoice number missing")
              .when(F.col("amount").isNull() | (F.col("amount") <= 0), "amount must be > 0")
              .when(F.col("_cid").isNull(), "customer not found for invoice")
              .when(F.lower(F.trim(F.col("_ist"))) == "paid", "invoice already paid"))
    p = p.withColumn("_reason", reason)
    bal = ledger_balance(ledger.withColumnRenamed("customer_id", "_cid"), key="_cid")
    p = materialize(p)
    pre = p.filter(F.col("_reason").isNotNull())
    ok = materialize(join_per_key(p.filter(F.col("_reason").isNull()).drop("_reason"),
                                  bal.withColumnRenamed("balance", "_bal"), ["_cid"])
                     .withColumn("_bal", F.coalesce("_bal", F.lit(0).cast(BALANCE))))
    order = ["invoice_date", "invoice_no", "payment_id"]
    ok = ok.join(accept_in_order(ok, order, "_cid", "amount", "_bal"), order)
    exceeds = ok.filter(~F.col("accepted")).withColumn("_reason", F.lit("payment exceeds balance"))
    good = running_total(ok.filter("accepted"), ["_cid"], order, F.col("amount"), "_paid_so_far")
    good = good.withColumn("balance", (F.col("_bal") - F.col("_paid_so_far")).cast(BALANCE))
    credits = good.select(
        F.col("invoice_date").cast("timestamp_ntz").alias("transaction_date"),
        "invoice_no", F.col("_cid").alias("customer_id"), "amount",
        F.lit("Credit").alias("transaction_type"),
        F.concat(F.lit("Payment received for Invoice "), F.col("invoice_no").cast("string"))
         .alias("description"), "balance")
    rejects = (pre.select("invoice_no", "amount", F.col("_reason").alias("reason"))
               .unionByName(exceeds.select("invoice_no", "amount", F.col("_reason").alias("reason"))))
    paid_invoices = good.filter(F.col("balance") == 0).select("invoice_no").distinct()
    return credits, rejects, paid_invoices


# P-11
def add_ledger_entries(rows: DataFrame, ledger: DataFrame, customer: DataFrame,
                       invoice: DataFrame):
    """Manual ledger entries (batch form of the add-ledger page).

    ``rows``: entry_id, transaction_date, invoice_no, customer_mobile, amount,
    transaction_type, description.  Rejected: missing date / type / amount,
    a type other than Debit or Credit, amount <= 0, neither invoice nor mobile, unknown mobile, unknown invoice.
    Accepted rows get customer_id by mobile and balance = latest balance of
    the customer (newest transaction_date in ``ledger``) +/- amount, Credit +
    (the page's sign), carried through the batch in (date, entry_id) order.
    Rows without a customer start from 0 each.  Returns ``(entries, rejects)``.
    """
    cust = customer.select(F.col("mobile").alias("customer_mobile"), F.col("id").alias("_cid"))
    known_inv = invoice.select("invoice_no").distinct().withColumn("_inv_ok", F.lit(True))
    r = (rows.join(cust, "customer_mobile", "left").join(known_inv, "invoice_no", "left"))
    reason = (F.when(F.col("transaction_date").isNull() | F.col("transaction_type").isNull()
                     | F.col("amount").isNull(), "date, type and amount are required")
              .when(~F.col("transaction_type").isin(*R.TRANSACTION_TYPES), "invalid transaction type")
              .when(F.col("invoice_no").isNull() & F.col("customer_mobile").isNull(),
                    "invoice or mobile required")
              .when(F.col("amount") <= 0, "amount must be > 0")
              .when(F.col("customer_mobile").isNotNull() & F.col("_cid").isNull(),
                    "customer mobile does not exist")
              .when(F.col("invoice_no").isNotNull() & F.col("_inv_ok").isNull(),
                    "invoice does not exist"))
    r = r.withColumn("_reason", reason)
    rejects = r.filter(F.col("_reason").isNotNull()).select(
        "entry_id", F.col("_reason").alias("reason"))
    ok = r.filter(F.col("_reason").isNull()).withColumn("customer_id", F.col("_cid"))
    signed = R.signed_amount("transaction_type", "amount", "account")
    newest_first = [c for c in LEDGER_ORDER if c in ledger.columns]
    latest = latest_balance(ledger.filter(F.col("customer_id").isNotNull()), key="customer_id",
                            order=newest_first)
    with_c = ok.filter(F.col("customer_id").isNotNull())
    with_c = running_total(with_c, ["customer_id"], ["transaction_date", "entry_id"], signed, "_run",
                           base=latest.withColumnRenamed("balance", "_run"))
    with_c = with_c.withColumn("balance", F.col("_run").cast(BALANCE)).drop("_run")
    no_c = ok.filter(F.col("customer_id").isNull()).withColumn("balance", signed.cast(BALANCE))
    cols = ["entry_id", "transaction_date", "invoice_no", "customer_id", "amount",
            "transaction_type", "description", "balance"]
    return with_c.select(*cols).unionByName(no_c.select(*cols)), rejects


# P-12
def guard_ledger_entries(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """Violations of the variant ledger guard: an invoice already in the ledger
    (or twice in the batch), type not Debit/Credit, amount NULL or < 0."""
    dup_batch = (entries.filter(F.col("invoice_no").isNotNull())
                 .groupBy("invoice_no").agg(F.count(F.lit(1)).alias("_n"))
                 .filter(F.col("_n") > 1).select("invoice_no", F.lit(True).alias("_dup")))
    in_ledger = ledger.select("invoice_no").filter(F.col("invoice_no").isNotNull()) \
        .distinct().withColumn("_seen", F.lit(True))
    e = entries.join(dup_batch, "invoice_no", "left").join(in_ledger, "invoice_no", "left")
    reason = (F.when(F.col("_seen"), "invoice already has a transaction")
              .when(F.col("_dup"), "invoice repeated in batch")
              .when(~F.coalesce(F.col("transaction_type").isin(*R.TRANSACTION_TYPES), F.lit(False)),
                    "invalid transaction type")
              .when(F.col("amount").isNull() | (F.col("amount") < 0), "amount must be >= 0"))
    return (e.withColumn("reason", reason).filter(F.col("reason").isNotNull())
            .drop("_dup", "_seen"))


# W-2
def latest_balance(ledger: DataFrame, key: str = "customer_mobile",
                   order: list[str] | None = None, customers: DataFrame | None = None) -> DataFrame:
    """Balance of the newest row per key (by ``order``), as a partial aggregate.

    With ``customers`` (a one-column frame of keys) keys without rows get 0.
    """
    order = order or LEDGER_ORDER
    last = last_by_order(ledger, [key], order, ["balance"])
    last = last.select(key, F.col("balance").cast(BALANCE).alias("balance"))
    if customers is None:
        return last
    return (customers.select(key).join(last, key, "left")
            .select(key, F.coalesce(F.col("balance"), F.lit(0).cast(BALANCE)).alias("balance")))


# G-15
def ledger_balance(ledger: DataFrame, sign: str = "receivable", key: str = "customer_mobile",
                   customers: DataFrame | None = None) -> DataFrame:
    """SUM(Debit +, Credit -, other 0) per key; 0 for listed keys without rows."""
    sums = (ledger.groupBy(key)
            .agg(F.sum(R.signed_amount("transaction_type", "amount", sign)).cast(BALANCE)
                 .alias("balance")))
    if customers is None:
        return sums
    return (customers.select(key).join(sums, key, "left")
            .select(key, F.coalesce(F.col("balance"), F.lit(0).cast(BALANCE)).alias("balance")))


# G-21
def outstanding_unsigned(ledger: DataFrame, key: str = "customer_id") -> DataFrame:
    """Raw sum of amounts per key ignoring the type (variant logic)."""
    return ledger.groupBy(key).agg(F.sum("amount").cast(BALANCE).alias("outstanding"))


# G-20
def ledger_customers(ledger: DataFrame) -> DataFrame:
    return ledger.select("customer_mobile").distinct()


# J-5 / S-2
def list_ledger(ledger: DataFrame, customer: DataFrame) -> DataFrame:
    """Ledger rows with the customer name by mobile ('Unknown' if absent),
    newest first, NULL dates first (PostgreSQL's DESC order)."""
    names = customer.select(F.col("mobile").alias("customer_mobile"), F.col("name").alias("_name"))
    return (ledger.join(names, "customer_mobile", "left")
            .withColumn("customer_name", F.coalesce(F.col("_name"), F.lit("Unknown")))
            .orderBy(F.col("transaction_date").desc_nulls_first(), F.col("invoice_no").desc(),
                     F.col("step").desc())
            .select("transaction_date", "customer_mobile", "customer_name", "amount",
                    "transaction_type", "balance"))


# B-14
def filter_ledger(ledger: DataFrame, text: str = "", ttype: str = "", customer: str = "",
                  date: str = "") -> DataFrame:
    """Ledger page filter; an empty argument means no filter.

    text: mobile or customer_name contains it (case-insensitive); ttype:
    equal type; customer: equal mobile; date: transaction date equals it.
    """
    cond = F.lit(True)
    if text:
        t = text.lower()
        cond = cond & (F.lower(F.col("customer_mobile")).contains(t)
                       | F.lower(F.col("customer_name")).contains(t))
    if ttype:
        cond = cond & (F.col("transaction_type") == ttype)
    if customer:
        cond = cond & (F.col("customer_mobile") == customer)
    if date:
        day = F.to_date(F.lit(date)).cast("timestamp_ntz")
        cond = cond & (F.col("transaction_date") >= day) \
            & (F.col("transaction_date") < F.timestamp_add("DAY", F.lit(1), day))
    return ledger.filter(cond)
