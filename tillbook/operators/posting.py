"""Invoice posting: status, payments and lines (P-2, P-5, P-6, G-16, U-1..U-3).

The reference does this one invoice at a time inside row triggers; here each
step is one set-based projection or join over a whole batch of invoices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R


# P-5
def apply_payment_status(invoice: DataFrame, rule: str = "live") -> DataFrame:
    """Rewrite status / payment_status / total_paid as the BEFORE trigger does.

    ``rule='live'`` is H-8 (method and paid amount); ``rule='simple'`` is the
    older H-9 (paid amount only, total_paid kept).
    """
    if rule == "live":
        st = R.payment_status(F.col("payment_method"), F.col("total_paid"))
        return invoice.withColumns({
            "status": st["status"], "payment_status": st["payment_status"],
            "total_paid": st["total_paid"]})
    if rule == "simple":
        st = R.payment_status_simple(F.col("total_paid"))
        return invoice.withColumns({"status": st["status"],
                                    "payment_status": st["payment_status"]})
    raise ValueError(f"unknown rule {rule!r}")


# P-6
def post_payments(invoice: DataFrame) -> DataFrame:
    """One payment row per invoice that is 'Paid' with a positive paid amount."""
    inv = invoice.filter((F.col("payment_status") == "Paid") & (F.col("total_paid") > 0))
    return inv.select(
        F.col("invoice_no"), F.col("date").alias("invoice_date"),
        F.col("total_paid").alias("amount"), F.col("customer_name"),
        F.col("payment_method").alias("payment_mode"),
        F.col("payment_status").alias("status"), F.col("customer_id"))


# P-2 (with J-11: unit from inventory)
def build_lines(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Invoice lines with the unit looked up from inventory and the H-4 total."""
    units = inventory.select(F.col("product_id").alias("_pid"), "unit")
    return (items.join(units, items.product_id == units._pid, "left").drop("_pid")
            .withColumn("total", R.line_total("price", "quantity", "discount")))


# G-16
def settle_invoices(invoice: DataFrame, payment: DataFrame, basis: str = "total") -> DataFrame:
    """Paid amount per invoice from payments and the settlement status.

    Faithful default compares with ``total_amount`` (before discount);
    ``basis='final'`` compares with ``final_amount``.
    """
    paid = (payment.groupBy("invoice_no")
            .agg(F.sum("amount").cast(R.WIDE_MONEY).alias("paid_amount")))
    due = F.col("total_amount") if basis == "total" else F.col("final_amount")
    paid_amt = F.coalesce(F.col("paid_amount"), F.lit(0).cast(R.WIDE_MONEY))
    return (invoice.select("invoice_no", "total_amount", "final_amount")
            .join(paid, "invoice_no", "left")
            .select("invoice_no", paid_amt.alias("paid_amount"),
                    F.when(paid_amt >= due, "Paid").when(paid_amt > 0, "Partially Paid")
                     .otherwise("Unpaid").alias("settlement_status")))


# U-1
def backfill_unpaid(invoice: DataFrame) -> DataFrame:
    """Payment rows for unpaid invoices: amount = final_amount, 'Pending'."""
    return (invoice.filter(F.col("payment_status") == "Unpaid")
            .select("invoice_no", F.col("date").alias("invoice_date"),
                    F.col("final_amount").alias("amount"), "customer_name",
                    F.lit("Pending").alias("payment_mode"), F.lit("Pending").alias("status"),
                    "customer_id"))


# U-2
def backfill_paid(invoice: DataFrame) -> DataFrame:
    """Payment rows for invoices with total_paid > 0: 'Cash', 'Completed'."""
    return (invoice.filter(F.col("total_paid") > 0)
            .select("invoice_no", F.col("date").alias("invoice_date"),
                    F.col("total_paid").alias("amount"), "customer_name",
                    F.lit("Cash").alias("payment_mode"), F.lit("Completed").alias("status"),
                    "customer_id"))


# U-3
def upsert_payments(invoice: DataFrame, payment: DataFrame, customer: DataFrame):
    """Insert-or-update one payment per paid invoice (variant trigger).

    Returns ``(payments, rejects)``.  Invoices without a customer id are
    rejected (the variant raises).  A 'Paid' invoice with final_amount > 0
    overwrites amount (= final_amount), mode (= payment_method) and sets status
    'Completed' on every existing payment row of it, or inserts one row with
    the customer's name.  Written as left join + anti join rather than a full
    outer join so that a hot invoice on the payment side can be split by AQE.
    """
    rejects = (invoice.filter(F.col("customer_id").isNull())
               .select("invoice_no", F.lit("customer is NULL").alias("reason")))
    names = customer.select(F.col("id").alias("customer_id"), F.col("name").alias("_cname"))
    src = (invoice.filter(F.col("customer_id").isNotNull()
                          & (F.col("payment_status") == "Paid") & (F.col("final_amount") > 0))
           .join(names, "customer_id", "left")
           .select("invoice_no", F.col("date").alias("_date"),
                   F.col("final_amount").alias("_amount"),
                   F.col("payment_method").alias("_mode"), "_cname"))
    cols = ["invoice_no", "invoice_date", "amount", "customer_name", "payment_mode",
            "status", "customer_id"]
    hit = F.col("_amount").isNotNull()
    updated = (payment.select(*cols).join(src, "invoice_no", "left")
               .select("invoice_no", "invoice_date",
                       F.when(hit, F.col("_amount")).otherwise(F.col("amount")).alias("amount"),
                       "customer_name",
                       F.when(hit, F.col("_mode")).otherwise(F.col("payment_mode")).alias("payment_mode"),
                       F.when(hit, F.lit("Completed")).otherwise(F.col("status")).alias("status"),
                       "customer_id"))
    inserted = (src.join(payment.select("invoice_no"), "invoice_no", "left_anti")
                .select("invoice_no", F.col("_date").alias("invoice_date"),
                        F.col("_amount").alias("amount"), F.col("_cname").alias("customer_name"),
                        F.col("_mode").alias("payment_mode"), F.lit("Completed").alias("status"),
                        F.lit(None).cast("long").alias("customer_id")))
    return updated.unionByName(inserted), rejects


# J-13
def sale_to_lines(sale: DataFrame, product: DataFrame) -> DataFrame:
    """Sale rows -> invoice lines: unit from the product ('pcs' if none),
    discount NULL -> 0, H-4 total."""
    units = product.select(F.col("pro_id").alias("product_id"), F.col("unit").alias("_unit"))
    return (sale.join(units, "product_id", "left")
            .select("invoice_no", "product_id", "quantity",
                    F.coalesce(F.col("_unit"), F.lit("pcs")).alias("unit"), "price",
                    F.coalesce(F.col("discount"), F.lit(0)).cast(R.MONEY).alias("discount"))
            .withColumn("total", R.line_total("price", "quantity", "discount")))


# G-17
def recompute_invoice_total(invoice: DataFrame, lines: DataFrame) -> DataFrame:
    """total_amount := SUM(line totals) (0 without lines); final_amount follows (H-3)."""
    sums = lines.groupBy("invoice_no").agg(F.sum("total").alias("_t"))
    total = F.coalesce(F.col("_t"), F.lit(0)).cast(R.MONEY)
    return (invoice.join(sums, "invoice_no", "left").withColumn("total_amount", total)
            .withColumn("final_amount", R.final_amount("total_amount", "discount"))
            .drop("_t"))
