"""Invoice posting as one batch job (P-1, M-14, P-3, P-5, P-2, P-6, P-7, P-4).

The reference posts one invoice per request in several separately committed
statements and triggers.  Here the checked headers, the valid invoices' lines
and the decided invoices are each written once (lineage cuts under the shared
checkpoint folder) and every output -- invoices, lines, payments, ledger, the
new inventory, customers and rejects -- is derived from those copies, so the
outputs agree with each other and a rerun gives the same result.  The new
inventory quantities are mirrored to the products, as the trigger does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.operators import ledger, loads, posting, quality, stock
from tillbook.operators.windows import materialize

LINE_ORDER = ["invoice_no", "line_no", "quantity"]


def post_invoices(headers: DataFrame, items: DataFrame, customer: DataFrame,
                  inventory: DataFrame, product: DataFrame, opening: DataFrame | None = None,
                  stock_mode: str = "sequential",
                  batch_id: str | None = None) -> dict[str, DataFrame]:
    """``headers``: invoice drafts (invoice_no, date, terms, sale_by,
    customer_mobile, customer_name, total_amount, discount_percent, discount,
    final_amount, payment_method, total_paid).  ``items``: invoice_no,
    line_no, product_id, quantity, price, discount.  With ``batch_id`` every
    row produced for the batch carries it, so a rerun can replace exactly
    the rows of an earlier attempt."""
    ok, rejects = quality.validate_invoices(headers, items, once=True)           # P-1
    rows = ok.select(F.col("customer_mobile").alias("mobile"),
                     F.col("customer_name").alias("name"), F.col("invoice_no").alias("ord"))
    customer2, with_ids = loads.ensure_customers(rows, customer)                 # M-14
    ids = with_ids.select(F.col("ord").alias("invoice_no"), "customer_id")
    ok_items = materialize(items.join(ok.select("invoice_no"), "invoice_no", "left_semi"))
    verdict = materialize(stock.stock_verdicts(ok_items, inventory, stock_mode, LINE_ORDER))  # P-3
    accepted = materialize((ok.drop("customer_id") if "customer_id" in ok.columns else ok)
                           .join(ids, "invoice_no", "left")
                           .join(verdict.select("invoice_no", "invoice_ok"), "invoice_no", "left"))
    short = (accepted.filter(~F.coalesce(F.col("invoice_ok"), F.lit(False)))
             .select("invoice_no", F.lit("insufficient stock").alias("reason")))
    batch = posting.apply_payment_status(                                        # P-5
        accepted.filter(F.coalesce(F.col("invoice_ok"), F.lit(False))).drop("invoice_ok"))
    lines = posting.build_lines(                                                  # P-2
        ok_items.join(batch.select("invoice_no"), "invoice_no", "left_semi"), inventory)
    inventory2 = materialize(stock.apply_sales(inventory, lines, product))       # P-4
    out = {
        "invoice": batch,
        "lines": lines,
        "payment": posting.post_payments(batch),                                 # P-6
        "ledger": ledger.post_ledger(batch, opening),                            # P-7
        "inventory": inventory2,
        "product": stock.mirror_quantity(inventory2, product, lines),            # M-12
        "customer": customer2,
        "rejects": rejects.select("invoice_no", "reason").unionByName(short),
    }
    if batch_id is not None:
        stamped = ("invoice", "lines", "payment", "ledger", "rejects")
        out.update({k: out[k].withColumn("batch_id", F.lit(batch_id)) for k in stamped})
    return out
