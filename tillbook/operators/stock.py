"""Stock positions: availability, sales, restocks, checks (H-6, P-3, P-4,
M-5, M-10, M-11, M-12, B-9).

The reference keeps stock with row triggers (one UPDATE per line).  Here a
batch of movements is summed per product first (map-side partial
aggregate, so a hot product costs one row per task) and merged into the
inventory with a single join; the result is a new inventory version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.greedy import accept_in_order
from tillbook.operators.skew import join_per_key
from tillbook.operators.windows import materialize, running_total


def refresh_availability(inventory: DataFrame, product: DataFrame, touched=None) -> DataFrame:
    """H-6 as the BEFORE trigger applies it: safety level from the product
    (text -> int, NULL or no product -> 1), then the 1..5 scale from quantity
    / safety.  ``touched`` (a boolean column) limits it to rows whose
    quantity or safety level is written, as the trigger is; other rows keep
    what they have.
    """
    touched = F.lit(True) if touched is None else F.coalesce(touched, F.lit(False))
    s = product.select(F.col("pro_id").alias("_sid"), R.safety_to_int(F.col("safety_level")).alias("_safety"))
    j = inventory.join(s, F.col("product_id") == F.col("_sid"), "left")
    safety = F.coalesce("_safety", F.lit(1))
    own = F.col("safety_level") if "safety_level" in inventory.columns else F.lit(None).cast("int")
    level = F.col("availability") if "availability" in inventory.columns else F.lit(None).cast("int")
    new = {"safety_level": F.when(touched, safety).otherwise(own),
           "availability": F.when(touched, R.availability(F.col("quantity"), safety)).otherwise(level)}
    names = [*inventory.columns, *[c for c in new if c not in inventory.columns]]
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in names])


def _merge_delta(inventory: DataFrame, delta: DataFrame, product: DataFrame) -> DataFrame:
    """inventory.quantity + delta per product (NULL quantity stays NULL);
    availability of the changed rows."""
    j = (inventory.join(delta.withColumn("_hit", F.lit(True)), "product_id", "left")
         .withColumn("quantity", (F.col("quantity") + F.coalesce(F.col("_delta"), F.lit(0))).cast("int")))
    return refresh_availability(j, product, F.col("_hit")).drop("_delta", "_hit").select(
        *inventory.columns, *[c for c in ("safety_level", "availability") if c not in inventory.columns])


# P-4
def apply_sales(inventory: DataFrame, lines: DataFrame, product: DataFrame) -> DataFrame:
    """quantity -= SUM(line quantity) per product; availability of the sold
    products recomputed from the product's safety level."""
    sold = lines.groupBy("product_id").agg((-F.sum("quantity")).alias("_delta"))
    return _merge_delta(inventory, sold, product)


# M-10
def apply_restock(inventory: DataFrame, add_item: DataFrame, product: DataFrame):
    """quantity += SUM(quantity_added) for products in inventory.

    Returns ``(inventory', rejects)``: restock rows of products absent from
    inventory are rejected (the trigger only raises a notice).
    """
    added = add_item.groupBy("product_id").agg(F.sum("quantity_added").alias("_delta"))
    rejects = (add_item.join(inventory.select("product_id"), "product_id", "left_anti")
               .withColumn("reason", F.lit("product not in inventory")))
    return _merge_delta(inventory, added, product), rejects


# M-12
def mirror_quantity(inventory: DataFrame, product: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Copy inventory quantity back onto product rows that have inventory;
    with ``touched`` (rows with a ``product_id``) only for those products, as
    the AFTER UPDATE trigger does."""
    q = inventory.select("product_id", F.col("quantity").alias("_inv_q"), F.lit(True).alias("_has"))
    if touched is not None:
        q = q.join(touched.select("product_id"), "product_id", "left_semi")
    p = product.join(q, product.pro_id == q.product_id, "left").drop("product_id")
    return (p.withColumn("quantity", F.when(F.col("_has"), F.col("_inv_q"))
                         .otherwise(F.col("quantity")).cast("int"))
            .drop("_inv_q", "_has"))


# M-5
def product_to_inventory(products: DataFrame, inventory: DataFrame,
                         on_existing: str = "ignore") -> DataFrame:
    """Post new product rows to inventory, once (defect 1: never twice).

    Absent products are inserted with the product's attributes;
    ``on_existing='ignore'`` leaves present ones alone (ON CONFLICT DO
    NOTHING), ``'add'`` adds the product quantity to them.
    """
    p = products.select(F.col("pro_id").alias("product_id"), F.col("pro_name").alias("product_name"),
                        F.col("selling_price").alias("price"), "quantity", "unit", "category",
                        F.lit(None).cast("int").alias("safety_level"),
                        "expiry_date", F.col("hc_code").alias("hscode"), F.lit(None).cast("int").alias("availability"))
    new_rows = refresh_availability(p.join(inventory.select("product_id"), "product_id", "left_anti"), products)
    base = inventory
    if on_existing == "add":
        delta = p.groupBy("product_id").agg(F.sum("quantity").alias("_delta"))
        base = _merge_delta(inventory, delta, products)
    elif on_existing != "ignore":
        raise ValueError(f"unknown on_existing {on_existing!r}")
    return base.unionByName(new_rows.select(*inventory.columns))


# P-3
def _line_checks(items: DataFrame, inventory: DataFrame, mode: str, order: list[str]) -> DataFrame:
    """``items`` with ``line_ok``."""
    stock = inventory.select("product_id", F.col("quantity").alias("stock"))
    x = items.join(stock, "product_id", "left")
    if mode == "line":
        need = F.col("quantity")
    elif mode == "cumulative":
        x = running_total(x, ["product_id"], order, F.col("quantity").cast("long"), "demand")
        need = F.col("demand")
    elif mode == "sequential":
        # one claim per (invoice, product): an invoice's lines of a product together
        claims = x.groupBy("invoice_no", "product_id").agg(
            F.when(F.count("quantity") == F.count(F.lit(1)), F.sum("quantity")).alias("need"),
            F.first("stock").cast("long").alias("stock"))
        fits = accept_in_order(claims, ["invoice_no"], "product_id", "need", "stock")
        return join_per_key(x, fits.withColumnRenamed("accepted", "line_ok"), ["invoice_no"], "inner",
                            counts=items.groupBy("invoice_no").agg(F.count(F.lit(1)).alias("_n")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    # a NULL quantity never fits, also where the demand before it is known
    return x.withColumn("line_ok", F.coalesce((F.col("stock") >= need) & F.col("quantity").isNotNull(),
                                              F.lit(False)))


def check_stock(items: DataFrame, inventory: DataFrame, mode: str = "sequential",
                order: list[str] | None = None) -> DataFrame:
    """Per-line stock verdict and the invoice verdict.

    ``mode='line'`` (the reference): each line alone must find its product
    with stock >= quantity, so two lines of one product can oversell.
    ``mode='sequential'`` (default): invoices are served in invoice_no order;
    an invoice whose lines all fit what is left takes its stock, any other
    takes none; ``line_ok`` is the invoice's verdict.
    ``mode='cumulative'``: the running demand of all lines of the product, in
    ``order``, must fit the stock, demand of refused invoices included (a
    conservative one-pass check).
    Returns one row per line with ``line_ok`` and ``invoice_ok`` (all lines
    of the invoice ok).
    """
    x = materialize(_line_checks(items, inventory, mode, order or ["invoice_no", "line_no"]))
    verdict = x.groupBy("invoice_no").agg(F.bool_and("line_ok").alias("invoice_ok"))
    return join_per_key(x, verdict, ["invoice_no"], "inner")


def stock_verdicts(items: DataFrame, inventory: DataFrame, mode: str = "sequential",
                   order: list[str] | None = None) -> DataFrame:
    """Invoice-level result of P-3: invoice_no, invoice_ok, short_lines
    (lines not ok), in one aggregate over the checked lines."""
    lines = _line_checks(items, inventory, mode, order or ["invoice_no", "line_no"])
    return lines.groupBy("invoice_no").agg(
        F.bool_and("line_ok").alias("invoice_ok"),
        F.count(F.when(~F.col("line_ok"), F.lit(1))).alias("short_lines"))


# M-11 (with J-7, W-5, H-13)
def restock(items: DataFrame, inventory: DataFrame, product: DataFrame,
            existing_numbers: DataFrame | None, order: list[str]):
    """Restock rows and supplier invoices for a batch of restock requests.

    ``items``: product_id, quantity_added, added_date (+ order columns).
    Each accepted item gets a supplier invoice number ``YYYY#####`` in its
    year (W-5) and a supplier invoice for cost_price x quantity (H-13).
    Rejected: quantity <= 0 / NULL, product without inventory+product row.
    A ``comments`` column is kept on the restock rows.  The numbered rows are
    written once; both tables are projections of them.
    Returns ``(add_item, supplier_invoice, rejects)``.
    """
    from tillbook.operators.numbering import assign_doc_numbers
    from tillbook.operators.reports import restock_candidates
    cand = restock_candidates(inventory, product).select(
        "product_id", "supplier_id", "cost_price", F.lit(True).alias("_known"))
    x = items.join(cand, "product_id", "left")
    reason = (F.when(F.col("quantity_added").isNull() | (F.col("quantity_added") <= 0),
                     "quantity must be > 0")
              .when(F.col("_known").isNull(), "product not found"))
    x = x.withColumn("reason", reason)
    rejects = x.filter(F.col("reason").isNotNull()).drop("_known", "supplier_id", "cost_price")
    ok = x.filter(F.col("reason").isNull()).withColumn("_year", F.year("added_date"))
    numbered = materialize(assign_doc_numbers(ok, existing_numbers, "_year", order))
    own = ["product_id", "quantity_added", "supplier_id", "invoice_no", "added_date"]
    add_item = numbered.select(*own, *[c for c in [*order, "comments"]
                                       if c in numbered.columns and c not in own])
    supplier_invoice = numbered.select(
        "invoice_no", "supplier_id", "product_id", F.col("quantity_added").alias("quantity"),
        R.restock_cost(F.col("cost_price"), F.col("quantity_added")).alias("total_amount"),
        F.col("added_date").alias("invoice_date"),
        F.lit("Pending").alias("status"), F.lit("Unpaid").alias("payment_status"))
    return add_item, supplier_invoice, rejects


def restock_job(items: DataFrame, inventory: DataFrame, product: DataFrame,
                existing_numbers: DataFrame | None, order: list[str]) -> dict[str, DataFrame]:
    """Restocking as one job: restock rows, supplier invoices, the inventory
    with the added quantities and availabilities, and the product quantities
    mirrored from it.  The numbered rows are written once (by :func:`restock`),
    so every output agrees with them."""
    add_item, supplier_invoice, rejects = restock(items, inventory, product, existing_numbers, order)
    inventory2, _ = apply_restock(inventory, add_item, product)
    return {"add_item": add_item, "supplier_invoice": supplier_invoice, "inventory": inventory2,
            "product": mirror_quantity(inventory2, product, add_item), "rejects": rejects}
