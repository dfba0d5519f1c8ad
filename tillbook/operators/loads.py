"""Bulk loads, upserts, keyed updates and deletes (M-1..M-14, H-21, J-8, J-9).

The reference loops over file rows, issuing a look-up and an INSERT per
row.  Each load here is one plan: coerce and validate every row with
column expressions (bad rows go to a reject frame with a reason), resolve
keys with joins (anti/semi joins for EXISTS / NOT EXISTS), collapse repeated
keys with partial aggregates, and emit the new table version.  "First row
wins" takes ``min(ord)`` of the row's file position per key (a partial
aggregate) and matches rows back on (key, ord), never a per-key window, so
a key repeated a million times in a file does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.numbering import assign_ids, next_id_start
from tillbook.operators.stock import mirror_quantity, refresh_availability
from tillbook.operators.windows import first_by_order, last_by_order, materialize
from tillbook.session import delete_folder

CUSTOMER_COLUMNS = ("name", "mobile", "address", "mail")
SUPPLIER_COLUMNS = ("name", "terms", "mobile", "mail", "company")
PRODUCT_ATTRS = ("pro_name", "cost_price", "selling_price", "unit", "category", "safety_level",
                 "expiry_date", "supplier_id", "supplier_name", "terms_from_invoice", "hc_code")


def _conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with ``like``'s columns and types (absent columns NULL)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType)
                       .alias(f.name) for f in like.schema.fields])


def _reason_split(df: DataFrame, reason) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


# M-1 (with W-3, J-9)
def import_customers(rows: DataFrame, existing: DataFrame, order: str = "ord"):
    """Import a customer file: trim mobile, skip mobiles already in the table
    or earlier in the file (first row wins), give new rows ids.

    Rows without a mobile are skipped too.  Returns ``(new_customers,
    skipped)``; ``new_customers`` has id, name, mobile, address, mail with ids after the table's maximum.
    """
    r = rows.withColumn("mobile", R.clean_text(F.col("mobile").cast("string")))
    known = existing.select("mobile")
    fresh = r.filter("mobile is not null").join(known, "mobile", "left_anti")
    first = first_by_order(fresh, ["mobile"], [order], [order, "name", "address", "mail"])
    start = next_id_start(existing, "id")
    new = assign_ids(first, [order], start=start, out="id").select(
        "id", "name", "mobile", "address", "mail")
    kept = first.select("mobile", order, F.lit(True).alias("_kept"))
    skipped = (r.join(kept, ["mobile", order], "left").filter(F.col("_kept").isNull())
               .drop("_kept"))
    return new, skipped


# M-2
def import_suppliers(rows: DataFrame, existing: DataFrame, order: str = "ord") -> DataFrame:
    """Append every file row (no de-dup); the file's id/timestamp are ignored."""
    start = next_id_start(existing, "id")
    cols = [c for c in SUPPLIER_COLUMNS if c in rows.columns]
    return assign_ids(rows.select(order, *cols), [order], start=start, out="id").select("id", *cols)


# H-21
def _coerced(rows: DataFrame) -> DataFrame:
    """The rows of :func:`coerce_products`, all of them, with the ``reason``."""
    replaced = ("pro_id", "cost_price", "selling_price", "quantity", "safety_level", "supplier_id",
                "expiry_date", "hc_code")
    has_id = "pro_id" in rows.columns
    kept = [c for c in rows.columns if c not in replaced]
    # step by step, so that a cell is trimmed and parsed once however often it is asked for
    rows = rows.withColumns({f"_text_{c}": F.trim(F.col(c).cast("string")) for c in replaced if c in rows.columns})
    rows = rows.withColumns({f"_number_{c}": F.nanvl(F.col(f"_text_{c}").try_cast("double"), F.lit(None).cast("double"))
                             for c in replaced[:-2] if c in rows.columns})

    def blank(c):
        return F.nullif(F.col(f"_text_{c}"), F.lit(""))

    def number(c):
        return F.col(f"_number_{c}")

    def whole(c, kind="int"):
        return number(c).try_cast(kind)

    exact_id = F.coalesce(blank("pro_id").try_cast("bigint"),
                          F.when(number("pro_id") == F.floor(number("pro_id")), whole("pro_id", "bigint"))) \
        if has_id else None
    typed = rows.select(
        *kept,
        *([exact_id.alias("pro_id")] if has_id else []),
        number("cost_price").try_cast(R.MONEY).alias("cost_price"),
        number("selling_price").try_cast(R.MONEY).alias("selling_price"),
        whole("quantity").alias("quantity"),
        F.when(number("safety_level").isNull(), F.lit(0)).otherwise(whole("safety_level")).cast("string")
        .alias("safety_level"),
        whole("supplier_id").alias("supplier_id"),
        blank("expiry_date").try_cast("date").alias("expiry_date"),
        blank("hc_code").alias("hc_code"),
        number("cost_price").isNotNull().alias("_cost"), number("selling_price").isNotNull().alias("_sell"),
        number("quantity").isNotNull().alias("_qty"),
        (blank("expiry_date").isNotNull() & blank("expiry_date").try_cast("date").isNull()).alias("_expiry"))
    bad = (F.when(F.col("pro_id").isNull() if has_id else F.lit(False), "pro_id is not a whole number")
           .when(~F.col("_cost"), "cost_price is not a number")
           .when(F.col("cost_price").isNull(), "cost_price is out of range")
           .when(~F.col("_sell"), "selling_price is not a number")
           .when(F.col("selling_price").isNull(), "selling_price is out of range")
           .when(~F.col("_qty"), "quantity is not a number")
           .when(F.col("quantity").isNull(), "quantity is out of range")
           .when(F.col("safety_level").isNull(), "safety_level is out of range")
           .when(F.col("_expiry"), "expiry_date is not a date"))
    return typed.withColumn("reason", bad).drop("_cost", "_sell", "_qty", "_expiry")


def coerce_products(rows: DataFrame):
    """Type coercion of a product file read as text.

    pro_id to a whole number (so ``5`` and ``05`` are one product); prices
    via float to NUMERIC(10,2); quantity int (a fraction is truncated, like
    ``int(float)``); safety level int with blank or not-a-number -> 0;
    supplier id int or NULL; blank expiry / hc_code -> NULL.  A cell that
    does not parse, or a value its column cannot hold, rejects its row and
    no other.  Returns ``(ok, rejects)``; the coerced rows are written once,
    so the parsing is not done again by whatever reads them.
    """
    return _reason_split(materialize(_coerced(rows)), F.col("reason"))


# what can be wrong with a product file's row, by the column or the look-up that refuses it
PRODUCT_REASONS = ("pro_id is not a whole number", "cost_price is not a number", "cost_price is out of range",
                   "selling_price is not a number", "selling_price is out of range", "quantity is not a number",
                   "quantity is out of range", "safety_level is out of range", "expiry_date is not a date",
                   "missing supplier")


def tag_products(rows: DataFrame, supplier: DataFrame) -> DataFrame:
    """H-21 and J-8 in one pass: every row of the file, coerced, with its
    supplier's name and the first ``reason`` against it (NULL: accepted)."""
    names = supplier.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    known = _coerced(rows.drop("supplier_name")).join(names, "supplier_id", "left")
    return known.withColumn("reason", F.coalesce("reason", F.when(F.col("supplier_name").isNull(), F.lit("missing supplier"))))


def write_tagged(tagged: DataFrame, path: str, batch_id: str, reasons: tuple[str, ...] = ()) -> dict[str, int]:
    """Write the accepted and the refused rows of a load, and count them as
    they are written.

    Rows go to partitions (batch_id, outcome: accepted or rejected) of ``path``; a batch that is
    run again replaces its own.  The counts (``read``, ``accepted``,
    ``rejected``, and one per reason of ``reasons``) are observed in the task
    that writes, after the last exchange, so a stage that is run again counts
    once and no second pass over the file is needed.
    """
    seen = Observation()
    refused = F.col("reason").isNotNull()
    counts = {"read": F.count(F.lit(1)), "accepted": F.count_if(~refused), "rejected": F.count_if(refused),
              **{r: F.count_if(F.col("reason") == r) for r in reasons}}
    # a batch that has no row of one kind now must not keep an earlier run's
    delete_folder(tagged.sparkSession, f"{path.rstrip('/')}/batch_id={batch_id}")
    (tagged.observe(seen, *[c.alias(name) for name, c in counts.items()])
     .withColumn("batch_id", F.lit(batch_id))
     .withColumn("outcome", F.when(refused, F.lit("rejected")).otherwise(F.lit("accepted")))
     .write.mode("append").partitionBy("batch_id", "outcome").parquet(path))
    return dict(seen.get)


# J-8
def enrich_supplier(rows: DataFrame, supplier: DataFrame):
    """Add supplier_name by supplier_id; rows without a known supplier are
    rejected (the reference skips them).  Returns ``(ok, rejects)``."""
    names = supplier.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    r = rows.drop("supplier_name") if "supplier_name" in rows.columns else rows
    joined = r.join(names, "supplier_id", "left")
    bad = F.when(F.col("supplier_id").isNull() | F.col("supplier_name").isNull(), "missing supplier")
    return _reason_split(joined, bad)


# M-3
def import_products(rows: DataFrame, product: DataFrame, supplier: DataFrame,
                    inventory: DataFrame, order: str = "ord"):
    """Product file -> (product', inventory', rejects).

    coerce (H-21) -> supplier enrichment (J-8) -> per pro_id: SUM(quantity)
    and the first valid row's attributes -> upsert into product (new ids
    inserted; existing ids get quantity += file quantity) -> post the same
    quantity to inventory once (insert or +=) -> availability (H-6) -> the
    updated inventory quantities mirrored back to their products (M-12).

    The per-product rows are written once; both tables and a rerun of one
    of them read that copy instead of coercing the file again.
    """
    tagged = materialize(_tagged_products(rows, supplier, order))
    rejects = tagged.filter("reason is not null").select(order, "reason")
    ok = tagged.filter("reason is null")
    attrs = [c for c in PRODUCT_ATTRS if c in ok.columns]
    # one partial aggregate per product id: total quantity and the first
    # valid row's attributes (min over (ord, attrs...))
    per_key = materialize(
        ok.groupBy("pro_id")
        .agg(F.sum("quantity").alias("_q"),
             F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in attrs])).alias("_f"))
        .select("pro_id", "_q", *[F.col(f"_f.{c}").alias(c) for c in attrs]))
    sums = per_key.select("pro_id", "_q")

    p_cols = product.columns
    upd = (product.join(sums, "pro_id", "left")
           .withColumn("quantity", (F.col("quantity") + F.coalesce(F.col("_q"), F.lit(0))).cast("int"))
           .drop("_q"))
    ins = per_key.join(product.select("pro_id"), "pro_id", "left_anti") \
        .withColumn("quantity", F.col("_q").cast("int"))
    ins = _conform(ins, product)
    product2 = upd.select(*p_cols).unionByName(ins)

    inv_cols = inventory.columns
    q_add = F.col("_q")
    known = sums.withColumnRenamed("pro_id", "product_id")
    inv_upd = (inventory.join(known, "product_id", "left")
               .withColumn("quantity", F.when(q_add.isNotNull(),
                                              F.coalesce(F.col("quantity"), F.lit(0)) + q_add)
                           .otherwise(F.col("quantity")).cast("int"))
               .drop("_q"))
    inv_new = (per_key.withColumnRenamed("pro_id", "product_id")
               .join(inventory.select("product_id"), "product_id", "left_anti")
               .select("product_id", F.col("pro_name").alias("product_name"),
                       F.col("selling_price").alias("price"), F.col("_q").alias("quantity"),
                       "unit", "category", "expiry_date"))
    inv_new = _conform(inv_new, inventory)
    # safety levels of the new product version: existing rows keep theirs,
    # inserted ids bring the file's (quantities do not matter here)
    safety = product.select("pro_id", "safety_level").unionByName(ins.select("pro_id", "safety_level"))
    hit = known.select("product_id", F.lit(True).alias("_hit"))
    inventory2 = materialize(refresh_availability(
        inv_upd.select(*inv_cols).unionByName(inv_new).join(hit, "product_id", "left"),
        safety, F.col("_hit")).select(*inv_cols))
    # only updates are mirrored; a new inventory row has its product's quantity
    updated = known.join(inventory.select("product_id"), "product_id", "left_semi")
    return mirror_quantity(inventory2, product2, updated), inventory2, rejects


def _tagged_products(rows: DataFrame, supplier: DataFrame, order: str) -> DataFrame:
    """The typed, supplier-enriched rows of a product file with ``reason``
    (NULL: valid)."""
    ok, bad1 = coerce_products(rows)
    ok, bad2 = enrich_supplier(ok, supplier)
    reasons = bad1.select(order, "reason").unionByName(bad2.select(order, "reason"))
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(reasons, allowMissingColumns=True)


# M-4
def import_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Append ledger file rows as they are (after the caller's Q rules)."""
    return ledger.unionByName(rows, allowMissingColumns=True)


# M-6
def upsert_by_name(rows: DataFrame, product: DataFrame, inventory: DataFrame,
                   supplier: DataFrame, order: str = "ord"):
    """Variant upsert keyed by product *name*.

    A row whose name equals an existing product's name adds its quantity to
    that product and its inventory; otherwise it is inserted with trimmed
    text, a new id, and an inventory row.  Unknown supplier ids and rows
    without a name are rejected.
    Repeated new names in one file: the first row inserts, later ones add.
    Inventory rows that are inserted or whose quantity is written take their
    product's safety level and its availability (H-6); others keep theirs.
    Returns ``(product', inventory', rejects)``.
    """
    sup = supplier.select(F.col("id").alias("supplier_id"), F.lit(True).alias("_sup"))
    r = rows.join(sup, "supplier_id", "left")
    ok, rejects = _reason_split(r, F.when(F.col("_sup").isNull(), "invalid supplier_id")
                                .when(F.col("pro_name").isNull(), "missing product name"))
    ok = ok.drop("_sup")
    name_ids = product.groupBy("pro_name").agg(F.min("pro_id").alias("_pid"))
    matched = ok.join(name_ids, "pro_name", "inner")
    add = matched.groupBy(F.col("_pid").alias("pro_id")).agg(F.sum("quantity").alias("_q"))
    fresh = ok.join(name_ids, "pro_name", "left_anti")
    f_first = first_by_order(fresh, ["pro_name"], [order],
                             [order, "cost_price", "selling_price", "unit", "category",
                              "safety_level", "expiry_date", "supplier_id", "hc_code"])
    f_sum = fresh.groupBy("pro_name").agg(F.sum("quantity").cast("int").alias("quantity"))
    start = next_id_start(product, "pro_id")
    new_p = assign_ids(f_first.join(f_sum, "pro_name"), [order], start=start, out="pro_id")
    new_p = new_p.select(
        "pro_id", R.clean_text("pro_name").alias("pro_name"), "cost_price", "selling_price",
        "quantity", R.clean_text("unit").alias("unit"), R.clean_text("category").alias("category"),
        R.safety_to_int("safety_level").cast("string").alias("safety_level"), "expiry_date",
        "supplier_id", F.coalesce(F.col("hc_code"), F.lit("")).alias("hc_code"))
    upd = (product.join(add, "pro_id", "left")
           .withColumn("quantity", (F.col("quantity") + F.coalesce(F.col("_q"), F.lit(0))).cast("int"))
           .drop("_q"))
    product2 = upd.unionByName(new_p, allowMissingColumns=True)
    inv_upd = (inventory.join(add.withColumnRenamed("pro_id", "product_id"), "product_id", "left")
               .withColumn("quantity", (F.col("quantity") + F.coalesce(F.col("_q"), F.lit(0))).cast("int"))
               .withColumn("_hit", F.col("_q").isNotNull()).drop("_q"))
    inv_new = _conform(new_p.select(F.col("pro_id").alias("product_id"), F.col("pro_name").alias("product_name"),
                                    F.col("selling_price").alias("price"), "quantity", "unit", "category",
                                    "expiry_date", F.col("hc_code").alias("hscode")), inventory)
    written = inv_upd.unionByName(inv_new.withColumn("_hit", F.lit(True)))
    inventory2 = refresh_availability(written, product2, F.col("_hit")).drop("_hit")
    return product2, inventory2, rejects


# M-7
def apply_updates(base: DataFrame, changes: DataFrame, key: str,
                  order: str | None = None) -> DataFrame:
    """Keyed UPDATE from a change set: only the change set's columns change.

    With several changes for one key, the last by ``order`` wins (one
    partial aggregate); without ``order`` the change set must be unique.
    """
    cols = [c for c in changes.columns if c != key and c != order and c in base.columns]
    if order:
        changes = last_by_order(changes, [key], [order], cols)
    chg = changes.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = base.join(chg, key, "left")
    out = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).cast(base.schema[c].dataType)
           .alias(c) if c in cols else F.col(c) for c in base.columns]
    return j.select(*out)


# M-8
def delete_cascade(keys: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]):
    """Delete rows whose ``fk`` is in ``keys`` from each child table.

    ``children``: name -> (frame, fk column).  Returns name -> new frame.
    """
    k = keys.select(F.col(key).alias("_k"))
    return {name: df.join(k, df[fk] == k["_k"], "left_anti") for name, (df, fk) in children.items()}


# M-9
def delete_set_null(keys: DataFrame, key: str, child: DataFrame, fk: str) -> DataFrame:
    """ON DELETE SET NULL: the child's ``fk`` becomes NULL where it points
    at a deleted key."""
    k = keys.select(F.col(key).alias("_k"), F.lit(True).alias("_gone")).distinct()
    j = child.join(k, child[fk] == k["_k"], "left")
    return j.select(*[F.when(F.col("_gone"), F.lit(None)).otherwise(F.col(c))
                      .cast(child.schema[c].dataType).alias(c) if c == fk else F.col(c)
                      for c in child.columns])


# M-13
def normalise_inventory(inventory: DataFrame) -> DataFrame:
    """'' safety level -> NULL (as int), NULL unit -> 'pcs', NULL category -> 'General'."""
    return inventory.withColumns({
        "safety_level": R.safety_to_int(F.col("safety_level")),
        "unit": F.coalesce(F.col("unit"), F.lit("pcs")),
        "category": F.coalesce(F.col("category"), F.lit("General")),
    })


# M-14
def ensure_customers(rows: DataFrame, customer: DataFrame, order: str = "ord"):
    """Find-or-create customers by mobile for a batch of (mobile, name) rows.

    Mobiles not in the table are created once (first row's name) with ids
    after the maximum; every row gets its customer_id.  A row without a
    mobile names no customer: it creates none and its customer_id is NULL.
    Returns ``(customer', rows_with_ids)``.
    """
    fresh = rows.filter("mobile is not null").join(customer.select("mobile"), "mobile", "left_anti")
    first = first_by_order(fresh, ["mobile"], [order], [order, "name"])
    start = next_id_start(customer, "id")
    created = assign_ids(first, [order], start=start, out="id").select("id", "name", "mobile")
    customer2 = customer.unionByName(created, allowMissingColumns=True)
    ids = customer2.select(F.col("mobile"), F.col("id").alias("customer_id"))
    return customer2, rows.join(ids, "mobile", "left")
