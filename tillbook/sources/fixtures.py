"""Retail tables derived from the driver's TPC-H-like parquet files.

The mapping (customer -> customer, part -> product/inventory, orders ->
invoice, lineitem -> invoice lines, ...) is fixed by FIXTURES.md §3.  Every
table is a lazy DataFrame over the parquet scan, so column pruning and
predicate pushdown reach the files; nothing is collected.
"""

from __future__ import annotations

from decimal import Decimal
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions import rules as R

# Report date used instead of CURRENT_DATE (FIXTURES.md §3).
AS_OF = "2001-07-15"

# Fixed values of the test-data mapping (FIXTURES.md §3), in natural order.
PAYMENT_METHOD_BY_KEY_MOD5 = ("cash", "credit_card", "bank_transfer", "upi", "unpaid")
TERMS_BY_KEY_MOD5 = ("5", "10", "15", "20", "30")


def _by_mod(col, values):
    """values[col % len(values)] as a CASE chain."""
    m = col % len(values)
    expr = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(m == i, F.lit(v))
    return expr


def mobile_of(custkey) -> F.Column:
    return F.lpad(custkey.cast("string"), 10, "0")


class Retail:
    """The retail schema over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def customer(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(c.c_custkey.alias("id"), c.c_name.alias("name"),
                        mobile_of(c.c_custkey).alias("mobile"))

    @cached_property
    def supplier(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(s.s_suppkey.alias("id"), s.s_name.alias("name"))

    @cached_property
    def product(self) -> DataFrame:
        p = self.raw("part")
        sell = p.p_retailprice.cast(R.MONEY)
        cost = (sell * F.lit(Decimal("0.70"))).cast(R.MONEY)
        return p.select(
            p.p_partkey.alias("pro_id"), p.p_name.alias("pro_name"),
            cost.alias("cost_price"), sell.alias("selling_price"),
            p.p_type.alias("category"),
            p.p_size.cast("string").alias("safety_level"),
            (p.p_partkey % 120).cast("int").alias("supplier_id"),
            ((p.p_partkey * 7) % 60).cast("int").alias("quantity"),
            F.lit("pcs").alias("unit"),
            F.date_add(F.lit("2001-01-01").cast("date"), (p.p_partkey % 400).cast("int"))
             .alias("expiry_date"),
            F.concat(F.lit("HC"), p.p_partkey.cast("string")).alias("hc_code"))

    @cached_property
    def inventory(self) -> DataFrame:
        p = self.raw("part")
        k = p.p_partkey
        qty = F.when(k % 97 == 0, F.lit(None)).otherwise((k * 7) % 60).cast("int")
        safety = R.safety_to_int(p.p_size.cast("string"))
        return p.select(
            k.alias("product_id"), p.p_name.alias("product_name"),
            p.p_retailprice.cast(R.MONEY).alias("price"),
            qty.alias("quantity"),
            F.when(k % 11 == 0, F.lit(None)).otherwise(F.lit("pcs")).alias("unit"),
            F.when(k % 13 == 0, F.lit(None)).otherwise(p.p_type).alias("category"),
            safety.alias("safety_level"),
            F.when(k % 7 == 0, F.lit(None))
             .otherwise(F.date_add(F.lit("2001-01-01").cast("date"), (k % 400).cast("int")))
             .alias("expiry_date"),
            F.when(k % 5 == 0, F.lit(None))
             .otherwise(F.concat(F.lit("HC"), k.cast("string"))).alias("hscode"),
            R.availability(qty, safety).alias("availability"))

    @cached_property
    def invoice_draft(self) -> DataFrame:
        """Invoice headers as submitted, before the payment-status rule."""
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_name")
        k = o.o_orderkey
        total = o.o_totalprice.cast(R.MONEY)
        pct = ((k % 4) * 5).cast("int")
        disc = (total * pct.cast("decimal(3,0)") * F.lit(Decimal("0.01"))).cast(R.MONEY)
        final = R.final_amount(total, disc)
        paid = (F.when(o.o_orderstatus == "F", final)
                 .when(o.o_orderstatus == "P", final * F.lit(Decimal("0.5")))
                 .otherwise(F.lit(0))).cast(R.MONEY)
        return (o.join(c, o.o_custkey == c.c_custkey, "left")
                .select(k.alias("invoice_no"), o.o_custkey.alias("customer_id"),
                        c.c_name.alias("customer_name"),
                        mobile_of(o.o_custkey).alias("customer_mobile"),
                        o.o_orderdate.cast("date").alias("date"),
                        _by_mod(k, TERMS_BY_KEY_MOD5).alias("terms"),
                        o.o_orderpriority.alias("sale_by"),
                        total.alias("total_amount"), pct.alias("discount_percent"),
                        disc.alias("discount"), final.alias("final_amount"),
                        _by_mod(k, PAYMENT_METHOD_BY_KEY_MOD5).alias("payment_method"),
                        paid.alias("total_paid")))

    @cached_property
    def invoice(self) -> DataFrame:
        """Invoice headers with status, payment status and paid amount (H-8)."""
        from tillbook.operators.posting import apply_payment_status
        return apply_payment_status(self.invoice_draft)

    @cached_property
    def lines(self) -> DataFrame:
        li = self.raw("lineitem")
        pr = self.product.select("pro_id", "selling_price")
        qty = li.l_quantity.cast("int")
        price = pr.selling_price
        disc = (price * qty * li.l_discount.cast("decimal(3,2)")).cast(R.MONEY)
        return (li.join(pr, li.l_partkey == pr.pro_id, "inner")
                .select(li.l_orderkey.alias("invoice_no"), li.l_linenumber.alias("line_no"),
                        li.l_partkey.alias("product_id"), qty.alias("quantity"),
                        price.alias("price"), disc.alias("discount"),
                        R.line_total(price, qty, disc).alias("total")))

    @cached_property
    def payment(self) -> DataFrame:
        from tillbook.operators.posting import post_payments
        return post_payments(self.invoice)

    @cached_property
    def ledger(self) -> DataFrame:
        from tillbook.operators.ledger import post_ledger
        return post_ledger(self.invoice)

    @cached_property
    def ledger_entries(self) -> DataFrame:
        """The ledger without balances, for whoever does not read them."""
        from tillbook.operators.ledger import entries_from_invoices
        return entries_from_invoices(self.invoice)

    @cached_property
    def add_item(self) -> DataFrame:
        """Restock rows: returned line items put back on the shelf."""
        li = self.raw("lineitem")
        return (li.filter(li.l_returnflag == "R")
                .select(li.l_orderkey.alias("ref_order"), li.l_linenumber.alias("ref_line"),
                        li.l_partkey.alias("product_id"),
                        li.l_quantity.cast("int").alias("quantity_added"),
                        li.l_shipdate.alias("added_date")))

    @cached_property
    def payment_events(self) -> DataFrame:
        e = self.raw("events")
        return (e.filter(e.event_type == "purchase")
                .select(e.event_id, e.ts, e.user_id,
                        e.value.cast(R.MONEY).alias("amount")))


RETAIL_TABLES = ("customer", "supplier", "product", "inventory", "invoice", "lines", "payment",
                 "ledger", "add_item", "payment_events")
# clustering of the stored tables (range-partitioned and sorted on write)
STORAGE_ORDER = {
    "invoice": ["date", "invoice_no"],
    "payment": ["invoice_date", "invoice_no"],
    "lines": ["invoice_no", "line_no"],
    "ledger": ["transaction_date", "invoice_no", "step"],
    "add_item": ["added_date"],
}


class StoredRetail(Retail):
    """The retail tables written once as Parquet and read back.

    This is how the tables live in production: derived once, stored, and
    every report reads only the columns and row groups it needs.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, table_dir: str):
        super().__init__(spark, sf_dir)
        self.table_dir = table_dir.rstrip("/")

    def __getattribute__(self, name):
        # stored tables open on first use (file listing and footers cost a
        # round trip each; a report touches two or three of ten tables)
        if name in RETAIL_TABLES:
            d = object.__getattribute__(self, "__dict__")
            if name not in d:
                d[name] = self.spark.read.parquet(f"{self.table_dir}/{name}")
            return d[name]
        return object.__getattribute__(self, name)

    @classmethod
    def build(cls, spark: SparkSession, sf_dir: str, table_dir: str) -> "StoredRetail":
        """Derive and store every table, clustered by its usual filter key:
        files and row groups then cover narrow key ranges, so a date-range
        report skips most row groups by their min/max statistics."""
        src = Retail(spark, sf_dir)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in RETAIL_TABLES:
            df = getattr(src, name)
            keys = STORAGE_ORDER.get(name)
            if keys:
                df = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
            df.write.mode("overwrite").parquet(f"{table_dir.rstrip('/')}/{name}")
        return cls(spark, sf_dir, table_dir)
