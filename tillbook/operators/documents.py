"""Invoice documents and print/draft totals (A-11, G-18, G-19, G-22, W-4).

The unbounded form of an invoice's items is rows (``document_items`` with
``number_lines``).  A document is the header plus items as an array; a group
collect is only safe when the group is bounded, so a document holds a page
of ``page_size`` lines (the position inside the invoice is the skew-safe
prefix count).  Every document says which page of how many it is and how
many items the invoice has, whatever the invoice's size.  Nothing is
dropped: every line appears in exactly one page.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators.windows import materialize, row_number_in_group

HEADER = ["invoice_no", "customer_name", "customer_mobile", "date", "final_amount", "status",
          "payment_status"]
ITEM = ["name", "quantity", "unit", "price", "discount", "total"]
LINE_ORDER = ["line_no", "product_id", "quantity"]
GST_RATE = Decimal("0.10")


def document_items(lines: DataFrame, product: DataFrame) -> DataFrame:
    """Lines joined to product names (lines of unknown products drop out, J-6)."""
    names = product.select(F.col("pro_id").alias("product_id"), F.col("pro_name").alias("name"))
    unit = F.col("unit") if "unit" in lines.columns else F.lit(None).cast("string")
    return (lines.join(names, "product_id", "inner")
            .select("invoice_no", "line_no", "product_id", "name", "quantity", unit.alias("unit"),
                    "price", "discount", "total"))


# W-4
def number_lines(lines: DataFrame, order: list[str] | None = None, out: str = "serial") -> DataFrame:
    """Serial number 1..n of each line inside its invoice (print layout)."""
    return row_number_in_group(lines, ["invoice_no"], order or LINE_ORDER, out)


# A-11
def invoice_documents(invoice: DataFrame, lines: DataFrame, product: DataFrame,
                      page_size: int) -> DataFrame:
    """One row per (invoice, page): header columns, ``page`` (from 0),
    ``page_count``, ``item_count`` (items of the invoice) and ``items`` (array
    of name, quantity, unit, price, discount, total in line order).
    An invoice without lines has one page with an empty array."""
    items = number_lines(document_items(lines, product), out="_pos")
    items = items.withColumn("page", F.floor((F.col("_pos") - 1) / page_size).cast("int"))
    packed = F.struct(F.col("_pos"), *[F.col(c) for c in ITEM])
    pages = (items.groupBy("invoice_no", "page")
             .agg(F.sort_array(F.collect_list(packed)).alias("_items")))
    pages = materialize(pages.select(
        "invoice_no", "page", F.transform("_items", lambda s: F.struct(*[s[c].alias(c) for c in ITEM])).alias("items")))
    counts = pages.groupBy("invoice_no").agg(F.count(F.lit(1)).cast("int").alias("page_count"),
                                             F.sum(F.size("items")).alias("item_count"))
    item_type = pages.schema["items"].dataType
    docs = invoice.select(*HEADER).join(pages.join(counts, "invoice_no"), "invoice_no", "left")
    return docs.select(*HEADER, F.coalesce(F.col("page"), F.lit(0)).alias("page"),
                       F.coalesce(F.col("page_count"), F.lit(1)).alias("page_count"),
                       F.coalesce(F.col("item_count"), F.lit(0).cast("long")).alias("item_count"),
                       F.coalesce(F.col("items"), F.array().cast(item_type)).alias("items"))


def documents_json(docs: DataFrame) -> DataFrame:
    """The JSON text of each document page (``to_json``, JVM-side); every
    document has the same keys, NULLs included."""
    body = F.struct(*[F.col(c) for c in (*HEADER, "page", "page_count", "item_count", "items")])
    return docs.select("invoice_no", "page", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


# G-18
def combine_lines(items: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Merge lines of one invoice with the same lower(name) and price: sum
    quantity and total; name, unit and discount of the first line (faithful),
    plus the discount sum."""
    order = order or LINE_ORDER
    first = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                     F.col("name"), F.col("unit"), F.col("discount"))
    g = (items.groupBy("invoice_no", F.lower("name").alias("name_key"), "price")
         .agg(F.min(first).alias("_f"), F.sum("quantity").cast("long").alias("quantity"),
              F.sum("total").cast(R.WIDE_MONEY).alias("total"),
              F.sum("discount").cast(R.WIDE_MONEY).alias("discount_sum")))
    return g.select("invoice_no", "name_key", F.col("_f.name").alias("name"), "quantity",
                    F.col("_f.unit").alias("unit"), "price",
                    F.col("_f.discount").alias("discount"), "total", "discount_sum")


# G-19 (with H-11)
def invoice_print_totals(print_lines: DataFrame, gst: Decimal = GST_RATE) -> DataFrame:
    """Print totals per invoice from (invoice_no, quantity, price, discount_pct):
    amount = qty x price x (1 - pct/100); total excl. GST, GST, total incl."""
    amount = (F.col("quantity") * F.col("price") * (F.lit(100) - F.col("discount_pct"))
              * F.lit(Decimal("0.01")))
    t = print_lines.groupBy("invoice_no").agg(F.sum(amount).alias("_t"))
    return t.select("invoice_no",
                    F.round(F.col("_t"), 2).cast(R.WIDE_MONEY).alias("total_excl_gst"),
                    F.round(F.col("_t") * F.lit(gst), 2).cast(R.WIDE_MONEY).alias("gst"),
                    F.round(F.col("_t") * (F.lit(1) + F.lit(gst)), 2).cast(R.WIDE_MONEY)
                    .alias("total_incl_gst"))


# G-22
def invoice_draft_totals(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """Form totals: sum of line amounts, header discount from the percentage
    (H-10), final (H-3) and paid, per invoice."""
    s = lines.groupBy("invoice_no").agg(F.sum("total").cast(R.WIDE_MONEY).alias("lines_total"))
    h = headers.select("invoice_no", "discount_percent", "total_paid")
    j = s.join(h, "invoice_no", "inner")
    disc = F.round(F.col("lines_total") * F.col("discount_percent") * F.lit(Decimal("0.01")), 2) \
        .cast(R.WIDE_MONEY)
    return j.select("invoice_no", "lines_total", disc.alias("header_discount"),
                    (F.col("lines_total") - disc).cast(R.WIDE_MONEY).alias("final_amount"),
                    "total_paid")
