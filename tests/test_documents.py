"""Invoice documents, combined lines, print totals (A-11, G-18, G-19)."""

from decimal import Decimal as Dec

from tests.conftest import rows
from tillbook.operators import documents as dc


def test_combine_lines(spark):
    items = spark.createDataFrame([
        (1, 1, 10, "Milk", 2, "l", Dec("3.00"), Dec("0.00"), Dec("6.00")),
        (1, 2, 11, "milk", 1, "l", Dec("3.00"), Dec("0.50"), Dec("2.50")),
        (1, 3, 12, "Milk", 1, "l", Dec("4.00"), Dec("0.00"), Dec("4.00")),
    ], "invoice_no long, line_no int, product_id long, name string, quantity int, unit string, "
       "price decimal(10,2), discount decimal(10,2), total decimal(10,2)")
    out = dc.combine_lines(items)
    assert rows(out, "name", "quantity", "price", "discount", "total", "discount_sum") == [
        ("Milk", 1, Dec("4.00"), Dec("0.00"), Dec("4.00"), Dec("0.00")),
        ("Milk", 3, Dec("3.00"), Dec("0.00"), Dec("8.50"), Dec("0.50"))]


def test_documents_pages_and_empty(spark):
    inv = spark.createDataFrame([(1, "A", "01", "2024-01-01", Dec("9.00"), "Completed", "Paid"),
                                 (2, "B", "02", "2024-01-02", Dec("1.00"), "Pending", "Unpaid")],
                                "invoice_no long, customer_name string, customer_mobile string, "
                                "date string, final_amount decimal(10,2), status string, payment_status string")
    lines = spark.createDataFrame([(1, i, 10 + i, 1, Dec("3.00"), Dec("0.00"), Dec("3.00")) for i in range(5)]
                                  + [(1, 9, 99, 1, Dec("1.00"), Dec("0.00"), Dec("1.00"))],
                                  "invoice_no long, line_no int, product_id long, quantity int, "
                                  "price decimal(10,2), discount decimal(10,2), total decimal(10,2)")
    product = spark.createDataFrame([(10 + i, f"P{i}") for i in range(5)], "pro_id long, pro_name string")
    docs = dc.invoice_documents(inv, lines, product, page_size=2)
    got = sorted((r["invoice_no"], r["page"], r["page_count"], r["item_count"], [i["name"] for i in r["items"]])
                 for r in docs.collect())
    # line of the unknown product 99 drops out; pages of at most 2 items
    assert got == [(1, 0, 3, 5, ["P0", "P1"]), (1, 1, 3, 5, ["P2", "P3"]), (1, 2, 3, 5, ["P4"]), (2, 0, 1, 0, [])]
    texts = {(r["invoice_no"], r["page"]): r["json"] for r in dc.documents_json(docs).collect()}
    assert texts[2, 0].endswith('"page":0,"page_count":1,"item_count":0,"items":[]}')
    assert '"unit":null' in texts[1, 2]                       # every document has every key


def test_print_totals(spark):
    pl = spark.createDataFrame([(1, 2, Dec("10.00"), Dec("10.00")), (1, 1, Dec("5.55"), Dec("0.00"))],
                               "invoice_no long, quantity int, price decimal(10,2), discount_pct decimal(5,2)")
    r = dc.invoice_print_totals(pl).first()
    assert (r["total_excl_gst"], r["gst"], r["total_incl_gst"]) == (Dec("23.55"), Dec("2.36"), Dec("25.91"))
