"""Bulk loads: first-wins de-dup, rejects, upserts (M-1, M-3, M-7..M-9, H-21)."""

from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tests.conftest import rows
from tillbook.operators import loads as ld


def customers(spark):
    return spark.createDataFrame([(1, "Old", "0000000001"), (2, "Zed", "5556667777")],
                                 "id long, name string, mobile string")


def test_import_customers_edge_cases(spark):
    file = spark.createDataFrame([
        (0, "John Doe", "1234567890", "123 Main St", "john@example.com"),
        (1, "John Again", " 1234567890 ", "x", "y"),          # same mobile, blanks: skipped
        (2, "Bob", "5556667777", "789 Elm St", "bob@example.com"),  # exists: skipped
        (3, "Zero", "0012345", "z", "z"),                     # leading zeros kept
    ], "ord long, name string, mobile string, address string, mail string")
    new, skipped = ld.import_customers(file, customers(spark))
    assert rows(new, "id", "name", "mobile") == [(3, "John Doe", "1234567890"), (4, "Zero", "0012345")]
    assert rows(skipped, "ord") == [(1,), (2,)]
    # importing the same file again adds nothing
    table = customers(spark).unionByName(new.select("id", "name", "mobile"))
    again, _ = ld.import_customers(file, table)
    assert again.count() == 0


def product_rows(spark):
    cols = ("ord long, pro_id long, pro_name string, cost_price string, selling_price string, "
            "quantity string, unit string, category string, safety_level string, expiry_date string, "
            "supplier_id string, terms_from_invoice string, hc_code string")
    return spark.createDataFrame([
        (0, 1, "Apple", "50.0", "70.0", "100", "kg", "Fruits", "1", "2025-12-31", "1", "t", "HC1"),
        (1, 9, "Ghost", "5", "6", "1", "kg", "X", "", "", "77", "t", ""),        # unknown supplier
        (2, 8, "Blank", "5", "6", "1", "kg", "X", "", "", "", "t", ""),          # blank supplier
        (3, 7, "Bad", "abc", "6", "1", "kg", "X", "", "", "1", "t", ""),         # text price
        (4, 5, "Sugar", "35", "50", "10", "kg", "G", "3", "", "1", "t", ""),     # new id
        (5, 5, "SUGAR", "36", "51", "5", "kg", "G", "3", "", "1", "t", ""),      # repeated id
    ], cols)


def test_import_products(spark):
    supplier = spark.createDataFrame([(1, "ABC")], "id int, name string")
    product = spark.createDataFrame([(1, "Apple", Dec("50.00"), Dec("70.00"), 20, "1")],
                                    "pro_id long, pro_name string, cost_price decimal(10,2), "
                                    "selling_price decimal(10,2), quantity int, safety_level string")
    inventory = spark.createDataFrame([(1, "Apple", 20, 1, 5)],
                                      "product_id long, product_name string, quantity int, "
                                      "safety_level int, availability int")
    p2, inv2, rej = ld.import_products(product_rows(spark), product, supplier, inventory)
    # existing id: only quantity += ; new id: first row's attributes, quantities summed
    assert rows(p2, "pro_id", "pro_name", "cost_price", "quantity") == [
        (1, "Apple", Dec("50.00"), 120), (5, "Sugar", Dec("35.00"), 15)]
    assert rows(inv2, "product_id", "quantity", "availability") == [(1, 120, 5), (5, 15, 5)]
    assert rows(rej, "ord", "reason") == [(1, "missing supplier"), (2, "missing supplier"),
                                          (3, "cost_price is not a number")]


def test_coerce_products_rejects_single_rows(spark):
    base = product_rows(spark).filter("ord in (0, 4)")
    bad = {"pro_id": ["abc", "1.5", None], "quantity": ["NaN", "1e12", "x"], "safety_level": ["1e12", "NaN"],
           "selling_price": ["1000000000", "NaN"], "cost_price": ["", "inf"], "expiry_date": ["soon"]}
    text = base.withColumn("pro_id", F.concat(F.lit("0"), F.col("pro_id").cast("string")))
    parts, n = [text], 100
    for c, values in bad.items():
        for v in values:
            parts.append(text.filter("ord = 0").withColumns({"ord": F.lit(n).cast("long"), c: F.lit(v).cast("string")}))
            n += 1
    from functools import reduce
    ok, rej = ld.coerce_products(reduce(lambda a, b: a.unionByName(b), parts))
    # a NaN safety level counts as 0, every other bad cell costs its own row only
    assert rows(ok, "ord", "pro_id", "safety_level") == [(0, 1, "1"), (4, 5, "3"), (107, 1, "0")]
    assert rej.count() == n - 100 - 1


def test_rows_without_a_name_or_mobile(spark):
    rows_ = spark.createDataFrame([(1, None, "A"), (2, "01", "B")], "ord long, mobile string, name string")
    cust, ids = ld.ensure_customers(rows_, customers(spark))
    assert cust.filter("mobile is null").count() == 0
    assert {(r["ord"], r["customer_id"]) for r in ids.collect()} == {(1, None), (2, 3)}
    new, skipped = ld.import_customers(rows_.withColumns({"address": F.lit("x"), "mail": F.lit("y")}), customers(spark))
    assert rows(new, "mobile") == [("01",)] and rows(skipped, "ord") == [(1,)]


def test_apply_updates_last_wins(spark):
    base = customers(spark)
    changes = spark.createDataFrame([(1, "A", 1), (1, "B", 2)], "id long, name string, ord int")
    out = ld.apply_updates(base, changes, "id", order="ord")
    assert rows(out, "id", "name", "mobile") == [(1, "B", "0000000001"), (2, "Zed", "5556667777")]


def test_delete_cascade_and_set_null(spark):
    keys = spark.createDataFrame([(1,)], "id long")
    lines = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "invoice_no long, product_id long")
    out = ld.delete_cascade(keys, "id", {"lines": (lines, "product_id")})["lines"]
    assert rows(out, "invoice_no") == [(11,), (12,)]
    inv = spark.createDataFrame([(10, 1), (11, 2)], "invoice_no long, customer_id long")
    out2 = ld.delete_set_null(keys, "id", inv, "customer_id")
    assert rows(out2.withColumn("c", F.coalesce("customer_id", F.lit(-1))), "invoice_no", "c") == [
        (10, -1), (11, 2)]


def test_rows_are_counted_as_they_are_written(spark, tmp_path):
    schema = "ord long, pro_id string, pro_name string, cost_price string, selling_price string, quantity string, " \
             "safety_level string, supplier_id string, expiry_date string, hc_code string, supplier_name string"
    good = ("5", "Sugar", "1", "2", "3", "4", "1", None, None, "stale")
    bad = [("x", "a", "1", "2", "3", "4", "1", None, None, None), ("6", "a", "?", "2", "3", "4", "9", None, None, None),
           ("6", "a", "1", "2", "3", "4", "9", None, None, None), ("6", "a", "1", "2", "3", "4", None, None, None, None)]
    supplier = spark.createDataFrame([(1, "ABC")], "id int, name string")
    rows_ = spark.createDataFrame([(i, *v) for i, v in enumerate([good, good, *bad])], schema).repartition(3)
    tagged = ld.tag_products(rows_, supplier)
    ok, rejects = ld.coerce_products(rows_)
    ok, missing = ld.enrich_supplier(ok, supplier)
    assert rows(tagged.filter("reason is null"), "ord", "supplier_name") == rows(ok, "ord", "supplier_name")
    assert rows(tagged.filter("reason is not null"), "ord", "reason") == sorted(
        rows(rejects, "ord", "reason") + rows(missing, "ord", "reason"))
    path = str(tmp_path / "load")
    for _ in range(2):                                # a batch that is run again replaces its rows
        counts = ld.write_tagged(tagged, path, "b1", ld.PRODUCT_REASONS)
        assert (counts["read"], counts["accepted"], counts["rejected"], counts["missing supplier"]) == (6, 2, 4, 2)
        assert counts["pro_id is not a whole number"] == counts["cost_price is not a number"] == 1
        assert spark.read.parquet(path).count() == 6
    fixed = tagged.filter("reason is null")
    assert ld.write_tagged(fixed, path, "b1")["rejected"] == 0
    assert ld.write_tagged(fixed.limit(0), path, "b2") == {"read": 0, "accepted": 0, "rejected": 0}
    assert spark.read.parquet(path).groupBy("batch_id", "outcome").count().collect() == [("b1", "accepted", 2)]
