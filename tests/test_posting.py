"""Invoice validation, stock checks, ledger invariants (P-1, P-3, P-7, G-15)."""

import random
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tests.conftest import SF001, rows
from tillbook.operators import ledger as lg
from tillbook.operators import quality as q
from tillbook.operators import stock as st
from tillbook.sources.fixtures import Retail


def headers(spark):
    return spark.createDataFrame([
        (1, "2024-01-01", "5", "Bob", "0001", "Ann", Dec("100.00"), 10, Dec("10.00"), Dec("90.00"), "cash", Dec("90.00")),
        (2, "2024-01-01", "5", "Bob", "0001", "Ann", Dec("100.00"), 10, Dec("10.01"), Dec("89.99"), "cash", Dec("89.99")),
        (3, "2024-01-01", "5", "Bob", "0001", "Ann", Dec("100.00"), 10, Dec("10.02"), Dec("89.98"), "cash", Dec("89.98")),
        (4, "2024-01-01", "5", "Bob", "0001", "Ann", Dec("100.00"), 0, Dec("0.00"), Dec("100.00"), "cash", Dec("0.00")),
        (5, "2024-01-01", "5", "Bob", "0001", "Ann", Dec("100.00"), 0, Dec("0.00"), Dec("100.00"), "unpaid", Dec("50.00")),
        (6, "2024-01-01", "", "Bob", "0001", "Ann", Dec("100.00"), 0, Dec("0.00"), Dec("100.00"), "unpaid", Dec("0.00")),
    ], "invoice_no long, date string, terms string, sale_by string, customer_mobile string, "
       "customer_name string, total_amount decimal(10,2), discount_percent int, discount decimal(10,2), "
       "final_amount decimal(10,2), payment_method string, total_paid decimal(10,2)")


def test_validate_invoices(spark):
    lines = spark.createDataFrame([(i,) for i in range(1, 7)], "invoice_no long")
    ok, rej = q.validate_invoices(headers(spark), lines)
    assert rows(ok, "invoice_no", "total_paid") == [(1, Dec("90.00")), (2, Dec("89.99")),
                                                    (5, Dec("0.00"))]
    assert rows(rej, "invoice_no", "reason") == [
        (3, "discount does not match percentage"), (4, "paid method needs total_paid > 0"),
        (6, "required field missing or no product")]


def test_stock_check_modes(spark):
    inv = spark.createDataFrame([(1, 10), (2, None)], "product_id long, quantity int")
    items = spark.createDataFrame([(100, 1, 1, 6), (100, 2, 1, 6), (101, 1, 3, 1), (102, 1, 2, 1)],
                                  "invoice_no long, line_no int, product_id long, quantity int")
    line = {r["invoice_no"]: r["invoice_ok"] for r in st.stock_verdicts(items, inv, "line").collect()}
    cum = {r["invoice_no"]: r["invoice_ok"] for r in st.stock_verdicts(items, inv, "cumulative").collect()}
    assert line == {100: True, 101: False, 102: False}      # each line alone fits: oversells
    assert cum == {100: False, 101: False, 102: False}      # together 12 > 10


def slow_sequential(items, stock):
    left, out = dict(stock), {}
    for inv in sorted({i for i, *_ in items}):
        need = {}
        for i, _, p, q in items:
            if i == inv:
                need[p] = None if q is None or (p in need and need[p] is None) else need.get(p, 0) + q
        out[inv] = all(n is not None and left.get(p) is not None and n <= left[p] for p, n in need.items())
        if out[inv]:
            for p, n in need.items():
                left[p] -= n
    return out


def test_stock_check_sequential_equals_the_loop(spark):
    inv = spark.createDataFrame([(1, 10)], "product_id long, quantity int")
    items = spark.createDataFrame([(1, 1, 1, 50), (2, 1, 1, 3)], "invoice_no long, line_no int, product_id long, quantity int")
    assert rows(st.stock_verdicts(items, inv), "invoice_no", "invoice_ok") == [(1, False), (2, True)]
    rnd = random.Random(4)
    stock = {p: rnd.randrange(0, 40) for p in range(6)} | {6: None}
    data = [(i, k, rnd.randrange(8), rnd.choice([None, *range(1, 15)] if i % 20 == 0 else range(1, 15)))
            for i in range(80) for k in range(rnd.randrange(1, 4))]
    out = st.stock_verdicts(spark.createDataFrame(data, "invoice_no long, line_no int, product_id long, quantity int"),
                            spark.createDataFrame(list(stock.items()), "product_id long, quantity int"))
    assert {r["invoice_no"]: r["invoice_ok"] for r in out.collect()} == slow_sequential(data, stock)


def test_rejected_payment_changes_nothing(spark):
    invoice = spark.createDataFrame([(1, 7, "Unpaid"), (2, 7, "Unpaid"), (3, 8, "Paid")],
                                    "invoice_no long, customer_id long, payment_status string")
    ledger = spark.createDataFrame([(7, "Debit", Dec("100.00"))], "customer_id long, transaction_type string, amount decimal(10,2)")
    pay = spark.createDataFrame([(1, 1, "2024-01-01", Dec("500.00")), (2, 1, "2024-01-02", Dec("40.00")),
                                 (3, 2, "2024-01-03", Dec("60.00")), (4, 2, "2024-01-03", Dec("0.01")),
                                 (5, 3, "2024-01-03", Dec("1.00"))],
                                "payment_id long, invoice_no long, invoice_date string, amount decimal(10,2)") \
        .withColumn("invoice_date", F.col("invoice_date").cast("date"))
    credits, rejects, paid = lg.log_payments(pay, invoice, ledger)
    assert rows(credits, "invoice_no", "amount", "balance") == [(1, Dec("40.00"), Dec("60.00")), (2, Dec("60.00"), Dec("0.00"))]
    assert rows(rejects, "amount", "reason") == [
        (Dec("0.01"), "payment exceeds balance"), (Dec("1.00"), "invoice already paid"),
        (Dec("500.00"), "payment exceeds balance")]
    assert rows(paid) == [(2,)]


def test_availability_comes_from_the_product(spark):
    inventory = spark.createDataFrame([(1, 25, 20, 5), (2, 25, 20, 5)],
                                      "product_id long, quantity int, safety_level int, availability int")
    product = spark.createDataFrame([(1, 25, "40"), (2, 25, None)], "pro_id long, quantity int, safety_level string")
    sold = st.apply_sales(inventory, spark.createDataFrame([(1, 5)], "product_id long, quantity int"), product)
    # 20 of a safety level of 40: level 3; product 2 was not touched
    assert rows(sold, "product_id", "quantity", "safety_level", "availability") == [(1, 20, 40, 3), (2, 25, 20, 5)]
    assert rows(st.mirror_quantity(sold, product), "pro_id", "quantity") == [(1, 20), (2, 25)]


def test_ledger_invariants(spark):
    r = Retail(spark, SF001)
    led = r.ledger
    # final running balance per customer == signed sum of its entries
    last = lg.latest_balance(led)
    total = lg.ledger_balance(led)
    assert rows(last) == rows(total)
    # one Debit per invoice, Credits only for paid invoices
    n_inv = r.invoice.count()
    assert led.filter("transaction_type = 'Debit'").count() == n_inv
    paid = r.invoice.filter("payment_status = 'Paid' and total_paid > 0").count()
    assert led.filter("transaction_type = 'Credit'").count() == paid


def test_ledger_with_opening_continues(spark):
    r = Retail(spark, SF001)
    cut = F.lit("1998-01-01").cast("date")
    old = r.invoice.filter(F.col("date") < cut)
    new = r.invoice.filter(F.col("date") >= cut)
    opening = lg.ledger_balance(lg.post_ledger(old)).withColumnRenamed("balance", "opening_balance")
    split = lg.post_ledger(new, opening).select("invoice_no", "step", "balance")
    whole = lg.post_ledger(r.invoice).filter(F.col("transaction_date") >= cut.cast("timestamp_ntz"))
    assert rows(split) == rows(whole.select("invoice_no", "step", "balance"))
