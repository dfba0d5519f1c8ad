"""Column rules (H-*) against golden values and boundary tables."""

from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tillbook.functions import rules as R

# sample product file rows (pro_id, cost, sell, net_profit, profit %), copied as literals
SAMPLE_PRODUCTS = [
    (1, "50.0", "70.0", "20.0", "40.0"),
    (2, "30.0", "45.0", "15.0", "50.0"),
    (3, "5.0", "8.0", "3.0", "60.0"),
    (4, "40.0", "55.0", "15.0", "37.5"),
    (5, "35.0", "50.0", "15.0", "42.86"),
    (6, "10.0", "15.0", "5.0", "50.0"),
    (7, "25.0", "35.0", "10.0", "40.0"),
]


def test_profit_golden(spark):
    df = spark.createDataFrame(SAMPLE_PRODUCTS, "id int, cost string, sell string, np string, pp string")
    df = df.select("id", F.col("cost").cast("decimal(10,2)").alias("cost"),
                   F.col("sell").cast("decimal(10,2)").alias("sell"), "np", "pp")
    out = df.select("id", R.net_profit("sell", "cost").alias("n"),
                    R.profit_pct("sell", "cost").alias("p"), "np", "pp").collect()
    for r in out:
        assert r["n"] == Dec(r["np"]), r
        assert r["p"] == Dec(r["pp"]).quantize(Dec("0.01")), r


def test_profit_edges(spark):
    df = spark.createDataFrame([(0, Dec("10.00"), Dec("0.00")), (1, Dec("100.00"), Dec("1.00")),
                                (2, Dec("5.00"), Dec("10.00"))],
                               "id int, sell decimal(10,2), cost decimal(10,2)")
    got = {r["id"]: (r["form"], r["col"]) for r in df.select(
        "id", R.profit_pct("sell", "cost").alias("form"),
        R.profit_pct("sell", "cost", cap=None).alias("col")).collect()}
    assert got[0] == (Dec("0.00"), None)          # cost 0: form shows 0, column rejects
    assert got[1] == (Dec("999.99"), None)        # 9900 %: form caps, column cannot hold it
    assert got[2] == (Dec("-50.00"), Dec("-50.00"))


def test_availability_boundaries(spark):
    cases = [  # (qty, safety, expected level)
        (4, 4, 5), (17, 20, 4), (16, 20, 3), (1, 2, 3), (1, 4, 2), (0, 4, 1), (24, 100, 1),
        (25, 100, 2), (5, 0, 5), (0, 0, 5), (3, None, 5), (0, None, 1), (None, 5, 1), (None, None, 1),
    ]
    df = spark.createDataFrame(cases, "q int, s int, want int")
    for r in df.select("want", R.availability("q", "s").alias("got"), "q", "s").collect():
        assert r["got"] == r["want"], r


def test_availability_labels(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (2,), (3,), (4,), (5,)], "lv int")
    got = [(r[0], r[1], r[2]) for r in df.select(
        "lv", R.availability_label("lv", "page"), R.availability_label("lv", "trigger")).collect()]
    assert got == [(None, "Unknown", "Out of Stock"), (0, "Out of Stock", "Out of Stock"),
                   (1, "Low Stock", "Out of Stock"), (2, "Low Stock", "Low Stock"),
                   (3, "In Stock", "Low Stock"), (4, "In Stock", "In Stock"), (5, "In Stock", "In Stock")]


def test_payment_status(spark):
    cases = [(None, "10.00"), ("bitcoin", "10.00"), ("unpaid", "10.00"), ("cash", "0.00"),
             ("cash", "5.00"), ("upi", "1.00")]
    df = spark.createDataFrame(cases, "m string, p string").withColumn("p", F.col("p").cast("decimal(10,2)"))
    st = R.payment_status("m", "p")
    got = [(r[0], r[1], r[2]) for r in df.select(st["payment_status"], st["status"], st["total_paid"]).collect()]
    z = Dec("0.00")
    assert got == [("Unpaid", "Pending", z), ("Unpaid", "Pending", z), ("Unpaid", "Pending", z),
                   ("Unpaid", "Pending", z), ("Paid", "Completed", Dec("5.00")),
                   ("Paid", "Completed", Dec("1.00"))]


def test_text_rules(spark):
    df = spark.createDataFrame([("  0012 ", "", "7"), ("12a", None, " 3")], "m string, s string, t string")
    got = df.select(R.is_digits(R.clean_text("m")), R.safety_to_int("s"), R.safety_to_int("t")).collect()
    assert [tuple(r) for r in got] == [(True, None, 7), (False, None, 3)]


def test_signed_and_money_text(spark):
    df = spark.createDataFrame([("Debit", Dec("2.50")), ("Credit", Dec("1.25")), ("Other", Dec("9.99"))],
                               "t string, a decimal(10,2)")
    got = df.select(R.signed_amount("t", "a"), R.signed_amount("t", "a", "account"),
                    R.money_text("a")).collect()
    assert [tuple(r) for r in got] == [(Dec("2.50"), Dec("-2.50"), "2.50"),
                                       (Dec("-1.25"), Dec("1.25"), "1.25"),
                                       (Dec("0.00"), Dec("0.00"), "9.99")]
