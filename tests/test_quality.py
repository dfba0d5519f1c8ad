"""Quality rules (Q-1..Q-8): SQL semantics of NULLs, uniqueness, limits."""

from decimal import Decimal as Dec

from tests.conftest import rows
from tillbook.operators import quality as q


def test_not_null_and_positive(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "x", None), (3, "y", 5)], "id int, name string, qty int")
    assert rows(q.check_not_null(df, ["name", "qty"]), "id", "reason") == [
        (1, "name is NULL"), (2, "qty is NULL")]
    # a CHECK (qty > 0) lets NULL pass
    assert rows(q.check_positive(df, ["qty"]), "id", "reason") == [(1, "qty must be > 0")]


def test_fk_and_domain_let_null_pass(spark):
    child = spark.createDataFrame([(1, 10), (2, None), (3, 99)], "id int, sup int")
    parent = spark.createDataFrame([(10,)], "sid int")
    assert rows(q.check_fk(child, "sup", parent, "sid"), "id") == [(3,)]
    t = spark.createDataFrame([(1, "Debit"), (2, None), (3, "Refund")], "id int, t string")
    assert rows(q.check_domain(t, "t", ("Debit", "Credit")), "id") == [(3,)]
    lv = spark.createDataFrame([(1, 0), (2, 3), (3, None)], "id int, lv int")
    assert rows(q.check_domain(lv, "lv", lo=1, hi=5), "id") == [(1,)]


def test_unique_length_required(spark):
    c = spark.createDataFrame([(1, "01"), (2, "01"), (3, None), (4, None), (5, "02")], "id int, m string")
    assert rows(q.check_unique(c, "m"), "id") == [(1,), (2,)]          # NULLs are not equal
    m = spark.createDataFrame([(1, "abcdef", Dec("100000000.00")), (2, "ab", Dec("99999999.99"))],
                              "id int, s string, a decimal(18,2)")
    assert rows(q.check_length(m, {"s": 5}, money=["a"]), "id", "reason") == [
        (1, "a out of NUMERIC(10,2) range"), (1, "s longer than 5")]
    f = spark.createDataFrame([(1, " ", "12a"), (2, "Ann", "0012")], "id int, name string, mobile string")
    assert rows(q.check_required(f, ["name"], digits=["mobile"]), "id", "reason") == [
        (1, "mobile must be digits"), (1, "name is required")]


def test_reconcile_totals(spark):
    inv = spark.createDataFrame([(1, Dec("10.00")), (2, Dec("5.00")), (3, Dec("0.00"))],
                                "invoice_no long, total_amount decimal(10,2)")
    lines = spark.createDataFrame([(1, Dec("9.99")), (2, Dec("4.50")), (2, Dec("0.48"))],
                                  "invoice_no long, total decimal(10,2)")
    # 0.01 off is accepted, 0.02 is not; an invoice without lines counts 0
    assert rows(q.reconcile_totals(inv, lines), "invoice_no", "difference") == [(2, Dec("0.02"))]
