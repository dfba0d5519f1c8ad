"""The key graph: order, checks, and deletes through several levels."""

import pytest

from tests.conftest import rows
from tillbook.operators import references as ref


def graph(spark):
    make = spark.createDataFrame
    return {
        "customer": make([(1, "01"), (2, "02")], "id long, mobile string"),
        "invoice": make([(10, 1), (11, 2), (12, None)], "invoice_no long, customer_id int"),
        "lines": make([(10, 1, 5), (10, 2, 6), (11, 1, 5), (99, 1, 7)], "invoice_no long, line_no int, product_id long"),
        "payment": make([(10, 1), (11, 2)], "invoice_no long, amount int"),
        "ledger": make([("01", 1), ("01", 2), ("02", 3), ("77", 4)], "customer_mobile string, entry int"),
        "product": make([(5, 1), (6, None)], "pro_id long, supplier_id int"),
        "supplier": make([(1,)], "id long"),
    }


def test_parents_come_first():
    order = ref.in_order()
    assert len(ref.REFERENCES) == 11 and len(order) == 10
    assert all(order.index(r.parent) < order.index(r.child) for r in ref.REFERENCES)
    with pytest.raises(ValueError, match="cycle"):
        ref.in_order((ref.Reference("a", "x", "b", "y", "cascade"), ref.Reference("b", "x", "a", "y", "cascade")))


def test_violations(spark):
    assert rows(ref.violations(graph(spark)), "child", "column", "value", "rows") == [
        ("ledger", "customer_mobile", "77", 1), ("lines", "invoice_no", "99", 1), ("lines", "product_id", "7", 1)]


def test_deletes_follow_the_graph(spark):
    t = graph(spark)
    out = ref.delete(t, "invoice", spark.createDataFrame([(10,), (10,), (12,)], "k long"), "invoice_no")
    assert sorted(out) == ["invoice", "lines", "payment"]
    assert rows(out["invoice"], "invoice_no") == [(11,)] and rows(out["payment"], "invoice_no") == [(11,)]
    assert rows(out["lines"], "invoice_no", "line_no") == [(11, 1), (99, 1)]
    out = ref.delete(t, "customer", spark.createDataFrame([(1,)], "k int"), "id")
    assert sorted(out) == ["customer", "invoice", "ledger"]        # invoices stay, so their lines do
    assert sorted(out["invoice"].collect(), key=lambda r: r[0]) == [(10, None), (11, 2), (12, None)]
    assert rows(out["ledger"], "entry") == [(3,), (4,)]
    out = ref.delete(t, "supplier", spark.createDataFrame([(1,)], "k long"), "id")
    assert sorted(out) == ["product", "supplier"]
    assert sorted(out["product"].collect()) == [(5, None), (6, None)]


def test_deletes_through_levels(spark):
    refs = (ref.Reference("b", "a", "a", "id", "cascade"), ref.Reference("c", "b", "b", "id", "cascade"),
            ref.Reference("d", "c", "c", "id", "set null"), ref.Reference("c", "a", "a", "id", "set null"))
    make = spark.createDataFrame
    t = {"a": make([(1,), (2,)], "id long"), "b": make([(10, 1), (20, 2)], "id long, a long"),
         "c": make([(100, 10, 2), (200, 20, 1)], "id long, b long, a long"), "d": make([(7, 100), (8, 200)], "id long, c long")}
    out = ref.delete(t, "a", make([(1,)], "k long"), "id", refs)
    assert rows(out["b"]) == [(20, 2)] and [tuple(r) for r in out["c"].collect()] == [(200, 20, None)]
    assert sorted([tuple(r) for r in out["d"].collect()]) == [(7, None), (8, 200)]
    assert rows(ref.delete(t, "a", make([], "k long"), "id", refs)["c"]) == rows(t["c"])
