"""Multi-operator jobs: the dashboard and the invoice-posting job."""

from tests.conftest import SF001
from tillbook.plans.dashboard import dashboard_for, run_all
from tillbook.sources.fixtures import AS_OF, Retail

REFERENCE_RESULTS = {"total_customers", "best_selling_products", "top_customers", "low_stock",
                     "reorder_stock", "total_revenue", "pending_payments",
                     "payment_mode_distribution", "daily_sales_trend"}
INVOICE_KPIS = {"total_sales_today", "total_sales_month", "total_sales_week", "total_orders",
                "average_order_value", "active_customers"}


def test_dashboard_has_all_fifteen_results(spark):
    r = Retail(spark, SF001)
    separate = dashboard_for(r, AS_OF, fused=False)
    assert set(separate) == REFERENCE_RESULTS | INVOICE_KPIS          # 15 results
    fused = dashboard_for(r, AS_OF)
    kpis = fused["invoice_kpis"].first().asDict()
    for name in INVOICE_KPIS:
        assert kpis[name] == separate[name].first()[0], name
    assert kpis["total_sales_today"] == 0                              # no orders on as_of at sf0.001
    timings = run_all(fused)
    assert set(timings) == set(fused)


def test_stored_tables_match_derived(spark):
    from tests.conftest import rows
    from tillbook.operators import ledger as lg
    from tillbook.plans.invoice_posting import post_invoices
    from tillbook.session import scratch_path
    from tillbook.sources.fixtures import StoredRetail
    r = Retail(spark, SF001)
    st = StoredRetail.build(spark, SF001, scratch_path(spark, "test-stored"))
    assert rows(st.invoice) == rows(r.invoice)
    cols = ("invoice_no", "step", "balance")
    assert rows(lg.post_ledger(st.invoice), *cols) == rows(r.ledger, *cols)
    items = st.lines.drop("total")
    out = post_invoices(st.invoice_draft, items, st.customer, st.inventory, st.product, batch_id="b1")
    assert out["ledger"].select("batch_id").distinct().collect()[0][0] == "b1"
    assert out["invoice"].count() + out["rejects"].select("invoice_no").distinct().count() \
        == st.invoice_draft.count()


def test_kpis_approx_distinct_close(spark):
    from tillbook.operators import reports as rp
    r = Retail(spark, "/root/testdata/sf0.01")
    exact = rp.dashboard_kpis(r.invoice, AS_OF).first()["active_customers"]
    approx = rp.dashboard_kpis(r.invoice, AS_OF, exact=False).first()["active_customers"]
    assert abs(approx - exact) <= max(2, 0.06 * exact)
