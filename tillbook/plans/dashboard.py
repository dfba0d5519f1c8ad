"""The dashboard: all 15 results of the reference's front page (G-1..G-13,
B-7, B-8) as DataFrames.

The reference sends 15 SQL strings one after another, nine of them scanning
``invoice``.  Here the six invoice KPIs come from one fused scan (G-14);
the rest are independent plans the caller may run concurrently.  Every
top-k carries a tie-breaker and every period uses ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillbook.operators import reports as rp


def dashboard(customer: DataFrame, invoice: DataFrame, lines: DataFrame, product: DataFrame,
              inventory: DataFrame, payment: DataFrame, as_of: str,
              fused: bool = True) -> dict[str, DataFrame]:
    out: dict[str, DataFrame] = {"total_customers": rp.total_customers(customer)}
    if fused:
        out["invoice_kpis"] = rp.dashboard_kpis(invoice, as_of)
    else:
        out.update({
            "total_sales_today": rp.total_sales_today(invoice, as_of),
            "total_sales_month": rp.total_sales_month(invoice, as_of),
            "total_sales_week": rp.total_sales_week(invoice, as_of),
            "total_orders": rp.total_orders(invoice),
            "average_order_value": rp.average_order_value(invoice),
            "active_customers": rp.active_customers(invoice, as_of),
        })
    out.update({
        "best_selling_products": rp.best_selling_products(lines, product, 5),
        "top_customers": rp.top_customers(invoice, customer, 5),
        "low_stock": rp.low_stock(inventory, 10),
        "reorder_stock": rp.reorder_stock(inventory, 5),
        "total_revenue": rp.total_revenue(payment, as_of),
        "pending_payments": rp.pending_payments(invoice, payment),
        "payment_mode_distribution": rp.payment_mode_distribution(payment),
        "daily_sales_trend": rp.daily_sales_trend(invoice, as_of),
    })
    return out


def dashboard_for(retail, as_of: str, fused: bool = True) -> dict[str, DataFrame]:
    """The dashboard over a :class:`tillbook.sources.fixtures.Retail`."""
    r = retail
    return dashboard(r.customer, r.invoice, r.lines, r.product, r.inventory, r.payment, as_of, fused)


def run_all(results: dict[str, DataFrame], sink=None, workers: int = 4) -> dict[str, float]:
    """Execute the independent dashboard plans concurrently (one Spark job
    each, submitted from a small thread pool); returns seconds per result.

    ``sink(df)`` executes one plan; the default writes to the ``noop`` sink,
    i.e. runs it to completion without moving rows to the driver.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    def default_sink(df):
        df.write.format("noop").mode("overwrite").save()
    sink = sink or default_sink

    def one(item):
        name, df = item
        t0 = time.perf_counter()
        sink(df)
        return name, time.perf_counter() - t0
    with ThreadPoolExecutor(max_workers=workers) as pool:
        return dict(pool.map(one, results.items()))
