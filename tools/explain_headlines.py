"""Print the physical-plan shape of the headline queries over stored tables.

Usage: python tools/explain_headlines.py [SF_DIR]   (default sf0.1)

For each query: exchanges (shuffles), broadcast exchanges, join kinds,
aggregates, and every scan's pushed filters and read schema.
"""

from __future__ import annotations

import io
import os
import re
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillbook.catalog.loads import existing_products, product_file  # noqa: E402
from tillbook.catalog.stock import LINE_ORDER, sales_batch  # noqa: E402
from tillbook.operators import ledger, loads, reports, stock  # noqa: E402
from tillbook.session import local_session, scratch_path  # noqa: E402
from tillbook.sources.fixtures import AS_OF, StoredRetail  # noqa: E402


def shape(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    nodes = re.findall(r"^\(\d+\) (\w[\w ]*?)\s*$", text, re.M)
    count = {}
    for n in nodes:
        count[n] = count.get(n, 0) + 1
    keep = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
            "ShuffledHashJoin", "HashAggregate", "SortAggregate", "Window", "TakeOrderedAndProject",
            "Scan parquet")
    lines = [", ".join(f"{k} x{count[k]}" for k in keep if k in count)]
    for m in re.finditer(r"^\(\d+\) Scan parquet.*?(?=^\(\d+\))", text, re.M | re.S):
        block = m.group(0)
        pf = re.search(r"PushedFilters: (.*)", block)
        rs = re.search(r"ReadSchema: (.*)", block)
        lines.append(f"  scan: filters={pf.group(1) if pf else '[]'} schema={rs.group(1) if rs else '?'}")
    return "\n".join(lines)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8, 8, app="tillbook-explain")
    st = StoredRetail.build(spark, sf, scratch_path(spark, f"explain-{os.getpid()}"))
    p2, inv2, _rej = loads.import_products(product_file(st), existing_products(st), st.supplier,
                                           st.inventory)
    plans = {
        "dashboard_kpis (G-14)": reports.dashboard_kpis(st.invoice, AS_OF),
        "total_sales_today (G-2)": reports.total_sales_today(st.invoice, AS_OF),
        "best_selling_products (G-8)": reports.best_selling_products(st.lines, st.product),
        "top_customers (G-9)": reports.top_customers(st.invoice, st.customer),
        "post_ledger (P-7)": ledger.post_ledger(st.invoice),
        "import_products product' (M-3)": p2,
        "import_products inventory' (M-3)": inv2,
        "check_stock cumulative (P-3)": stock.stock_verdicts(sales_batch(st), st.inventory,
                                                             "cumulative", LINE_ORDER),
    }
    for name, df in plans.items():
        print(f"### {name}\n{shape(df)}\n")
    spark.stop()


if __name__ == "__main__":
    main()
