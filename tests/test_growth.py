"""Work that must not grow faster than the input: what plans and files hold."""

import datetime as dt
import glob
import re
import uuid
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tests.conftest import SF001, rows
from tillbook.llm import language_id
from tillbook.operators import greedy
from tillbook.operators import ledger as lg
from tillbook.operators import loads as ld
from tillbook.operators import posting as ps
from tillbook.operators import stock as st
from tillbook.operators import substrings as sub
from tillbook.operators.skew import join_per_key
from tillbook.plans.invoice_posting import post_invoices
from tillbook.sources.fixtures import Retail
from tillbook.sources.layouts import ByInvoice
from tillbook.streaming import streams as sm


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_given_counts_replace_the_count(spark):
    facts = spark.range(3000).select((F.col("id") % 2).alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k long, id long"))
    per_key = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    counts = spark.createDataFrame([(0, 1500), (1, 1500), (None, 1)], "k long, _n long")
    for how in ("left", "inner"):
        assert rows(join_per_key(facts, per_key, ["k"], how, counts=counts).filter("id >= 0")) == \
            rows(join_per_key(facts, per_key, ["k"], how).filter("id >= 0"))


def test_language_plan_holds_each_join_once(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")],
                                 "doc_id long, text string, lang string")
    pages = spark.range(1300).select(F.col("id").alias("page_id"), F.lit("http://a.b.com/x").alias("url"),
                                     F.lit("<html lang=en><p>the cat</p></html>").alias("html"))
    found = language_id.identify(pages, docs)
    assert len(re.findall(r"Exchange", plan(found))) < 60
    assert found.count() == 1300 and found.filter("lang <> 'en'").count() == 0


def test_buckets_follow_the_rows(spark, tmp_path):
    r = Retail(spark, SF001)
    store = ByInvoice(spark, f"grown_{uuid.uuid4().hex}", str(tmp_path), buckets=2, heavy_rows=6, bucket_rows=1000)
    store.create({"invoice": r.invoice, "lines": r.lines})
    assert store.buckets == -(-r.lines.count() // 1000) > 2
    want = ps.recompute_invoice_total(r.invoice, r.lines)
    got = store.apply(ps.recompute_invoice_total, "invoice", "lines").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_product_cells_are_parsed_once(spark):
    cells = spark.createDataFrame(
        [("1", " 2.5 ", "3", "4", "", "7", "2001-01-01", " "), ("x", "1", "1", "1", "1", "1", "", "h"),
         ("2", "NaN", "1", "1", "1", "1", "", "h")],
        "pro_id string, cost_price string, selling_price string, quantity string, safety_level string, "
        "supplier_id string, expiry_date string, hc_code string")
    ok, rejects = ld.coerce_products(cells)
    for df in (ok, rejects):
        assert "Scan parquet" in plan(df) and "trim(" not in plan(df)
    assert [(r["pro_id"], str(r["cost_price"]), r["safety_level"], r["hc_code"]) for r in ok.collect()] == \
        [(1, "2.50", "0", None)]
    assert rows(rejects, "reason") == [("cost_price is not a number",), ("pro_id is not a whole number",)]


def test_numbered_restock_rows_are_made_once(spark):
    r = Retail(spark, SF001)
    for df in st.restock(r.add_item, r.inventory, r.product, None,
                         ["added_date", "ref_order", "ref_line", "product_id", "quantity_added"])[:2]:
        assert "Window" not in plan(df) and "Join" not in plan(df)


def test_trigrams_are_made_once(spark, tmp_path, monkeypatch):
    made = []
    whole = sub.materialize
    monkeypatch.setattr(sub, "materialize", lambda df: made.append(df.rdd.getNumPartitions()) or whole(df))
    names = spark.createDataFrame([(i, f"name {i}") for i in range(50)], "id long, name string").coalesce(1)
    index = sub.TrigramIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(names, "id", ["name"])
    assert made == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    assert rows(index.narrow(names, "id", "name", "e 7"), "id") == [(7,)]


def test_feed_files_follow_the_rows(spark, tmp_path, monkeypatch):
    df = spark.range(400, numPartitions=40).select("id", (F.col("id") % 2).alias("p"))
    path = sm.write_feed(df, str(tmp_path / "feed"), "p")
    assert len(glob.glob(f"{path}/part-*")) == 2
    monkeypatch.setattr(sm, "FEED_ROWS", 50)
    path = sm.write_feed(df, str(tmp_path / "more"), "p")
    assert len(glob.glob(f"{path}/part-*")) == 8 and rows(spark.read.parquet(path)) == [(i,) for i in range(400)]


def test_late_entry_leaves_earlier_partitions_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "new_root", lambda *_: str(tmp_path / "root"))
    invoice = Retail(spark, SF001).invoice
    days = [r[0] for r in invoice.select("date").distinct().orderBy("date").collect()]
    first, second = days[len(days) // 3], days[2 * len(days) // 3]
    feed = str(tmp_path / "feed")
    for part in (F.col("date") < first, F.col("date") >= second, (F.col("date") >= first) & (F.col("date") < second)):
        invoice.filter(part).coalesce(1).write.mode("append").parquet(feed)
    got = sm.stream_ledger(spark, feed, invoice, max_files=1, buckets=2)
    want = lg.post_ledger(invoice)
    assert rows(got, *want.columns) == rows(want)

    def jobs(batch):
        return {re.search(r"part-\d+-([0-9a-f-]{36})", f)[1] for f in
                glob.glob(f"{tmp_path}/root/entries/bucket=*/batch_id={batch}/part-*")}

    assert jobs(0) and not jobs(0) & jobs(2)      # written by the first batch, not again by the third
    assert jobs(1) == jobs(2)
    assert isinstance(first, dt.date)


def test_claims_that_do_not_compete_need_no_loop(spark, monkeypatch):
    folds = []
    fold = greedy._in_order
    monkeypatch.setattr(greedy, "_in_order", lambda *a: folds.append(1) or fold(*a))
    data = [(c, r, 1, 1) for c in range(500) for r in (2 * c, 2 * c + 1)]
    df = spark.createDataFrame(data, "claim long, res long, need long, room long")
    out = greedy.accept_in_order(df, ["claim"], "res", "need", "room", 100).collect()
    assert sorted(r["claim"] for r in out if r["accepted"]) == list(range(500))
    assert not folds


def test_a_claim_without_a_number_takes_its_resource(spark):
    # NULL is served first; the last claim asks for the same resource
    data = [(c, r, 1, 1) for c in range(100) for r in (2 * c, 2 * c + 1)]
    data += [(None, 198, 1, 1), (None, 1000, 1, 1)]
    df = spark.createDataFrame(data, "claim long, res long, need long, room long")
    out = {r["claim"]: r["accepted"] for r in greedy.accept_in_order(df, ["claim"], "res", "need", "room", 40).collect()}
    assert out == {c: True for c in [None, *range(99)]} | {99: False}


def test_posted_invoices_are_checked_once(spark, tmp_path):
    header = (dt.date(2024, 1, 1), "5", "Bob", "0001", "Ann", Dec("10.00"), 0, Dec("0.00"), Dec("10.00"), "cash")
    spark.createDataFrame([(1, *header, Dec("10.00")), (2, *header, Dec("10.00")), (3, *header, Dec("0.00"))],
                          "invoice_no long, date date, terms string, sale_by string, customer_mobile string, "
                          "customer_name string, total_amount decimal(10,2), discount_percent int, discount decimal(10,2), "
                          "final_amount decimal(10,2), payment_method string, total_paid decimal(10,2)") \
        .write.parquet(f"{tmp_path}/headers")
    spark.createDataFrame([(i, 1, 1, 6, Dec("1.00"), Dec("0.00")) for i in (1, 2, 3)],
                          "invoice_no long, line_no int, product_id long, quantity int, price decimal(10,2), discount decimal(10,2)") \
        .write.parquet(f"{tmp_path}/items")
    customer = spark.createDataFrame([(1, "Ann", "0001")], "id long, name string, mobile string")
    inventory = spark.createDataFrame([(1, 10, "pcs", 5, 5)],
                                      "product_id long, quantity int, unit string, safety_level int, availability int")
    product = spark.createDataFrame([(1, 10, "5")], "pro_id long, quantity int, safety_level string")
    out = post_invoices(spark.read.parquet(f"{tmp_path}/headers"), spark.read.parquet(f"{tmp_path}/items"),
                        customer, inventory, product)
    assert rows(out["lines"], "invoice_no", "quantity") == [(1, 6)]
    assert rows(out["rejects"]) == [(2, "insufficient stock"), (3, "paid method needs total_paid > 0")]
    # whatever is derived reads what was written, not the submitted tables
    for name in ("invoice", "lines", "inventory", "rejects"):
        assert not [f for f in out[name].inputFiles() if f"{tmp_path}/" in f]
