"""Streams: late rows counted; stream == batch twin; what a late row rewrites."""

import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, rows
from tillbook.operators import ledger as lg
from tillbook.sources.fixtures import Retail
from tillbook.streaming import deltas
from tillbook.streaming import streams as sm
from tillbook.streaming.deltas import Deltas


def test_daily_sales_counts_late_rows(spark):
    d = dt.date
    batches = [
        [(1, d(2024, 1, 10), Dec("5.00")), (2, d(2024, 1, 11), Dec("7.00"))],
        [(3, d(2024, 1, 20), Dec("1.00"))],
        [(5, d(2024, 1, 20), Dec("2.00"))],
        [(4, d(2024, 1, 10), Dec("100.00"))],        # ten days late
    ]
    schema = "invoice_no long, date date, final_amount decimal(10,2)"
    path = sm.new_root(spark, "feed-late")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    like = spark.createDataFrame([], schema)
    out = sm.stream_daily_sales(spark, path, like, max_files=1)
    assert rows(out) == [(d(2024, 1, 10), Dec("105.00")), (d(2024, 1, 11), Dec("7.00")),
                         (d(2024, 1, 20), Dec("3.00"))]


def test_stream_ledger_equals_batch(spark):
    r = Retail(spark, SF001)
    from pyspark.sql import functions as F
    path = sm.new_root(spark, "feed-ledger")
    sm.write_feed(r.invoice.withColumn("_part", F.year("date")), path, "_part")
    out = sm.stream_ledger(spark, path, r.invoice, max_files=2)
    cols = ("invoice_no", "step", "balance")
    assert rows(out, *cols) == rows(lg.post_ledger(r.invoice), *cols)


def test_stream_ledger_out_of_order(spark):
    from decimal import Decimal as Dec
    d = dt.date
    schema = ("invoice_no long, customer_id long, customer_name string, customer_mobile string, "
              "date date, final_amount decimal(10,2), total_paid decimal(10,2), payment_status string")
    batches = [
        [(10, 1, "A", "01", d(2024, 1, 10), Dec("100.00"), Dec("0.00"), "Unpaid"),
         (11, 2, "B", "02", d(2024, 1, 11), Dec("50.00"), Dec("50.00"), "Paid")],
        [(12, 1, "A", "01", d(2024, 1, 5), Dec("30.00"), Dec("10.00"), "Paid"),    # older than posted
         (13, 2, "B", "02", d(2024, 1, 20), Dec("5.00"), Dec("0.00"), "Unpaid")],  # in order
    ]
    path = sm.new_root(spark, "feed-ooo")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    like = spark.createDataFrame([], schema)
    out = sm.stream_ledger(spark, path, like, max_files=1)
    allrows = spark.createDataFrame(batches[0] + batches[1], schema)
    cols = ("invoice_no", "step", "transaction_type", "balance")
    assert rows(out, *cols) == rows(lg.post_ledger(allrows), *cols)
    # A: Jan 5 debit 30, credit 10, then Jan 10 debit 100 -> 120
    assert rows(out.filter("customer_mobile = '01'"), "invoice_no", "step", "balance") == [
        (10, 0, Dec("120.00")), (12, 0, Dec("30.00")), (12, 1, Dec("20.00"))]


def test_customers_within_watermark(spark):
    t = dt.datetime
    schema = "ord long, name string, mobile string, ts timestamp"
    batches = [[(1, "A", " 01 ", t(2024, 1, 1, 9)), (2, "A2", "01", t(2024, 1, 1, 10)),
                (3, "Old", "99", t(2024, 1, 1, 11))],
               [(4, "A3", "01", t(2024, 1, 1, 12)), (5, "B", "02", t(2024, 1, 2))]]
    path = sm.new_root(spark, "feed-cust-wm")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    existing = spark.createDataFrame([("99",)], "mobile string")
    out = sm.stream_customers_within(spark, path, spark.createDataFrame([], schema), existing,
                                     sm.new_root(spark, "out-cust-wm"), delay="1 day", max_files=1)
    got = rows(out, "mobile")
    assert got == [("01",), ("02",)]
    assert out.filter("mobile = '01'").count() == 1


def test_stream_customers_late_smaller_ord(spark):
    schema = "ord long, name string, mobile string, address string, mail string"
    batches = [[(5, "A5", "01", "x", "y"), (6, "B6", "02", "x", "y")],
               [(3, "A3", " 01", "x", "y"), (7, "C7", "03", "x", "y"), (9, "B9", "02", "x", "y")]]
    path = sm.new_root(spark, "feed-cust-late")
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    existing = spark.createDataFrame([("03",)], "mobile string")
    out = sm.stream_customers(spark, path, spark.createDataFrame([], schema), existing, max_files=1)
    assert rows(out, "mobile", "ord", "name") == [("01", 3, "A3"), ("02", 6, "B6")]


def test_stock_position_sums_deltas(spark):
    inv = spark.createDataFrame([(1, 10, 5), (2, None, 5), (3, 4, 0)],
                                "product_id long, quantity int, safety_level int")
    moves = sm.stock_table(spark, sm.new_root(spark, "deltas"))
    for b, data in enumerate([[(1, -3), (2, 4)], [(1, -2), (3, 1)]]):
        moves.add(spark.createDataFrame(data, "product_id long, delta long"), b)
    product = spark.createDataFrame([(1, "20"), (2, "5"), (3, "0")], "pro_id long, safety_level string")
    out = sm.stock_position(inv.withColumn("availability", F.lit(0)), product, moves)
    assert rows(out, "product_id", "quantity", "safety_level", "availability") == [
        (1, 5, 20, 2), (2, None, 5, 1), (3, 5, 0, 5)]


def test_old_batches_are_folded(spark, tmp_path):
    table = Deltas(spark, str(tmp_path), lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")), every=8)
    total = {}
    for b in range(50):
        table.add(spark.createDataFrame([(b % 3, b), (7, 1)], "k long, v long").coalesce(1), b)
        total[b % 3] = total.get(b % 3, 0) + b
        if b % 9 == 0:
            got = dict(rows(table.read().groupBy("k").agg(F.sum("v").alias("v"))))
            assert got == total | {7: b + 1}
    files = list(tmp_path.glob("**/*.parquet"))
    assert len(files) <= 2 * 8 + 4                               # of the hundred rows' fifty batches
    assert len(list(tmp_path.glob("bases/upto=*"))) == 1


def test_a_compaction_cut_short_changes_nothing(spark, tmp_path, monkeypatch):
    table = Deltas(spark, str(tmp_path), lambda rows: rows.groupBy("k").agg(F.sum("v").alias("v")), every=100)
    for b in range(6):
        table.add(spark.createDataFrame([(1, 10 ** b)], "k long, v long"), b)

    def total():
        return table.read().agg(F.sum("v")).first()[0]

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(deltas, "delete_folder", lost)
    with pytest.raises(RuntimeError):
        table.compact(4)                                          # the base is written, nothing is removed
    assert total() == 111_111 and len(list(tmp_path.glob("batches/batch_id=*"))) == 6
    monkeypatch.undo()
    table.compact(4)
    assert total() == 111_111 and len(list(tmp_path.glob("batches/batch_id=*"))) == 2
    table.add(spark.createDataFrame([(1, 10 ** 5)], "k long, v long"), 5)     # a replayed batch
    table.compact(6)
    assert total() == 111_111 and not list(tmp_path.glob("batches/batch_id=*"))


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    table = sm.balance_table(spark, str(tmp_path))
    last = F.struct(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("transaction_date"),
                    F.col("id").alias("invoice_no"), F.lit(0).alias("step"))
    for b in range(2):
        table.add(spark.range(64).select(F.col("id").cast("string").alias("customer_mobile"), last.alias("_last"),
                                         F.col("id").cast("decimal(18,2)").alias("opening_balance"))
                  .withColumn("bucket", sm.bucket_of("customer_mobile", 8)), b)
    one = table.read(2, F.col("bucket").isin([3]))
    assert {r["bucket"] for r in one.select("bucket").distinct().collect()} == {3}
    assert {f.split("/bucket=")[1][0] for f in (r[0] for r in one.select("_metadata.file_path").distinct().collect())} == {"3"}
    assert "PartitionFilters: [isnotnull(batch_id" in one._jdf.queryExecution().executedPlan().toString()


def test_late_ledger_entry_rewrites_its_buckets_partitions_only(spark, tmp_path, monkeypatch):
    d = dt.date
    schema = ("invoice_no long, customer_id long, customer_name string, customer_mobile string, "
              "date date, final_amount decimal(10,2), total_paid decimal(10,2), payment_status string")
    first = [(100 + i, i, f"C{i}", f"{i:04d}", d(2024, 2, 1), Dec("10.00"), Dec("0.00"), "Unpaid") for i in range(40)]
    late = [(900, 7, "C7", "0007", d(2024, 1, 1), Dec("1.00"), Dec("0.00"), "Unpaid")]
    path = sm.new_root(spark, "feed-buckets")
    for b in (first, late):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
    monkeypatch.setattr(sm, "new_root", lambda _spark, name: str(tmp_path / name))
    sm.stream_ledger(spark, path, spark.createDataFrame([], schema), max_files=1)
    entries = tmp_path / "ledger" / "entries"
    stamps = {p: p.stat().st_mtime for p in entries.glob("bucket=*/batch_id=0/*.parquet")}
    newest = max(p.stat().st_mtime for p in entries.glob("bucket=*/batch_id=1/*.parquet"))
    written = [p for p, t in stamps.items() if abs(t - newest) < 0.5]
    assert len({p.parent for p in stamps}) > 10 and len({p.parent for p in written}) <= 1
