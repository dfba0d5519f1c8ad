"""File sources and sinks (A-1..A-12)."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillbook.operators import loads as ld
from tillbook.sources import files, tables
from tillbook.sources.tables import Bucketed, Change, merge


def test_customer_csv_keeps_text_and_requires_columns(spark, tmp_path):
    p = tmp_path / "customers.csv"
    p.write_text("name,mobile,address,mail,extra\nJohn Doe,0012345,1 Main St,j@x.com,zz\n"
                 "Alice,  987 ,2 Park,a@x.com,yy\n")
    df, bad = files.read_customers_csv(spark, str(p))
    assert bad.count() == 0
    assert df.columns == ["name", "mobile", "address", "mail", "ord"]
    assert rows(df, "name", "mobile") == [("Alice", "  987 "), ("John Doe", "0012345")]
    short = tmp_path / "bad.csv"
    short.write_text("name,mobile\nx,1\n")
    with pytest.raises(files.MissingColumns):
        files.read_customers_csv(spark, str(short))
    with pytest.raises(files.MissingColumns):                 # one bad file of a folder
        files.read_customers_csv(spark, str(tmp_path))


def test_csv_files_bind_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,mobile,address,mail\nAnn,0001,x,a@x\n")
    (tmp_path / "b.csv").write_text("mobile,mail,name,address\n0002,b@x,Bob,y\n")
    df, _ = files.read_customers_csv(spark, str(tmp_path))
    assert rows(df, "name", "mobile", "address", "mail") == [("Ann", "0001", "x", "a@x"), ("Bob", "0002", "y", "b@x")]


def test_positions_are_unique_over_a_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text("mobile,mail,name,address\n0001,b@x,Bob,y\n0002,b@x,Bea,y\n")
    (tmp_path / "a.csv").write_text("name,mobile,address,mail\nAnn,0001,x,a@x\nAda,0003,x,a@x\nshort\n")
    (tmp_path / "c.csv").write_text("name,mobile,address,mail\nCid,0003,x,a@x\n")
    df, _ = files.read_customers_csv(spark, str(tmp_path))
    # by file name, then place; the refused third line of a.csv keeps its position
    assert rows(df, "ord", "name") == [(0, "Ann"), (1, "Ada"), (3, "Bob"), (4, "Bea"), (5, "Cid")]
    new, skipped = ld.import_customers(df, spark.createDataFrame([], "id long, name string, mobile string"))
    assert rows(new, "name", "mobile") == [("Ada", "0003"), ("Ann", "0001"), ("Bea", "0002")]
    assert rows(skipped, "ord") == [(3,), (5,)]


def test_positions_follow_the_file_where_it_is_read_in_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("name,mobile,address,mail\n" + "".join(
        f"n{i},{i:06d},{'x' * (i % 50)},m\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df, _ = files.read_customers_csv(spark, str(tmp_path))
        assert rows(df, "ord", "mobile") == [(i, f"{i:06d}") for i in range(3000)]
        assert df.sparkSession.read.csv(str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_line_breaks_and_broken_rows(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('name,mobile,address,mail\nAnn,0001,"1 Road\nTown",a@x\nBob,0002\nCid,0003,z,c@x,more\n')
    df, bad = files.read_customers_csv(spark, str(p), multi_line=True)
    assert rows(df, "name", "address") == [("Ann", "1 Road\nTown")]
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed record"] * 2
    df, bad = files.read_customers_csv(spark, str(p))     # read in splits: both halves of the row are refused
    assert df.count() == 0 and bad.count() == 4


def test_ledger_csv_rejects_bad_cells(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("transaction_date,invoice_no,supplier_id,amount,transaction_type,description,balance,customer_id\n"
                 "2024-01-01 00:00:00,1,,abc,Debit,d,5.00,1\n2024-01-01 00:00:00,2,,3.00,Debit,d,5.00,1\n"
                 "not a date,3,,3.00,Debit,d,,x\n")
    df, bad = files.read_ledger_csv(spark, str(p))
    assert rows(df, "invoice_no") == [(2,)]
    assert sorted(r["reason"] for r in bad.collect()) == [
        "amount is not a decimal(10,2)", "transaction_date is not a timestamp_ntz"]


def files_of(path):
    """Bucket -> its Parquet files with their times."""
    out = {}
    for p in path.glob("_bucket=*/*.parquet"):
        out.setdefault(int(p.parent.name.split("=")[1]), set()).add((p.name, p.stat().st_mtime_ns))
    return out


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    table = Bucketed(str(tmp_path / "t"), "id", 16)
    table.create(spark.range(500).select("id", F.lit(1).alias("q")))
    before = files_of(tmp_path / "t")
    assert len(before) == 16
    changes = spark.createDataFrame([(3, 10), (3, 5), (9_000, 7)], "id long, q int")
    assert merge(spark, str(tmp_path / "s"), "b1", table, changes, "id", upsert) == ["table"]
    after = files_of(tmp_path / "t")
    hit = table.touched(changes)
    assert {b for b in after if after[b] != before[b]} == set(hit) and len(hit) == 2
    want = sorted([(i, 16 if i == 3 else 1) for i in range(500)] + [(9_000, 7)])
    assert rows(table.read(spark)) == want
    assert merge(spark, str(tmp_path / "s"), "b1", table, changes, "id", upsert) == []     # once
    assert rows(table.read(spark)) == want and files_of(tmp_path / "t") == after
    plan = table.read(spark, hit)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan


def upsert(table, changes):
    sums = changes.groupBy("id").agg(F.sum("q").alias("_q"))
    return table.join(sums, "id", "full").select(
        "id", (F.coalesce("q", F.lit(0)) + F.coalesce("_q", F.lit(0))).cast("int").alias("q"))


def test_a_bucket_may_lose_its_last_row(spark, tmp_path):
    table = Bucketed(str(tmp_path / "t"), "id", 8)
    table.create(spark.range(20).select("id"))
    gone = table.read(spark, [table.touched(spark.range(1))[0]])
    keys = spark.createDataFrame(gone.collect(), "id long")
    merge(spark, str(tmp_path / "s"), "b", table, keys, "id", lambda rows, k: rows.join(k, "id", "left_anti"))
    left = {r[0] for r in table.read(spark).collect()}
    assert left == set(range(20)) - {r[0] for r in keys.collect()}


def test_a_failed_batch_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    one, two = Bucketed(str(tmp_path / "x"), "id", 4), Bucketed(str(tmp_path / "y"), "id", 4)
    for t in (one, two):
        t.create(spark.range(40).select("id", F.lit(0).alias("q")))
    calls = []

    def changes(broken=False):
        calls.append(1)
        add = F.raise_error(F.lit("broken")).cast("int") if broken else F.lit(1)
        return {n: Change(t, t.read(spark).withColumn("q", F.col("q") + (add if n == "y" else 1)), [0, 1, 2, 3])
                for n, t in (("x", one), ("y", two))}

    with pytest.raises(Exception, match="broken"):                          # staging fails: nothing changed
        tables.publish(spark, str(tmp_path / "s"), "b", lambda: changes(True))
    assert {r["q"] for t in (one, two) for r in t.read(spark).collect()} == {0}
    # the copy fails after the first table: the next run copies again, adding nothing
    monkeypatch.setattr(tables, "_mark", lambda s, p: (_ for _ in ()).throw(RuntimeError("lost"))
                        if p.endswith("published") else mark(s, p))
    with pytest.raises(RuntimeError, match="lost"):
        tables.publish(spark, str(tmp_path / "s"), "b", changes)
    monkeypatch.undo()
    assert tables.publish(spark, str(tmp_path / "s"), "b", changes) == ["x", "y"]
    assert tables.publish(spark, str(tmp_path / "s"), "b", changes) == []
    assert {r["q"] for t in (one, two) for r in t.read(spark).collect()} == {1} and len(calls) == 2


mark = tables._mark


def test_list_inputs_and_extensions(spark, tmp_path):
    (tmp_path / "a.CSV").write_text("x\n1\n")
    (tmp_path / "b.txt").write_text("x\n")
    got = [r["path"].rsplit("/", 1)[-1] for r in files.list_inputs(spark, str(tmp_path)).collect()]
    assert got == ["a.CSV"]
    with pytest.raises(ValueError):
        files.list_inputs(spark, str(tmp_path), "exe")


def test_export_quotes_and_trims(spark, tmp_path):
    df = spark.createDataFrame([(" 2024-01-01 ", "0001", " Ann ", "5.00", "Debit", "5.00")],
                               "transaction_date string, customer_mobile string, customer_name string, "
                               "amount string, transaction_type string, balance string")
    out = str(tmp_path / "ledger")
    files.export_ledger_csv(df, out)
    header = '"transaction_date","customer_mobile","customer_name","amount","transaction_type","balance"'
    lines = [r[0] for r in spark.read.text(out).collect()]
    # one header per part file, every cell quoted and trimmed
    assert [x for x in lines if x != header] == ['"2024-01-01","0001","Ann","5.00","Debit","5.00"']
    assert header in lines
