"""Stored layouts, the trigram index and the daily sketches: what the plans
read, and results equal to those of the plain paths."""

import datetime as dt
import glob
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, rows
from tillbook.operators import posting as ps
from tillbook.operators import quality as q
from tillbook.operators import reports as rp
from tillbook.operators import sketches as sk
from tillbook.operators import substrings as sub
from tillbook.sources.fixtures import AS_OF, Retail
from tillbook.sources.layouts import ByInvoice, ByMonth


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ---- by invoice ---------------------------------------------------------------

@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    r = Retail(spark, SF001)
    keys = r.lines.groupBy("invoice_no").count().orderBy(F.desc("count"), "invoice_no").first()
    big = r.lines.filter(F.col("invoice_no") == keys[0]).limit(1)
    lines = r.lines.unionByName(big.withColumn("line_no", F.explode(F.sequence(F.lit(100), F.lit(3099)))))
    payment = r.payment.unionByName(r.payment.limit(2).withColumn("invoice_no", F.lit(None).cast("long")))
    tables = {"invoice": r.invoice, "lines": lines, "payment": payment}
    store = ByInvoice(spark, f"shop_{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("shop")), buckets=4, heavy_rows=1000)
    store.create(tables)
    return tables, store, keys[0]


def test_heavy_invoices_lie_apart_in_every_table(shop):
    tables, store, big = shop
    assert store.has_heavy()
    for name, df in tables.items():
        assert store.common(name).filter((F.col("invoice_no") == big) | F.col("invoice_no").isNull()).count() == 0
        assert store.common(name).count() + store.heavy(name).count() == df.count()
        assert len(glob.glob(f"{store.path}/{name}/part-*")) <= 4
    assert rows(store.heavy("invoice"), "invoice_no") == [(big,)]


def test_no_exchange_below_joins_on_the_invoice(shop, no_broadcast):
    _, store, _ = shop
    inv, lines, pay = (store.common(t) for t in ("invoice", "lines", "payment"))
    for df in (rp.list_payments(pay, inv), ps.recompute_invoice_total(inv, lines), q.reconcile_totals(inv, lines),
               inv.join(lines.drop("discount"), "invoice_no")):
        text = plan(df)
        assert "Exchange" not in text and "SortMergeJoin" in text
    t = Retail(inv.sparkSession, SF001)
    assert "Exchange hashpartitioning" in plan(ps.recompute_invoice_total(t.invoice, t.lines))


def test_both_parts_give_the_whole_result(shop):
    tables, store, _ = shop
    for fn, args in ((rp.list_payments, ("payment", "invoice")), (q.reconcile_totals, ("invoice", "lines")),
                     (ps.recompute_invoice_total, ("invoice", "lines"))):
        want = fn(*[tables[a] for a in args])
        got = store.apply(fn, *args).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_empty_tables(spark, tmp_path):
    store = ByInvoice(spark, f"none_{uuid.uuid4().hex}", str(tmp_path), buckets=2)
    make = spark.createDataFrame
    store.create({"invoice": make([], "invoice_no long, total_amount decimal(10,2), discount decimal(10,2)"),
                  "lines": make([], "invoice_no long, total decimal(10,2)")})
    assert store.apply(ps.recompute_invoice_total, "invoice", "lines").count() == 0 and not store.has_heavy()


# ---- by month -------------------------------------------------------------------

def broken_outside(path, months):
    """Make the files of all other months unreadable."""
    hit = 0
    for f in glob.glob(f"{path}/_month=*/*.parquet"):
        if not any(f"_month={m}" in f for m in months):
            with open(f, "wb") as out:
                out.write(b"not parquet")
            hit += 1
    return hit


@pytest.fixture()
def by_month(spark, tmp_path):
    invoice = Retail(spark, SF001).invoice
    undated = invoice.limit(3).withColumn("date", F.lit(None).cast("date"))
    store = ByMonth(spark, str(tmp_path / "invoice"), invoice.schema, "date", ("invoice_no",))
    store.create(invoice.unionByName(undated))
    return invoice, store


def test_month_to_date_reads_its_months_only(spark, by_month):
    invoice, store = by_month
    assert store.read().count() == invoice.count() + 3
    want = [rp.total_sales_month(invoice, AS_OF).first(), rows(rp.daily_sales_trend(invoice, AS_OF)),
            rp.total_sales_today(invoice, AS_OF).first()]
    assert broken_outside(store.path, ["200107", "200108"]) > 70
    assert rp.total_sales_month(store.since(AS_OF, "month"), AS_OF).first() == want[0]
    assert rows(rp.daily_sales_trend(store.since(AS_OF, "week"), AS_OF)) == want[1]
    assert rp.total_sales_today(store.since(AS_OF, "today"), AS_OF).first() == want[2]
    with pytest.raises(Exception, match="(?i)parquet"):
        store.read().count()


def test_days_known_at_run_time_prune_months(spark, by_month):
    invoice, store = by_month
    days = spark.createDataFrame([(dt.date(1998, 2, d),) for d in range(1, 29)] + [(None,)], "day date")
    want = invoice.filter(F.col("date").between("1998-02-01", "1998-02-28")).count()
    broken_outside(store.path, ["199802"])
    assert store.on_days(days).count() == want > 0
    assert store.on_days(days.filter("day is null")).count() == 0


def test_replacing_a_month_leaves_the_others(spark, by_month):
    invoice, store = by_month
    before = {f: open(f, "rb").read() for f in glob.glob(f"{store.path}/_month=*/*.parquet")}
    march = invoice.filter(F.col("date").between("1999-03-01", "1999-03-31"))
    for _ in range(2):                                           # again: nothing changes
        store.replace_months(march.filter("invoice_no % 2 = 0"))
        got = store.read().filter(F.col("date").between("1999-03-01", "1999-03-31"))
        assert rows(got, "invoice_no") == rows(march.filter("invoice_no % 2 = 0"), "invoice_no")
    after = glob.glob(f"{store.path}/_month=*/*.parquet")
    assert all(f in after for f in before if "_month=199903" not in f)


# ---- trigram index ------------------------------------------------------------------

NAMES = [(1, "Blue Plate"), (2, "plaTE"), (3, ""), (4, None), (5, "ab"), (6, "abc"), (7, "aBcabcABC"),
         (8, "100% wool"), (9, "x_y_z"), (10, "é́tude été"), (11, "日本語テスト"), (12, "late p"), (13, "plat eplate")]


@pytest.fixture()
def names(spark, tmp_path):
    df = spark.createDataFrame(NAMES, "pro_id long, pro_name string").withColumn("product_id", F.col("pro_id")) \
        .withColumn("product_name", F.col("pro_name")).withColumn("availability", (F.col("pro_id") % 6).cast("int")) \
        .withColumn("price", F.lit(1))
    index = sub.TrigramIndex(spark, str(tmp_path / "index"), buckets=8)
    index.add(df, "pro_id", ["pro_name"])
    index.add(df, "pro_id", ["product_name"])
    return df, index


@pytest.mark.parametrize("needle", ["plate", "LATE", "", "a", "ab", "abc", "bca", "abcabcabc", "0% w", "x_y", "été",
                                    "本語テ", "nothing", "plate plate", "e p", "late p"])
def test_index_equals_the_scan(names, needle):
    df, index = names
    assert rows(sub.search_products(df, index, needle), "pro_id") == rows(rp.search_products(df, needle), "pro_id")
    assert rows(sub.suggest_products(df, index, needle), "product_id") == rows(rp.suggest_products(df, needle), "product_id")


def test_labels_take_the_scan(names):
    df, index = names
    for text in (" Stock ", "low", "plate", "in st"):
        assert rows(sub.search_inventory(df, index, text), "product_id") == rows(rp.search_inventory(df, text), "product_id")


def test_plan_reads_matching_lists_only(spark, names):
    df, index = names
    text = plan(index.candidates("plate", "pro_name"))
    assert "PartitionFilters" in text and "PushedFilters" in text and "In(gram, [" in text
    keep = {r[0] for r in spark.createDataFrame([("pla",), ("lat",), ("ate",)], "g string").select(index._bucket(F.col("g"))).collect()}
    for f in glob.glob(f"{index.path}/*/bucket=*/*.parquet"):
        if not any(f"bucket={b}/" in f for b in keep):
            with open(f, "wb") as out:
                out.write(b"not parquet")
    assert rows(index.candidates("plate", "pro_name"), "key") == [("1",), ("13",), ("2",)]


def test_added_renamed_and_removed_rows(spark, names):
    df, index = names
    more = spark.createDataFrame([(1, "red bolt"), (20, "steel plate")], "pro_id long, pro_name string")
    index.add(more, "pro_id", ["pro_name"])
    now = df.select("pro_id", "pro_name").filter("pro_id not in (1, 2)").unionByName(more)
    for needle in ("plate", "bolt", "blue"):
        assert rows(sub.search_products(now, index, needle)) == rows(rp.search_products(now, needle))


def test_ledger_by_customer(spark, tmp_path):
    ledger = spark.createDataFrame(
        [("0001", "Ann Lee", 1), ("0001", "Ann Lee", 2), ("0002", None, 3), (None, "annex", 4), ("9000", "Bob", 5)],
        "customer_mobile string, customer_name string, entry int")
    index = sub.TrigramIndex(spark, str(tmp_path / "index"))
    index.add(ledger.select("customer_mobile", "customer_name").distinct(), "customer_mobile", ["customer_mobile", "customer_name"])
    for text, want in (("ann", [1, 2, 4]), ("000", [1, 2, 3, 5]), ("bo", [5]), ("", [1, 2, 3, 4, 5]), ("xyz", [])):
        assert [e for e, in rows(sub.filter_ledger(ledger, index, text=text), "entry")] == want


# ---- daily sketches -----------------------------------------------------------------

def test_estimates_lie_within_the_bound(spark):
    n = 200_000                                      # more customers than a sketch keeps apart
    invoice = spark.range(n).select(
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") % 40).cast("int")).alias("date"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(90_000))).cast("int").alias("customer_id"),
        F.lit(1).cast("decimal(10,2)").alias("final_amount"))
    days = sk.daily_sketches(invoice)
    assert days.count() == 40
    days = spark.createDataFrame(days.collect(), days.schema)
    for k in (1, 7, 30, 40):
        where = F.col("date") < F.date_add(F.lit("2001-01-01").cast("date"), k)
        exact = invoice.filter(where).agg(F.count_distinct("customer_id"), F.count("*")).first()
        got = sk.active_customers(days, where).first()
        assert abs(got["active_customers"] - exact[0]) <= sk.BOUND * exact[0]
        assert (got["orders"], got["sales"]) == (exact[1], exact[1])


def test_a_new_day_adds_one_row_and_late_invoices_merge(spark):
    schema = "date date, customer_id int, final_amount decimal(10,2)"
    day = [dt.date(2001, 7, d) for d in (1, 2)]
    first = spark.createDataFrame([(day[0], 1, 5), (day[0], None, 5), (None, 9, 5)], "date date, customer_id int, final_amount int") \
        .withColumn("final_amount", F.col("final_amount").cast("decimal(10,2)"))
    stored = sk.daily_sketches(first)
    assert stored.count() == 1
    stored = sk.with_day(stored, spark.createDataFrame([(day[1], 1, None), (day[1], 2, None)], schema))
    assert stored.count() == 2
    stored = sk.with_day(stored, spark.createDataFrame([(day[0], 3, None)], schema))
    assert stored.count() == 2
    assert tuple(sk.active_since(stored, "2001-07-02").first()) == (3, 5, 10)
    assert tuple(sk.active_since(stored, "2001-07-01", "today").first()) == (2, 3, 10)
    assert tuple(sk.active_since(stored, "2003-07-01", "week").first()) == (0, 0, 0)


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "ab")], "pro_id long, pro_name string")
    index = sub.TrigramIndex(spark, str(tmp_path / "index"))
    index.add(df, "pro_id", ["pro_name"])
    assert rows(sub.search_products(df, index, "ab"), "pro_id") == [(2,)]
    assert sub.search_products(df, index, "abc").count() == 0
