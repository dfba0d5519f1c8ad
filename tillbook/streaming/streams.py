"""Incremental versions of the reports and postings (R-1..R-5).

The reference maintains derived tables with row triggers.  Here each is a
Structured Streaming query over a file feed:

* R-1 daily sales: each micro-batch writes its per-day partial sums to its
  own partition; the table is their sum when read.  No watermark, so no row
  is too late and nothing is dropped.
* R-2 stock: each micro-batch appends its per-product movement totals to
  a delta table partitioned by batch id (dynamic overwrite: a replayed batch
  rewrites the same partition); the position is inventory + all deltas.
* R-3 ledger: entries partitioned by (customer bucket, batch id) and
  balance changes per bucket and batch (see ``stream_ledger``); R-5
  customers: an append-mostly table partitioned alike.  A micro-batch reads
  the buckets it touches.
* Old batches of R-1, R-2 and of the balances are folded (``deltas``).
* The merges are order-robust: a batch holding rows older than rows
  already posted still gives the batch result (the ledger re-posts the
  history of the customers concerned; first-wins keeps the smaller
  ``ord``), so the result does not depend on how files split into batches.
* R-4 payment modes: a streaming aggregate in complete mode (its result is
  bounded by the number of modes).

Every function runs the query with ``trigger(availableNow=True)`` and
returns the final table; the batch twin of each is its oracle.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tillbook.operators.ledger import LEDGER_ORDER, entries_from_invoices, running_balance
from tillbook.operators.stock import refresh_availability
from tillbook.operators.windows import materialize
from tillbook.session import delete_folder, scratch_path
from tillbook.streaming.deltas import Deltas, write_partitions


def new_root(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


FEED_ROWS = 1 << 20        # of a feed's file, at most about


def write_feed(df: DataFrame, path: str, part_col: str) -> str:
    """Write ``df`` as a file feed: one append per value of ``part_col`` (a
    small set such as the year), in ascending order, so later parts arrive
    later.  Used to replay a table as a stream.  The files of a part follow
    its rows, not the tasks that derived them: a micro-batch takes files, and
    many small ones would make as many batches."""
    parts = df.groupBy(part_col).count().orderBy(part_col).collect()
    for v, rows in parts:
        files = max(1, -(-rows // FEED_ROWS))
        df.filter(F.col(part_col) == v).drop(part_col).repartition(files).write.mode("append").parquet(path)
    return path


def _run(stream_writer, checkpoint: str) -> None:
    q = (stream_writer.option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _read_feed(spark: SparkSession, path: str, like: DataFrame, max_files: int | None):
    r = spark.readStream.schema(like.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _summed(key: str, value: str):
    """Rows per key and batch folded to one row per key."""
    return lambda rows: rows.groupBy(key).agg(F.sum(value).alias(value))


# R-1
def daily_sales_table(spark: SparkSession, root: str) -> Deltas:
    return Deltas(spark, f"{root}/sums", _summed("date", "sales"))


def stream_daily_sales(spark: SparkSession, feed: str, like: DataFrame,
                       max_files: int | None = 8) -> DataFrame:
    """Daily sales (date, sales) of a stream of invoices.

    Each micro-batch writes one row per day it touches, whatever its age;
    reading sums them per day.  A late invoice costs one row, not a rewrite;
    old batches are folded into one row per day (:class:`Deltas`).
    """
    root = new_root(spark, "daily-sales")
    sums = daily_sales_table(spark, root)

    def add(batch: DataFrame, batch_id: int) -> None:
        sums.add(batch.groupBy("date").agg(F.sum("final_amount").alias("sales")), batch_id)

    _run(_read_feed(spark, feed, like, max_files).writeStream.foreachBatch(add), f"{root}/checkpoint")
    parts = sums.read()
    if parts is None:
        return spark.createDataFrame([], "date date, sales decimal(18,2)")
    return parts.groupBy("date").agg(F.sum("sales").cast("decimal(18,2)").alias("sales"))


# R-2
def stock_table(spark: SparkSession, root: str) -> Deltas:
    return Deltas(spark, f"{root}/deltas", _summed("product_id", "delta"))


def stream_stock(spark: SparkSession, feed: str, like: DataFrame, inventory: DataFrame,
                 product: DataFrame, max_files: int | None = 8) -> DataFrame:
    """Stock position from a stream of movements (product_id, delta).

    Each micro-batch writes only its per-product movement totals (a partial
    aggregate, one row per product it touches) to its partition of a delta
    table, so a replay is idempotent; no batch rewrites the inventory, and
    old batches are folded into one row per product (:class:`Deltas`).  The
    position is the base inventory plus the sum of all deltas, with
    availability recomputed (H-6), computed when read (:func:`stock_position`).
    """
    root = new_root(spark, "stock")
    deltas = stock_table(spark, root)
    src = _read_feed(spark, feed, like, max_files)

    def apply(batch: DataFrame, batch_id: int) -> None:
        deltas.add(batch.groupBy("product_id").agg(F.sum("delta").alias("delta")), batch_id)

    _run(src.writeStream.foreachBatch(apply), f"{root}/checkpoint")
    return stock_position(inventory, product, deltas)


def stock_position(inventory: DataFrame, product: DataFrame, deltas: Deltas) -> DataFrame:
    """Inventory + SUM(deltas) per product (NULL quantity stays NULL);
    availability (H-6) of the moved products from their safety level."""
    rows = deltas.read()
    if rows is None:
        return inventory
    d = rows.groupBy("product_id").agg(F.sum("delta").alias("_delta"))
    new = (inventory.join(d.withColumn("_hit", F.lit(True)), "product_id", "left")
           .withColumn("quantity", (F.col("quantity") + F.coalesce(F.col("_delta"), F.lit(0)))
                       .cast("int")))
    return refresh_availability(new, product, F.col("_hit")).select(*inventory.columns)


# R-3
def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _newest_balance(rows: DataFrame) -> DataFrame:
    """One row per customer: the newest change."""
    newest = rows.groupBy("customer_mobile", "bucket").agg(
        F.max_by(F.struct("_last", "opening_balance"), "batch_id").alias("m"))
    return newest.select("customer_mobile", "m._last", "m.opening_balance", "bucket")


def balance_table(spark: SparkSession, root: str) -> Deltas:
    return Deltas(spark, root, _newest_balance, ("bucket",))


def stream_ledger(spark: SparkSession, feed: str, like: DataFrame,
                  max_files: int | None = 8, buckets: int = 64) -> DataFrame:
    """Ledger posting (P-7) from a stream of invoices with carried balances.

    The ledger is a Parquet folder partitioned by (``bucket``, ``batch_id``),
    the bucket being a hash of the customer; balance changes (customer_mobile,
    last posted key, balance) are appended per batch and bucket, the newest
    change of a customer is its balance, and old changes are folded to one per
    customer (:class:`Deltas`).  A micro-batch looks up the balances of its own
    buckets only.  Batch ``b``:

    * customers whose new entries all come after their last posted entry
      (the normal, in-order case) are posted from their carried balance with
      the skew-safe running total and written to their buckets' partition
      ``b`` only;
    * customers receiving an entry older than one already posted get what
      follows it re-posted in date order, from the balance before it; only
      the partitions of their own buckets that hold such rows are rewritten.

    Writes use dynamic partition overwrite, so replaying batch ``b`` after a
    failure rewrites the same partitions with the same rows.
    """
    root = new_root(spark, "ledger")
    ledger_dir, changes_dir = f"{root}/entries", f"{root}/balances"
    src = _read_feed(spark, feed, like, max_files)
    key = F.struct(*[F.col(c) for c in LEDGER_ORDER])
    part = ["bucket", "batch_id"]
    empty_bal = spark.createDataFrame(
        [], "customer_mobile string, _last struct<transaction_date: timestamp_ntz, "
            "invoice_no: long, step: int>, opening_balance decimal(18,2)")

    changes = balance_table(spark, changes_dir)

    def balances(batch_id: int, own: list[int]) -> DataFrame:
        rows = changes.read(batch_id, F.col("bucket").isin(own))
        return empty_bal if rows is None else _newest_balance(rows).select(
            "customer_mobile", "_last", "opening_balance")

    def post(batch: DataFrame, batch_id: int) -> None:
        new = materialize(entries_from_invoices(batch).withColumns({
            "bucket": bucket_of("customer_mobile", buckets),
            "batch_id": F.lit(batch_id)}))
        mine = new.groupBy("customer_mobile").agg(F.min(key).alias("_first"))
        own = [r[0] for r in new.select("bucket").distinct().collect()]     # at most ``buckets`` numbers
        bal = materialize(balances(batch_id, own).join(mine, "customer_mobile"))     # this batch's customers
        late = bal.filter(F.col("_first") <= F.col("_last")).select("customer_mobile", "_first")
        has_late = bool(late.take(1))
        fresh = new.join(late, "customer_mobile", "left_anti") if has_late else new
        out = running_balance(fresh, opening=bal.select("customer_mobile", "opening_balance"))
        done = out
        if has_late:
            hit = new.join(late, "customer_mobile", "left_semi").select("bucket")
            old = spark.read.parquet(ledger_dir).filter(F.col("batch_id") < batch_id)
            old = old.join(hit, "bucket", "left_semi")        # pruned to the late customers' buckets
            # a late customer's entries from the first new one on; the earlier ones stay as they are
            marked = old.join(late, "customer_mobile", "left")
            after = F.coalesce(key >= F.col("_first"), F.lit(False))
            history = materialize(marked.filter(F.col("_first").isNotNull()).withColumn("_after", after))
            before = (history.filter("not _after").groupBy("customer_mobile")
                      .agg(F.max_by("balance", key).alias("opening_balance")))
            redo = running_balance(history.filter("_after").drop("balance", "_first", "_after")
                                   .unionByName(new.join(late, "customer_mobile", "left_semi")), opening=before)
            done = materialize(out.unionByName(redo))
            touched = done.filter(F.col("batch_id") < batch_id).select(*part).distinct()
            keep = marked.filter(~after).drop("_first").join(touched, part, "left_semi")
            # written aside first: the partitions being replaced are also read
            out = materialize(done.unionByName(keep))
        write_partitions(out, ledger_dir, part)
        last = (done.groupBy("customer_mobile")
                .agg(F.max(F.struct(key.alias("_k"), F.col("balance"))).alias("_m"))
                .select("customer_mobile", F.col("_m._k").alias("_last"),
                        F.col("_m.balance").alias("opening_balance")))
        changes.add(last.withColumn("bucket", bucket_of("customer_mobile", buckets)), batch_id)

    _run(src.writeStream.foreachBatch(post), f"{root}/checkpoint")
    try:
        return spark.read.parquet(ledger_dir).drop(*part)
    except AnalysisException:
        return running_balance(entries_from_invoices(like.limit(0)))


# R-4
def stream_payment_modes(spark: SparkSession, feed: str, like: DataFrame,
                         max_files: int | None = 8) -> DataFrame:
    """Payment count and amount per mode, maintained continuously (complete mode)."""
    root = new_root(spark, "payment-modes")
    # every batch holds the whole result, one row per mode: the newest counts
    table = Deltas(spark, f"{root}/table", _newest_rows)
    src = _read_feed(spark, feed, like, max_files)
    agg = src.groupBy("payment_mode").agg(F.count(F.lit(1)).alias("payments"),
                                          F.sum("amount").cast("decimal(18,2)").alias("amount"))
    _run(agg.writeStream.outputMode("complete").foreachBatch(table.add), f"{root}/checkpoint")
    rows = table.read()
    if rows is None:
        return spark.createDataFrame([], "payment_mode string, payments long, amount decimal(18,2)")
    return _newest_rows(rows).drop("batch_id")


def _newest_rows(rows: DataFrame) -> DataFrame:
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == last)


# R-5
def stream_customers(spark: SparkSession, feed: str, like: DataFrame, existing: DataFrame,
                     max_files: int | None = 8, buckets: int = 64) -> DataFrame:
    """De-duplicated customer feed (M-1 incrementally): trimmed mobile, not
    in the existing table, first row by ``ord`` per mobile across the whole
    stream.

    Output: a Parquet folder partitioned by (``bucket`` of the mobile,
    ``batch_id``).  Batch ``b`` reads the customers posted so far to its own
    buckets (an anti join, no rewrite) and writes its new mobiles to their
    partitions ``b``; only when a batch brings an earlier ``ord`` for a mobile
    already posted are the partitions holding those mobiles rewritten.
    Dynamic partition overwrite makes a replayed batch idempotent.
    """
    root = new_root(spark, "customers")
    out_dir = f"{root}/customers"
    cols = ["mobile", "ord", "name", "address", "mail"]
    known = existing.select("mobile")
    src = _read_feed(spark, feed, like, max_files)

    part = ["bucket", "batch_id"]

    def posted_before(batch_id: int, own: list[int]) -> DataFrame | None:
        try:
            return spark.read.parquet(out_dir).filter(F.col("bucket").isin(own) & (F.col("batch_id") < batch_id))
        except AnalysisException:
            return None

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = (batch.withColumn("mobile", F.trim("mobile")).join(known, "mobile", "left_anti")
                .select("mobile", F.col("ord").cast("long").alias("ord"), "name", "address", "mail"))
        mins = rows.groupBy("mobile").agg(F.min("ord").alias("ord"))
        firsts = materialize(rows.join(mins, ["mobile", "ord"]).withColumns(
            {"bucket": bucket_of("mobile", buckets), "batch_id": F.lit(batch_id)}))
        own = [r[0] for r in firsts.select("bucket").distinct().collect()]     # at most ``buckets`` numbers
        prev, emptied = posted_before(batch_id, own), []
        if prev is None:
            out = firsts
        else:
            seen = prev.select("mobile", F.col("ord").alias("_prev_ord"))
            fresh = firsts.join(seen, "mobile", "left_anti")
            earlier = (firsts.join(seen, "mobile").filter(F.col("ord") < F.col("_prev_ord"))
                       .drop("_prev_ord"))
            if earlier.take(1):
                earlier = materialize(earlier)
                gone = earlier.select("mobile")
                touched = prev.join(gone, "mobile", "left_semi").select(*part).distinct()
                keep = materialize(prev.join(touched, part, "left_semi")
                                   .join(gone, "mobile", "left_anti").select(*cols, *part))
                emptied = touched.join(keep, part, "left_anti").collect()      # some of the touched partitions
                out = materialize(fresh.unionByName(earlier).unionByName(keep))
            else:
                out = fresh
        write_partitions(out.select(*cols, *part), out_dir, part)
        for p in emptied:      # no row left that would overwrite them
            delete_folder(spark, f"{out_dir}/bucket={p['bucket']}/batch_id={p['batch_id']}")

    _run(src.writeStream.foreachBatch(merge), f"{root}/checkpoint")
    try:
        return spark.read.parquet(out_dir).select(*cols)
    except AnalysisException:
        return spark.createDataFrame([], "mobile string, ord long, name string, address string, "
                                         "mail string")


def stream_customers_within(spark: SparkSession, feed: str, like: DataFrame, existing: DataFrame,
                            out_dir: str, delay: str = "1 day", ts_col: str = "ts",
                            max_files: int | None = 8) -> DataFrame:
    """R-5 with Spark's own de-duplication state: a mobile seen again within
    ``delay`` of its first arrival (event time) is dropped
    (``dropDuplicatesWithinWatermark``); mobiles already in the static
    customer table are removed by a stream-static anti join.  Rows go to the
    Parquet file sink, whose commit log makes the output exactly-once.
    Unlike :func:`stream_customers`, a duplicate arriving after the delay is
    emitted again; use that one when first-ever-wins is required."""
    src = _read_feed(spark, feed, like, max_files)
    deduped = (src.withColumn("mobile", F.trim("mobile"))
               .withWatermark(ts_col, delay)
               .dropDuplicatesWithinWatermark(["mobile"])
               .join(existing.select("mobile"), "mobile", "left_anti"))
    root = new_root(spark, "customers-within")
    _run(deduped.writeStream.format("parquet").option("path", out_dir).outputMode("append"),
         f"{root}/checkpoint")
    return spark.read.parquet(out_dir)
