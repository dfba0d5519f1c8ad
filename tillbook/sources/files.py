"""File sources and sinks (A-1..A-8, A-10).

CSV inputs are read with explicit schemas (never inferred: a numeric-looking
mobile must stay text, leading zeros included).  Tables are Parquet; those
that are updated in place are kept in hash buckets (``sources.tables``, A-12).
"""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.windows import dense_ids, materialize

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DecimalType(10, 2)

CUSTOMER_CSV = T.StructType([T.StructField("name", S), T.StructField("mobile", S),
                             T.StructField("address", S), T.StructField("mail", S)])
SUPPLIER_CSV = T.StructType([T.StructField("id", I), T.StructField("name", S),
                             T.StructField("terms", S), T.StructField("mobile", S),
                             T.StructField("mail", S), T.StructField("timestamp", T.TimestampNTZType()),
                             T.StructField("company", S)])
# product files are read as text and typed by ``coerce_products`` (H-21)
PRODUCT_CSV = T.StructType([T.StructField(c, S) for c in (
    "pro_id", "pro_name", "cost_price", "selling_price", "net_profit", "profit_percentage",
    "quantity", "unit", "category", "safety_level", "expiry_date", "supplier_id",
    "terms_from_invoice", "hc_code")])
LEDGER_CSV = T.StructType([T.StructField("transaction_date", T.TimestampNTZType()),
                           T.StructField("invoice_no", L), T.StructField("supplier_id", I),
                           T.StructField("amount", D), T.StructField("transaction_type", S),
                           T.StructField("description", S),
                           T.StructField("balance", T.DecimalType(18, 2)),
                           T.StructField("customer_id", L)])

# computed columns that a product file may leave out
OPTIONAL = ("net_profit", "profit_percentage")
ALLOWED_EXTENSIONS = ("csv",)


class MissingColumns(ValueError):
    pass


# A-5
def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Header line -> the files under ``path`` that start with it.

    The first line of every file, found in one distributed pass over the
    file starts (a split starting at 0 exists once per file); the driver
    gets file names and header lines, which it lists anyway to read them.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    first = lines.filter("start = 0").groupBy("file").agg(F.first("value").alias("header"))
    out: dict[str, list[str]] = {}
    for r in sorted(first.collect()):
        out.setdefault(r["header"].lstrip("\ufeff"), []).append(r["file"])
    return out


def require_columns(found: dict[str, list[str]], cols) -> dict[tuple[str, ...], list[str]]:
    """Column names -> files, from :func:`headers`; rejects the whole input
    when any file misses a required column."""
    groups = {}
    for line, names in found.items():
        header = next(csv.reader([line]))
        missing = sorted(set(cols) - set(header))
        if missing:
            raise MissingColumns(f"{names[0]}: missing columns {missing}")
        groups[tuple(header)] = names
    return groups


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, ord_col: str | None,
              extra: T.StructType | None = None, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Header CSV by column *name*, plus each row's position as ``ord_col``
    for first-wins rules when the file has none: 0, 1, ... over all files of
    the input, by file path and then by place in the file.

    Every file must have all columns of ``schema`` but the ``OPTIONAL`` ones
    (and the typed ``extra`` ones, e.g. a sequence column); files may order them differently, other
    columns are ignored.  Returns ``(rows, rejects)``; ``rejects`` has
    ``file``, ``reason`` and ``record``: lines whose number of cells is not the
    header's, and rows with a cell that its type cannot hold.
    Large files are read in splits.  ``multi_line`` lets quoted cells hold
    line breaks, at the price of one task per file; without it such a row is
    rejected by its cell count.
    """
    wanted = T.StructType(schema.fields + [f for f in (extra.fields if extra else [])
                                           if f.name not in schema.fieldNames()])
    groups = require_columns(headers(spark, path), [c for c in wanted.fieldNames() if c not in OPTIONAL])
    if not groups:
        raise MissingColumns(f"{path}: no file with a header")
    place = ["_file", "_start", "_row"]
    parts = []
    for header, names in groups.items():
        text = T.StructType([T.StructField(c, S) for c in header] + [T.StructField("_record", S)])
        raw = (spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", "_record").option("escape", "\"")
               .option("enforceSchema", False).option("multiLine", multi_line).option("columnPruning", False)
               .csv([unquote(n) for n in names]))
        for c in set(wanted.fieldNames()) - set(header):
            raw = raw.withColumn(c, F.lit(None).cast(S))
        bad = None
        for f in wanted.fields:
            if f.dataType != S:
                given = F.nullif(F.trim(f.name), F.lit(""))
                fails = given.isNotNull() & given.try_cast(f.dataType).isNull()
                bad = F.when(fails, f"{f.name} is not a {f.dataType.simpleString()}") if bad is None else \
                    bad.when(fails, f"{f.name} is not a {f.dataType.simpleString()}")
        reason = F.when(F.col("_record").isNotNull(), "malformed record")
        if bad is not None:
            reason = F.coalesce(reason, bad)
        # one split of a file is read in order, so the id grows within (file, start)
        parts.append(raw.select(
            *[F.nullif(F.trim(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) if f.dataType != S
              else F.col(f.name) for f in wanted.fields],
            reason.alias("reason"), F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"),
            F.coalesce("_record", F.to_json(F.struct(*[F.col(f.name) for f in wanted.fields]))).alias("record")))
    # parsed once, with all cells: what counts as a broken record must not
    # depend on which columns are read later
    tagged = materialize(reduce(DataFrame.unionByName, parts))
    if ord_col:
        tagged = dense_ids(tagged, place, ord_col, start=0)
    keep = [*wanted.fieldNames(), *([ord_col] if ord_col else [])]
    return (tagged.filter("reason is null").select(*keep),
            tagged.filter("reason is not null").select(F.col("_file").alias("file"), "reason", "record"))


# A-1
def read_customers_csv(spark: SparkSession, path: str, ord_col: str | None = "ord",
                       extra: T.StructType | None = None, multi_line: bool = False):
    return _read_csv(spark, path, CUSTOMER_CSV, ord_col, extra, multi_line)


# A-2
def read_suppliers_csv(spark: SparkSession, path: str, ord_col: str | None = "ord",
                       extra: T.StructType | None = None, multi_line: bool = False):
    return _read_csv(spark, path, SUPPLIER_CSV, ord_col, extra, multi_line)


# A-3
def read_products_csv(spark: SparkSession, path: str, ord_col: str | None = "ord",
                      extra: T.StructType | None = None, multi_line: bool = False):
    return _read_csv(spark, path, PRODUCT_CSV, ord_col, extra, multi_line)


# A-4
def read_ledger_csv(spark: SparkSession, path: str, multi_line: bool = False):
    return _read_csv(spark, path, LEDGER_CSV, None, None, multi_line)


# A-6
def list_inputs(spark: SparkSession, path: str, ext: str = "csv") -> DataFrame:
    """Files under ``path`` with an allowed extension (case-insensitive).

    Only CSV is read; convert spreadsheets to CSV upstream.
    """
    if ext.lower() not in ALLOWED_EXTENSIONS:
        raise ValueError(f"extension {ext!r} not allowed")
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .filter(F.lower(F.col("path")).endswith(f".{ext.lower()}"))
            .select("path", "length", "modificationTime"))


# A-7
def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A plain Parquet table folder (bucketed ones: ``sources.tables``)."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


# A-8
def append_table(df: DataFrame, root: str, name: str,
                 schema: T.StructType | None = None) -> None:
    """INSERT of a whole batch: one append write (no per-row statements).

    With ``schema`` the batch is cast to it first, so every file of the
    table carries the same column types."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    df.write.mode("append").parquet(f"{root.rstrip('/')}/{name}")


# A-10
def export_ledger_csv(ledger: DataFrame, path: str) -> None:
    """Ledger CSV export: header row, every cell trimmed and quoted."""
    cols = ["transaction_date", "customer_mobile", "customer_name", "amount", "transaction_type",
            "balance"]
    cols = [c for c in cols if c in ledger.columns]
    out = ledger.select(*[F.trim(F.col(c).cast("string")).alias(c) for c in cols])
    (out.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("emptyValue", "").csv(path))
