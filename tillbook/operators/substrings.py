"""Substring search by an index of trigrams (B-5, B-14, B-15, B-16).

``contains`` reads every text.  The index lists, for every three characters in
a row of a lowered text, the keys of the rows that hold them.  A needle's rows
are in the lists of all its trigrams; its rarest lists are read and
intersected, and the rows found are verified with the scan's own predicate, so
results equal the scan's.  Postings lie in folders by a hash of the trigram,
sorted within: a search reads a few folders, and in them the row groups of its
trigrams.  A frequent trigram's list spreads over several files.

Needles with fewer than three characters, or with wildcards where these are
live, have no trigrams to ask for: they take the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions import rules as R
from tillbook.operators import ledger as lg
from tillbook.operators import reports as rp
from tillbook.operators.windows import materialize

GRAM = 3
LISTS = 6                  # of a needle's trigrams, so many of the rarest are asked for


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lowered text; none for NULL or shorter
    texts.  Meant for names: the cost grows with the square of the length."""
    low = F.lower(text)
    n = F.length(low) - (GRAM - 1)
    return F.when(n >= 1, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: low.substr(i, F.lit(GRAM))))) \
        .otherwise(F.array().cast("array<string>"))


class TrigramIndex:
    """Postings (gram, field, key) and list lengths (gram, field, n), under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def add(self, df: DataFrame, key: str, fields: list[str]) -> None:
        """Index the texts ``fields`` of ``df``; call it again with the rows
        that are new or renamed.  A posting that is no longer true, or is
        there twice, costs a verification and changes no result."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        named = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]))
        # names lie in few bytes, their trigrams are many: dealt over tasks first, and made once
        rows = materialize(
            df.select(F.col(key).cast("string").alias("key"), named.alias("f")).repartition(n)
            .select("key", "f.field", F.explode(trigrams(F.col("f.text"))).alias("gram"))
            .withColumn("bucket", self._bucket(F.col("gram"))))
        (rows.repartitionByRange(n, "bucket", "gram", "key").sortWithinPartitions("bucket", "gram", "key")
         .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings"))
        (rows.groupBy("bucket", "field", "gram").agg(F.count(F.lit(1)).alias("n"))
         .repartitionByRange(n, "bucket", "gram").sortWithinPartitions("bucket", "gram")
         .write.mode("append").partitionBy("bucket").parquet(f"{self.path}/lengths"))

    def _read(self, table: str, schema: str, grams: list[str]) -> DataFrame:
        """The rows of the given trigrams: their folders are known when planning."""
        numbers = self.spark.range(1).select(F.explode(F.array(*[self._bucket(F.lit(g)) for g in grams])))
        rows = self.spark.read.schema(schema + ", bucket int").parquet(f"{self.path}/{table}")
        return rows.filter(F.col("bucket").isin(sorted({r[0] for r in numbers.collect()})) & F.col("gram").isin(grams))

    def candidates(self, needle: str, field: str) -> DataFrame | None:
        """Keys (``key``, a string) of rows whose ``field`` may contain the
        needle; None where the index cannot tell (a needle too short)."""
        # a row per trigram of the needle reaches the driver, here and below
        grams = self.spark.range(1).select(F.explode(trigrams(F.lit(needle)))).collect()
        grams = [g[0] for g in grams]
        if not grams:
            return None
        schema = "field string, gram string, n long"
        sizes = {r["gram"]: r["n"] for r in self._read("lengths", schema, grams).filter(F.col("field") == field)
                 .groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):
            return self.spark.createDataFrame([], "key string")
        ask = sorted(grams, key=lambda g: (sizes[g], g))[:LISTS]
        bit = reduce(lambda c, i: c.when(F.col("gram") == ask[i], F.lit(1 << i)), range(1, len(ask)),
                     F.when(F.col("gram") == ask[0], F.lit(1)))
        return (self._read("postings", "key string, field string, gram string", ask)
                .filter(F.col("field") == field).groupBy("key").agg(F.bit_or(bit).alias("_held"))
                .filter(F.col("_held") == (1 << len(ask)) - 1).select("key"))

    def narrow(self, df: DataFrame, key: str, field: str, needle: str) -> DataFrame:
        """The rows of ``df`` worth verifying (all, if the index cannot tell)."""
        keys = self.candidates(needle, field)
        if keys is None:
            return df
        return df.join(keys.select(F.col("key").cast(df.schema[key].dataType).alias(key)), key, "left_semi") \
            .select(*df.columns)


def search_products(product: DataFrame, index: TrigramIndex, text: str) -> DataFrame:
    """B-15 over an index of ``pro_name`` by ``pro_id``."""
    return rp.search_products(index.narrow(product, "pro_id", "pro_name", text), text)


def suggest_products(inventory: DataFrame, index: TrigramIndex, needle: str, n: int = 10) -> DataFrame:
    """B-5 over an index of ``product_name`` by ``product_id``; live wildcards
    (and the escape character) take the scan."""
    if not any(c in needle for c in "%_\\"):
        inventory = index.narrow(inventory, "product_id", "product_name", needle)
    return rp.suggest_products(inventory, needle, n)


def search_inventory(inventory: DataFrame, index: TrigramIndex, text: str, scheme: str = "page") -> DataFrame:
    """B-16 over an index of ``product_name`` by ``product_id``.  A text that
    occurs in one of the few availability labels matches by label and takes
    the scan; any other can match by name only."""
    t = text.strip().lower()
    levels = inventory.sparkSession.createDataFrame([(v,) for v in (None, *range(6))], "availability int")
    labels = [r[0].lower() for r in levels.select(R.availability_label("availability", scheme)).collect()]
    if not any(t in label for label in labels):
        inventory = index.narrow(inventory, "product_id", "product_name", t)
    return rp.search_inventory(inventory, text, scheme)


def filter_ledger(ledger: DataFrame, index: TrigramIndex, text: str = "", ttype: str = "",
                  customer: str = "", date: str = "") -> DataFrame:
    """B-14 over an index of the customers' ``customer_name`` and
    ``customer_mobile`` by ``customer_mobile``: the ledger keeps the rows of
    the customers found.  Every name the ledger shows for a mobile must be
    indexed under it; rows without a mobile are searched as they are."""
    if text:
        found = [index.candidates(text, f) for f in ("customer_mobile", "customer_name")]
        if found[0] is not None:
            keys = found[0].unionByName(found[1]).distinct().withColumnRenamed("key", "customer_mobile")
            hit = ledger.join(keys, "customer_mobile", "left_semi").select(*ledger.columns)
            ledger = hit.unionByName(ledger.filter(F.col("customer_mobile").isNull()))
    return lg.filter_ledger(ledger, text, ttype, customer, date)
