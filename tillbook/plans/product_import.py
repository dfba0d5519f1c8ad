"""Product import as one job: CSV file -> coerce -> rejects ->
supplier enrichment -> per-key aggregate -> merge into product and
inventory -> availability -> the touched buckets of both tables.

Tables live under ``root``: product and inventory in hash buckets of the
product id (``sources.tables``), of which only those with a product of the
file are read and rewritten.  Both tables' new buckets are staged before
either is overwritten, so a batch that is run again, after success or after a
failure at any point, adds its quantities once.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillbook.operators.loads import coerce_products, import_products
from tillbook.operators.windows import materialize
from tillbook.sources import files
from tillbook.sources.tables import Bucketed, Change, publish


def product_table(root: str, buckets: int = 64) -> Bucketed:
    return Bucketed(f"{root.rstrip('/')}/product", "pro_id", buckets)


def inventory_table(root: str, buckets: int = 64) -> Bucketed:
    return Bucketed(f"{root.rstrip('/')}/inventory", "product_id", buckets)


def import_products_file(spark: SparkSession, csv_path: str, root: str, batch_id: str, extra=None,
                         buckets: int = 64) -> list[str]:
    """Tables written by the import (none if the batch is published already).
    ``root`` also holds the supplier table and gets the rejects of the batch
    as partition ``batch_id`` of ``product_rejects``."""
    root = root.rstrip("/")
    product, inventory = product_table(root, buckets), inventory_table(root, buckets)

    def changes() -> dict[str, Change]:
        rows, malformed = files.read_products_csv(spark, csv_path, ord_col=None if extra else "ord", extra=extra)
        hit = product.touched(coerce_products(rows)[0])
        supplier = files.load_table(spark, root, "supplier")
        p2, inv2, rejects = import_products(rows, product.read(spark, hit), supplier, inventory.read(spark, hit))
        rejects = materialize(rejects.unionByName(malformed.select("reason"), allowMissingColumns=True))
        (rejects.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/product_rejects"))
        return {"product": Change(product, p2, hit), "inventory": Change(inventory, inv2, hit)}

    return publish(spark, f"{root}/staging", batch_id, changes)
