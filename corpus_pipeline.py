"""A training corpus from raw documents: five stages, each an operator of
``tillbook.llm`` over what its predecessor kept.

1. quality rules: documents that the rules reject go;
2. exact dedup: of equal texts one row stays;
3. n-gram Jaccard join: of each class of near duplicates one document stays;
4. secret scan: secrets in the texts are masked;
5. packing: the texts become sequences of token ids.

Stages 1 to 4 return the columns of ``documents``.  An empty table gives no
rows at any stage; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import fingerprints, ngram_join, packing, rules, secret_scan
from tillbook.llm.queries import WORD_TOKENIZER
from tillbook.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules; a null or empty text has no words and goes, a
    null id is judged like any other, repeated rows all stay or all go."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest id (of
    repeated rows, one); null and empty texts are one group."""
    return fingerprints.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each class; a null id only where there
    is no other.  Rows without words all stay."""
    return ngram_join.keep_one_per_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masked texts; ``n_chars`` follows the text where it changed.  Every row
    stays, null and empty texts as they are."""
    return secret_scan.mask_secrets(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every row's ids; a null or empty text is its end id alone,
    repeated rows are packed each."""
    return packing.pack(docs, WORD_TOKENIZER)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mask_secrets", mask_secrets), ("pack", pack)]

# The packed ids come from a tokenizer library: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and
    reread as the next stage's input."""
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
