"""Thin queries over the driver tables: production parameters, whole tables.

Contract columns (digests, counts) are derived here from each operator's own
output.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (centroids, configuration_packing, factorisation, fill_middle, fingerprints, language_id,
                          license_scan, ngram_join, packing, rules, secret_scan, sentencepieces, token_counts)
from tillbook.llm.common import table

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "sequence_length")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factorisation.score(docs, factorisation.train(docs, table(spark, sf_dir, "labels")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.exact_groups(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = license_scan.scan_licenses(table(spark, sf_dir, "documents"))

    def text(h: Column) -> Column:
        return F.concat_ws(":", h["unit"], h["number"].cast("string"), h["license"], h["shared"].cast("string"),
                           h["unit_size"].cast("string"), h["template_size"].cast("string"))

    return hits.select("doc_id", F.size("hits").cast("long").alias("n_hits"),
                       F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"]))), ",")
                       .alias("licenses"),
                       F.array_join(F.array_sort(F.transform("hits", text)), ",").alias("hits"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def text(of: Column) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def only(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = only(*secret_scan.BASE_KINDS)
    return spans.select("doc_id", *[F.size(only(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS],
                        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_MODEL).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sentencepieces.encode_decode(table(spark, sf_dir, "documents"), PIECE_MODEL)
    return made.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configuration_packing.pack(table(spark, sf_dir, "documents"), BYTE_TOKENIZER).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))

    def digest(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       digest(F.col("output")).alias("output_sha256"),
                       digest(fill_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
        .alias("centroid_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    own = (op1_harmonic_packing, op2_quality_rules, op3_factorisation_machine, op4_exact_dedup, op5_license_scan,
           op6_secret_scan, op7_ngram_join, op8_language_id, op9_token_counts, op10_sentencepiece, op11_configuration_packing,
           op12_fill_middle, op13_centroid_clustering)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from tillbook.llm.oracle import SQL
    return dict(SQL)
