"""What a Python worker and its executor keep from batch to batch and from
task to task."""

import pytest
from pyspark.sql import functions as F

from tillbook.llm import (common, configuration_packing, fingerprints, ngram_join, packing, queries, rules,
                          secret_scan)

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
OPERATORS = {
    "pack": lambda d: packing.pack(d, queries.WORD_TOKENIZER),
    "configuration": lambda d: configuration_packing.pack(d, queries.BYTE_TOKENIZER),
    "judge": lambda d: rules.judge(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "keep_good": lambda d: rules.keep_good(d, d.select("doc_id", F.lit(1).alias("quality"))),
    "exact_groups": fingerprints.exact_groups,
    "keep_one": fingerprints.keep_one,
    "jaccard_join": ngram_join.jaccard_join,
    "keep_one_per_class": ngram_join.keep_one_per_class,
    "scan_secrets": secret_scan.scan_secrets,
    "mask_secrets": secret_scan.mask_secrets,
}


def batches(docs):
    """(rows, bytes) of the batches that a worker gets."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})
    return [tuple(r) for r in docs.coalesce(1).mapInArrow(run, "n long, size long").collect()]


@pytest.mark.parametrize("name", OPERATORS)
def test_workers_get_small_batches(spark, name):
    own = spark.newSession()
    OPERATORS[name](own.createDataFrame([(1, "one text", "en")], "doc_id long, text string, lang string"))
    long = own.range(120).select(F.col("id").alias("doc_id"), F.expr("repeat('abcdefghi ', 10000)").alias("text"))
    got = batches(long)
    assert sum(n for n, _ in got) == 120
    assert len(got) > 3 and max(size for _, size in got) < 4 << 20


def test_a_limit_of_the_session_stays(spark):
    own = spark.newSession()
    own.conf.set(LIMIT, "123456")
    OPERATORS["pack"](own.createDataFrame([(1, "one text")], "doc_id long, text string"))
    assert own.conf.get(LIMIT).rstrip("b") == "123456"


def test_a_worker_loads_a_tokenizer_once():
    for kind, field, path in ((packing.WordEncoder, "tokenizer", queries.WORD_TOKENIZER),
                              (configuration_packing.Encoder, "whole", queries.BYTE_TOKENIZER)):
        one, two = kind(path), kind(path)
        assert getattr(one, field) is getattr(two, field)
    assert common.loaded_tokenizer(queries.WORD_TOKENIZER) is not common.loaded_tokenizer(queries.BYTE_TOKENIZER)
