"""Exact groups of texts of several chunks: composed hashes, comparison."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tillbook.llm import fingerprints


def long_texts():
    rng = random.Random(5)
    size = fingerprints.CHUNK_BYTES
    base = "".join(rng.choice("abcdEFG é\n") for _ in range(3 * size))
    other = base[:size // 2] + "#" + base[size // 2 + 1:]               # one character of the first chunk
    swapped = base[size:2 * size] + base[:size] + base[2 * size:]
    exact = "x" * size                                                  # ends with its chunk
    return [(1, base), (2, base.upper().replace("É", "é")), (3, other), (4, swapped), (5, base + "a"), (6, exact),
            (7, exact.upper()), (8, exact + "x"), (9, exact * 2), (9, exact * 2), (10, ""), (11, None), (None, base),
            (12, exact * 5 + "y"), (13, exact * 5 + "Y"), (14, "y" + exact * 5)]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fingerprints.normalised(t)].append(i)
    return sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(data).hexdigest())
                  for data, ids in groups.items() for i in ids)


@pytest.mark.parametrize("hash_fn", [fingerprints.fingerprint, lambda chunk: len(chunk) % 3, lambda chunk: 7])
def test_groups_of_long_texts(spark, hash_fn):
    rows = long_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fingerprints.exact_groups(docs, hash_fn=hash_fn).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == expected(rows)
    assert sum(r["kept"] for r in got) == len({fingerprints.normalised(t) for _, t in rows})


def test_the_aggregate_composes_as_one_pass_does(spark):
    rows = [(i, t) for i, t in long_texts() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = fingerprints.stored(fingerprints._chunk_rows(docs), "chunks-test")
    got = sorted((r["doc_id"], r["fp"]) for r in fingerprints._composed(chunks).collect())
    assert got == sorted((i, fingerprints.fingerprint(fingerprints.normalised(t))) for i, t in rows)
    assert chunks.agg(F.countDistinct("row_no")).first()[0] == len(rows)
