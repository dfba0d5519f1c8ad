"""Skew-safe running totals, ids and first/last picks against brute force."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillbook.operators import numbering as nb
from tillbook.operators import windows as W


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    # key 'hot' holds a third of the rows
    data = [("hot" if i % 3 == 0 else f"k{rnd.randrange(40)}", i, rnd.randrange(-50, 100))
            for i in range(3000)]
    return spark.createDataFrame(data, "k string, o int, v int")


def brute(df, exclusive=False):
    upper = -1 if exclusive else 0
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, upper)
    s = F.sum("v").over(w)
    return {(r["k"], r["o"]): r["run"] for r in df.withColumn(
        "run", F.coalesce(s, F.lit(0)) if exclusive else s).collect()}


@pytest.mark.parametrize("blocks", [1, 5, 40])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_total_matches_window(spark, skewed, blocks, exclusive):
    out = W.running_total(skewed, ["k"], ["o"], F.col("v"), "run", blocks=blocks, exclusive=exclusive)
    got = {(r["k"], r["o"]): r["run"] for r in out.collect()}
    assert got == brute(skewed, exclusive)


@pytest.mark.parametrize("blocks", [1, 3, 7])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_total_null_values_and_keys(spark, blocks, exclusive):
    data = [(None if i % 3 == 0 else f"k{i % 2}", i, None if i < 9 or i % 4 == 0 else i) for i in range(60)]
    df = spark.createDataFrame(data, "k string, o int, v int")
    out = W.running_total(df, ["k"], ["o"], F.col("v"), "run", blocks=blocks, exclusive=exclusive)
    got = {(r["k"], r["o"]): r["run"] for r in out.collect()}
    assert len(got) == 60 and got == brute(df, exclusive)


def test_running_total_invariant_last_equals_sum(spark, skewed):
    out = W.running_total(skewed, ["k"], ["o"], F.col("v"), "run", blocks=9)
    last = {r["k"]: r["run"] for r in W.last_by_order(out, ["k"], ["o"], ["run"]).collect()}
    sums = {r["k"]: r["s"] for r in skewed.groupBy("k").agg(F.sum("v").alias("s")).collect()}
    assert last == sums


def test_dense_ids_consecutive(spark, skewed):
    out = nb.assign_ids(skewed, ["o"], start=100000, out="id")
    got = sorted((r["o"], r["id"]) for r in out.collect())
    assert [i for _, i in got] == list(range(100000, 100000 + 3000))


def test_row_number_in_group(spark, skewed):
    out = W.row_number_in_group(skewed, ["k"], ["o"], "pos", blocks=6)
    w = Window.partitionBy("k").orderBy("o")
    want = {(r["k"], r["o"]): r["p"] for r in skewed.withColumn("p", F.row_number().over(w)).collect()}
    assert {(r["k"], r["o"]): r["pos"] for r in out.collect()} == want


def test_first_and_last_by_order(spark, skewed):
    first = {r["k"]: r["v"] for r in W.first_by_order(skewed, ["k"], ["o"], ["v"]).collect()}
    first2 = {r["k"]: r["v"] for r in W.first_by_order(skewed.withColumn("z", F.lit(0)), ["k"],
                                                        ["z", "o"], ["v"]).collect()}
    w = Window.partitionBy("k").orderBy("o")
    want = {r["k"]: r["v"] for r in skewed.withColumn("rn", F.row_number().over(w))
            .filter("rn = 1").collect()}
    assert first == want == first2


def test_first_by_order_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("k", 3, "c")], "k string, o int, v string")
    assert {(r["k"], r["v"]) for r in W.first_by_order(df, ["k"], ["o"], ["v"]).collect()} == {(None, "a"), ("k", "c")}
