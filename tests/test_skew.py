"""Hot keys in joins with per-key tables, running totals from a base, and
acceptance in order against the loop."""

import random
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillbook.operators import greedy, skew
from tillbook.operators import windows as W


def tasks(df):
    """Rows per task of a result, all columns computed."""
    per_task = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"),
                                                                 F.max(F.xxhash64(*df.columns)))
    return sorted(r["n"] for r in per_task.collect())


@pytest.fixture
def sixteen(spark):
    """Sixteen shuffle partitions, none merged, nothing broadcast by size."""
    own = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
           "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def facts(sixteen):
    """Half the rows on key 7, a tenth on NULL, the rest on 2,000 keys."""
    return sixteen.range(80_000).select(
        F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 2000).alias("k"),
        F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_per_key_is_the_join(facts, how, monkeypatch):
    per_key = facts.filter("k is null or k % 3 != 0").groupBy("k").agg(F.sum("v").alias("total"))
    want = facts.join(per_key, ["k"], how).select("k", "v", "total")
    assert rows(skew.join_per_key(facts, per_key, ["k"], how).fillna(-1)) == rows(want.fillna(-1))
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    salted = skew.join_per_key(facts, per_key, ["k"], how)
    assert salted.columns == ["k", "v", "total"] and rows(salted.fillna(-1)) == rows(want.fillna(-1))


def test_no_task_holds_the_hot_key(facts, monkeypatch):
    per_key = facts.groupBy("k").agg(F.sum("v").alias("total"))
    plain = tasks(facts.join(per_key, "k", "left"))
    assert plain[-1] > 5 * plain[len(plain) // 2]            # what the helper is for
    monkeypatch.setattr(skew, "HOT_ROWS", 500)
    dealt = tasks(skew.join_per_key(facts, per_key, ["k"]))
    assert len(dealt) == 16 and dealt[-1] <= 2 * dealt[len(dealt) // 2]


def test_join_per_key_of_empty_tables(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert skew.join_per_key(none, none.withColumnRenamed("v", "w"), ["k"]).columns == ["k", "v", "w"]
    one = spark.createDataFrame([(1, 2)], "k long, v long")
    assert rows(skew.join_per_key(one, none.withColumnRenamed("v", "w"), ["k"]).fillna(0)) == [(1, 2, 0)]


@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("blocks", [None, 5])
def test_running_totals_from_a_base(spark, blocks, exclusive):
    rnd = random.Random(6)
    data = [(rnd.choice([None, 1, 1, 1, 2, 3]), i, rnd.choice([None, 1, 5, 7])) for i in range(200)]
    base = {1: 100, 2: None, None: 50}
    out = W.running_total(spark.createDataFrame(data, "k long, o long, v long"), ["k"], ["o"], F.col("v"), "run", blocks,
                          exclusive, spark.createDataFrame(list(base.items()), "k long, run long"))
    want, seen = [], {}
    for k, o, v in data:
        before = seen.get(k)
        after = before if v is None else (before or 0) + v
        seen[k] = after
        run = (before or 0) if exclusive else after
        want.append((o, None if run is None else run + (base.get(k) or 0)))
    assert [tuple(r) for r in out.select("o", "run").orderBy("o").collect()] == want


def test_blocks_are_used_where_a_key_is_large(facts, monkeypatch):
    monkeypatch.setattr(W, "KEY_ROWS", 1000)
    out = W.running_total(facts, ["k"], ["v"], F.lit(1).cast("long"), "n")
    per_task = tasks(out)
    assert per_task[-1] <= 2.5 * per_task[len(per_task) // 2]
    assert out.filter("k = 7").agg(F.max("n")).first()[0] == 40_040


def loop(claims):
    """(claim, resource, need, room) rows -> accepted claims."""
    used, won, parts = {}, set(), {}
    for c, r, n, room in claims:
        parts.setdefault(c, []).append((r, n, room))
    for c in sorted(parts):
        if all(n is not None and room is not None and used.get(r, 0) + n <= room for r, n, room in parts[c]):
            won.add(c)
            for r, n, _ in parts[c]:
                used[r] = used.get(r, 0) + n
    return won


def accepted(spark, data, fold_rows, kind="long"):
    df = spark.createDataFrame(data, f"claim long, res long, need {kind}, room {kind}")
    out = greedy.accept_in_order(df, ["claim"], "res", "need", "room", fold_rows).collect()
    assert len(out) == len({d[0] for d in data})
    return {r["claim"] for r in out if r["accepted"]}


@pytest.mark.parametrize("fold_rows", [None, 40])
def test_acceptance_equals_the_loop(spark, fold_rows):
    rnd = random.Random(9)
    room = {r: rnd.choice([None, *range(5, 60)]) for r in range(15)}
    data = [(c, r, rnd.choice([None, *range(1, 12)] if c % 30 == 0 else range(1, 12)), room[r])
            for c in range(150) for r in rnd.sample(range(15), rnd.randint(1, 3))]
    assert accepted(spark, data, fold_rows) == loop(data)


@pytest.mark.parametrize("fold_rows", [None, 60])
def test_acceptance_of_one_resource_each(spark, fold_rows):
    rnd = random.Random(3)
    room = {r: Dec(rnd.randint(0, 400)) for r in range(6)}
    data = []
    for c in range(300):
        r = 0 if c % 3 == 0 else rnd.randrange(6)            # a resource with a third of the claims
        data.append((c, r, Dec(rnd.randint(1, 2000)) / 100, room[r]))
    assert accepted(spark, data, fold_rows, "decimal(12,2)") == loop(data)


def test_a_long_chain_ends_in_few_rounds(spark, monkeypatch):
    # claim i needs resources i and i + 1, of which there is one each: every
    # claim waits for the one before it
    data = [(i, r, 1, 1) for i in range(10_000) for r in (i, i + 1)]
    folds = []
    fold = greedy._in_order
    monkeypatch.setattr(greedy, "_in_order", lambda *a: folds.append(1) or fold(*a))
    assert accepted(spark, data, 2_500) == set(range(0, 10_000, 2))
    assert len(folds) < 20


def test_acceptance_of_nothing(spark):
    assert accepted(spark, [(1, 1, None, 5), (2, 1, 3, None)], None) == set()
    df = spark.createDataFrame([], "claim long, res long, need long, room long")
    assert greedy.accept_in_order(df, ["claim"], "res", "need", "room").collect() == []
