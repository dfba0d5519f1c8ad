"""First come, first served: which claims fit their resources (P-3, P-10).

Claims are accepted in order; an accepted claim uses up its resources, a
refused one uses nothing.  Row by row that is a loop over all claims.  Claims
that cannot get in each other's way are decided apart from it:

1. A claim that asks for more than its resource ever had is refused.
2. Where every claim asks one resource, the resources are independent: each
   is one ordered loop in a task, unless it has more than ``fold_rows`` rows.
3. What is left is decided in rounds.  A prefix sum decides every claim that
   fits even if all undecided claims before it are accepted, and refuses every
   one that does not fit what is accepted already.  At most ``fold_rows`` rows
   are decided by one task that runs the loop over them, and all is done.
4. Where a round decides fewer than ``fold_rows`` rows and less than a quarter
   of what was left, claims wait for each other: that task then first takes the
   earliest ``fold_rows`` rows, which nothing undecided precedes.

Claims that do not compete are thus decided by the sums at once, and a chain
of claims by the loop, ``fold_rows`` at a time.  Of any two rounds one decides
``fold_rows`` rows or a quarter of what is left; where claims meet in no
particular order, a round decides most of it.  A round reads the undecided
rows only: one pass per claim, one per resource, each written to the shared
checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.skew import join_per_key
from tillbook.operators.windows import materialize, running_totals

FOLD_ROWS = 200_000        # rows (claim, resource) that one task decides in order


def _in_order(rows: DataFrame, group: str | None) -> DataFrame:
    """``_claim`` and ``accepted`` by the loop itself, for each ``group`` (or
    all rows), which holds every row of its resources."""
    claim = rows.schema["_claim"].dataType.names
    schema = T.StructType([*rows.schema["_claim"].dataType.fields, T.StructField("accepted", T.BooleanType())])

    def verdicts(pdf: pd.DataFrame) -> Iterator[tuple]:
        columns = [pdf[c].tolist() for c in claim]
        # NULL comes first, as in Spark's order
        keys = [tuple((not pd.isna(v), None if pd.isna(v) else v) for v in k) for k in zip(*columns)]
        parts: dict[tuple, list] = {}
        for key, part in zip(keys, zip(pdf["_res"].tolist(), pdf["_need"].tolist(), pdf["_room"].tolist())):
            parts.setdefault(key, []).append(part)
        used: dict = {}
        for key in sorted(parts):
            fits = all(used.get(res, 0) + need <= room for res, need, room in parts[key])
            if fits:
                for res, need, _ in parts[key]:
                    used[res] = used.get(res, 0) + need
            yield (*[v for _, v in key], fits)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(verdicts(pdf)), columns=schema.names)

    grouped = rows.select("_claim.*", "_res", "_need", "_room",
                          (F.col(group) if group else F.lit(0)).alias("_group")).groupBy("_group")
    return grouped.applyInPandas(fold, schema).select(F.struct(*claim).alias("_claim"), "accepted")


def _fold_earliest(left: DataFrame, fold_rows: int) -> tuple[DataFrame, DataFrame]:
    """The verdicts on the earliest claims of ``left``, at most ``fold_rows``
    rows, and the other claims' rows with what those verdicts leave them."""
    # whole claims: those before the last one of the first rows
    last = left.select("_claim").orderBy("_claim").limit(fold_rows).agg(F.max("_claim")).first()[0]
    before = F.col("_claim") < F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name)
                                          for f in left.schema["_claim"].dataType.fields])
    early = materialize(_in_order(left.filter(before), None))
    done = (join_per_key(left.filter(before), early, ["_claim"], "inner").groupBy("_res")
            .agg(F.sum(F.when(F.col("accepted"), F.col("_need"))).alias("_taken"), F.sum("_need").alias("_gone")))
    rest = join_per_key(left.filter(~before), done, ["_res"])
    for out, less in (("_room", "_taken"), ("_may", "_gone")):
        rest = rest.withColumn(out, (F.col(out) - F.coalesce(less, F.lit(0))).cast(left.schema[out].dataType))
    return early, materialize(rest.drop("_taken", "_gone"))


def accept_in_order(claims: DataFrame, claim: list[str], resource: str, amount: str,
                    capacity: str, fold_rows: int | None = None) -> DataFrame:
    """``claim`` columns and ``accepted`` for every claim of ``claims``.

    ``claims`` has one row per (claim, resource); ``claim`` columns, in this
    order, are the order of service.  NULL amounts or capacities refuse; an
    empty table gives no rows.
    """
    fold_rows = fold_rows or FOLD_ROWS
    # the claim as one struct, which is equal to itself also where a column is NULL
    rows = materialize(claims.select(F.struct(*claim).alias("_claim"), F.col(resource).alias("_res"),
                                     F.col(amount).alias("_need"), F.col(capacity).alias("_room")))
    fits = F.coalesce(F.col("_need") <= F.col("_room"), F.lit(False))
    every = materialize(rows.groupBy("_claim").agg(F.bool_and(fits).alias("_open"), F.count(F.lit(1)).alias("_n")))
    left = materialize(join_per_key(rows, every.filter("_open").select("_claim"), ["_claim"], "inner",
                                    counts=every.select("_claim", "_n")))
    won: list[DataFrame] = []
    if every.filter("_open").agg(F.max("_n")).first()[0] == 1:
        sizes = left.groupBy("_res").agg(F.count(F.lit(1)).alias("_n"))
        large = sizes.filter(F.col("_n") > fold_rows).select("_res")      # at most rows / fold_rows of them
        # several small resources share a task: about an eighth of fold_rows
        total = sizes.agg(F.sum("_n")).first()[0]
        deals = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * total // fold_rows)
        small = left.join(large, "_res", "left_anti").withColumn("_deal", F.pmod(F.xxhash64("_res"), F.lit(deals)))
        won.append(_in_order(small, "_deal"))
        left = materialize(left.join(large, "_res", "left_semi"))
    n, kind = left.count(), left.schema["_room"].dataType
    if n > fold_rows:
        largest = left.groupBy("_res").count().agg(F.max("count")).first()[0]      # rows only become fewer
        left = materialize(running_totals(left, ["_res"], ["_claim"], {"_may": F.col("_need")},
                                          exclusive=True, largest=largest))
    waiting = False
    while n > fold_rows:
        if waiting:
            early, left = _fold_earliest(left, fold_rows)
            won.append(early)
            n = left.count()
        state = materialize(left.groupBy("_claim").agg(
            F.bool_and(F.col("_may") + F.col("_need") <= F.col("_room")).alias("_sure"),
            F.bool_and(F.col("_need") <= F.col("_room")).alias("_open"), F.count(F.lit(1)).alias("_n")))
        won.append(state.filter("_sure").select("_claim", F.lit(True).alias("accepted")))
        left = join_per_key(left.drop("_may"), state.filter("_open").select("_claim", "_sure"), ["_claim"], "inner",
                            counts=state.select("_claim", "_n"))
        # what the claims accepted now leave to later ones, and what undecided ones may still take
        need = F.col("_need")
        left = running_totals(left, ["_res"], ["_claim"], {"_taken": F.when(F.col("_sure"), need),
                                                           "_may": F.when(~F.col("_sure"), need)},
                              exclusive=True, largest=largest)
        left = materialize(left.filter("not _sure").withColumn(
            "_room", (F.col("_room") - F.col("_taken")).cast(kind)).drop("_taken", "_sure"))
        n, had = left.count(), n
        waiting = had - n < min(fold_rows, had // 4)
    if n:
        won.append(_in_order(left, None))
    every = every.select("_claim")
    if not won:
        return every.select("_claim.*", F.lit(False).alias("accepted"))
    accepted = reduce(DataFrame.unionByName, won).filter("accepted")
    return materialize(every.join(accepted, "_claim", "left")
                       .select("_claim.*", F.coalesce("accepted", F.lit(False)).alias("accepted")))
