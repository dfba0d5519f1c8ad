"""Joins of facts with a table of one row per key, safe for hot keys.

Adaptive execution splits a skewed join partition only where the join reads
the exchange itself.  A table that was just aggregated on the join key needs
no further exchange, so the aggregate sits between the two and the hot key
stays in one task.  ``join_per_key`` measures the keys first and, where some
are hot, deals their rows over salts and repeats their one row per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1000            # a key with no more rows is never hot
HOT_KEYS = 1000            # a hot key has more than one row in so many: at most so many hot keys
SALTS = 16                 # of a table with one key only, per shuffle partition


def join_per_key(facts: DataFrame, per_key: DataFrame, on: list[str], how: str = "left",
                 salts: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """``facts`` joined (``how``: left or inner) with ``per_key``, which has
    at most one row for each value of ``on``.

    One grouped count of the facts' keys (a partial aggregate, only the key
    columns are read) tells whether a key is hot.  If none is, this is the
    plain join.  Else a hot key's rows go to as many salts as its share of the
    rows asks for, by a hash of the whole row (so a task that is run again
    deals them alike; rows equal in every column stay together), and its row
    of ``per_key`` is repeated for each.  The list of hot keys, bounded by
    ``HOT_KEYS``, is broadcast.  NULL keys match nothing, but are dealt too.

    ``counts`` (``on`` and ``_n``, the facts' rows of each key) spares the
    count where the caller has it: of facts that are joins themselves it would
    hold their whole plan once more.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unknown join {how!r}")
    others = [c for c in per_key.columns if c not in on]
    if counts is None:
        counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    rows, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(HOT_ROWS, (rows or 0) // HOT_KEYS)
    if not rows or largest <= limit:
        return facts.join(per_key, on, how).select(*facts.columns, *others)
    salts = salts or SALTS * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(counts.filter(F.col("_n") > limit).select(
        *[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(on)],
        F.ceil(F.col("_n") * salts / rows).cast("int").alias("_salts")))

    def tagged(df: DataFrame) -> DataFrame:
        same = F.lit(True)
        for i, k in enumerate(on):
            same = same & F.col(k).eqNullSafe(F.col(f"_hot_{i}"))
        return df.join(hot, same, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))

    dealt = tagged(facts).withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int"))
    copies = tagged(per_key).select(*per_key.columns, F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    return dealt.join(copies, [*on, "_salt"], how).select(*facts.columns, *others)
