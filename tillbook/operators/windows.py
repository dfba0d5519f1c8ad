"""Order-dependent computations that stay balanced when one key is hot.

A plain ``sum().over(Window.partitionBy(k).orderBy(o))`` sends every row of a
key to one task; if one customer (or product, or invoice) holds a third of
the rows, that task holds a third of the data.  ``running_totals`` counts the
keys first.  Where every key fits a task (``KEY_ROWS``), it is that plain
window; where one does not, every key, whatever its size, is cut into blocks:

1. ``repartitionByRange(n, keys + order)`` cuts the sorted sequence into n
   blocks of about equal size.  A large key spans several blocks.
2. A window over (key, block) gives the running total inside each block;
   no (key, block) group is larger than one block.
3. Block totals per (key, block) are pre-aggregated map-side; a window over
   those few rows per key gives each block's offset.
4. Offset + in-block running total = the running total over the whole key.

Steps 2 and 3 must see the *same* blocks.  Two separate range exchanges
may sample different boundaries (their inputs can arrive in a different
order), so the block-tagged rows are written once as a Parquet table into
the shared ``spark.checkpoint.dir`` folder and both steps read that copy.
A lost executor then re-reads the table instead of re-sampling, and
whatever produced the rows is evaluated once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_ROWS = 1 << 20         # rows of one key that a task may sort
BLOCKS = 8                 # per shuffle partition, where a key has more

_BLK, _RUN, _OFF, _TOT, _MID = "_tb_blk", "_tb_run", "_tb_off", "_tb_tot", "_tb_mid"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a Parquet table under the shared checkpoint
    folder and read it back (a lineage cut, like ``checkpoint()``, but with
    a columnar vectorized write instead of row serialization)."""
    from tillbook.session import scratch_path
    path = scratch_path(df.sparkSession, f"blocks-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _blocks(df: DataFrame, blocks: int | None) -> int:
    if blocks:
        return blocks
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fine_blocks(df: DataFrame, blocks: int | None) -> int:
    """Blocks of a large key are dealt over the tasks by hash: with several
    per task no task gets many more than another."""
    return blocks or BLOCKS * _blocks(df, None)


def _same_keys(keys: list[str]) -> Column:
    """Keys equal to those of a per-key table (``_tb_k0``, ...), NULL included."""
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_tb_k{i}"))
    return same


def running_totals(df: DataFrame, keys: list[str], order: list, values: dict,
                   blocks: int | None = None, exclusive: bool = False,
                   base: DataFrame | None = None, largest: int | None = None) -> DataFrame:
    """Add a running sum per ``keys`` in ``order`` for each of ``values``
    (output name -> column), all in one pass.

    ``order`` must make rows unique within a key (else ties are arbitrary).
    ``exclusive=True`` gives the sum of the rows strictly before each row, 0
    at the first.  NULL values count as nothing: the (inclusive) sum is NULL
    until the key's first value, as SQL's windowed SUM is.  A NULL key is a
    key like any other.  ``base`` (the keys, at most one row each, and a
    column for every output) is where the sums of a key start; keys it lacks
    start from 0.

    Where no key has more than ``KEY_ROWS`` rows (one count of the keys), a
    window per key does; else, or with ``blocks`` given, keys of every size
    are cut into blocks, and ``base`` meets the few rows per (key, block)
    rather than the facts.  ``largest``, no fewer rows than any key has, spares
    the count where the caller knows it.
    """
    order_cols = [_col(o) for o in order]
    upper = Window.currentRow - 1 if exclusive else Window.currentRow
    start = None if base is None else base.select(*[F.col(k).alias(f"_tb_k{i}") for i, k in enumerate(keys)],
                                                  *[F.col(out).alias(f"_tb_base{j}") for j, out in enumerate(values)])
    if not blocks and largest is None:
        largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if not blocks and largest <= KEY_ROWS:
        w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, upper)
        sums = df.select("*", *[F.sum(_col(v)).over(w).alias(f"{_RUN}{j}") for j, v in enumerate(values.values())])
        if start is not None:
            sums = sums.join(start, _same_keys(keys), "left")

        def whole(j: int) -> Column:
            run = F.col(f"{_RUN}{j}")
            run = F.coalesce(run, F.lit(0)) if exclusive else run
            return run if start is None else run + F.coalesce(F.col(f"_tb_base{j}"), F.lit(0))

        return sums.select(*df.columns, *[whole(j).alias(out) for j, out in enumerate(values)])
    tot, run, off = ({out: f"{p}{i}" for i, out in enumerate(values)} for p in (_TOT, _RUN, _OFF))
    tagged = materialize(df.withColumns({tot[out]: _col(v) for out, v in values.items()})
                         .repartitionByRange(_fine_blocks(df, blocks), *[F.col(k) for k in keys], *order_cols)
                         .withColumn(_BLK, F.spark_partition_id()))
    w_in = (Window.partitionBy(*keys, _BLK).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, upper))
    local = tagged.withColumns({run[out]: F.sum(tot[out]).over(w_in) for out in values})
    block_sum = tagged.groupBy(*keys, _BLK).agg(*[F.sum(tot[out]).alias(tot[out]) for out in values])
    w_prev = (Window.partitionBy(*keys).orderBy(_BLK)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = block_sum.select(*keys, F.col(_BLK).alias(_MID),
                              *[F.sum(tot[out]).over(w_prev).alias(off[out]) for out in values])
    based = [f"_tb_base{j}" for j in range(len(values))] if start is not None else []
    if start is not None:
        before = before.join(start, _same_keys(keys), "left")
    # renamed keys: the match is null-safe, so rows of a NULL key stay
    offsets = before.select(*[F.col(k).alias(f"_tb_k{i}") for i, k in enumerate(keys)], _MID, *off.values(), *based)
    same = (F.col(_BLK) == F.col(_MID)) & _same_keys(keys)

    def total(j: int, out: str) -> Column:
        before, here = F.col(off[out]), F.col(run[out])
        sums = F.when(before.isNull(), here).otherwise(before + F.coalesce(here, F.lit(0)))
        sums = F.coalesce(sums, F.lit(0)) if exclusive else sums
        return sums + F.coalesce(based[j], F.lit(0)) if based else sums

    return local.join(offsets, same).select(*df.columns, *[total(j, out).alias(out) for j, out in enumerate(values)])


def running_total(df: DataFrame, keys: list[str], order: list, value, out: str,
                  blocks: int | None = None, exclusive: bool = False, base: DataFrame | None = None) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, keys, order, {out: value}, blocks, exclusive, base)


def row_number_in_group(df: DataFrame, keys: list[str], order: list, out: str,
                        blocks: int | None = None) -> DataFrame:
    """1-based position of each row within its key, skew-safe."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, blocks)


def dense_ids(df: DataFrame, order: list, out: str, start: int = 1,
              blocks: int | None = None) -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` following ``order`` (unique).

    The classic zip-with-index: range-partition, sort inside each partition,
    count rows per partition (one row per partition, so the offset table is
    bounded by the partition count and safe to broadcast), then add each
    partition's offset to the row's position inside it.
    """
    n = _blocks(df, blocks)
    order_cols = [_col(o) for o in order]
    tagged = materialize(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                          .withColumn(_BLK, F.spark_partition_id())
                          .withColumn(_MID, F.monotonically_increasing_id()))
    counts = tagged.groupBy(_BLK).agg(F.count(F.lit(1)).alias(_TOT))
    w_prev = Window.orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(_BLK, F.coalesce(F.sum(_TOT).over(w_prev), F.lit(0)).alias(_OFF))
    local_pos = F.col(_MID) - F.shiftleft(F.col(_BLK).cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), _BLK)
            .withColumn(out, (F.lit(start) + F.col(_OFF) + local_pos).cast("long"))
            .drop(_BLK, _MID, _OFF))


def first_by_order(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """First row per key in ``order`` (ascending), as an aggregate; ``order``
    must be unique within a key (a file position, a line key).

    One order column: a hash ``min(order)`` per key, then the rows are
    matched back on (key, order); the match is partitioned by both columns,
    so a hot key spreads over tasks, and is null-safe: NULL is a key like
    any other.  Several order columns:
    ``min(struct(order..., cols...))``, also a partial aggregate (each task
    keeps one candidate per key before the shuffle).
    """
    if len(order) == 1:
        o = order[0]
        firsts = (df.groupBy(*keys).agg(F.min(o).alias(_TOT))
                  .select(_TOT, *[F.col(k).alias(f"_tb_k{i}") for i, k in enumerate(keys)]))
        same = (F.col(o) == F.col(_TOT)) & _same_keys(keys)
        return df.join(firsts, same).select(*keys, *[c for c in cols if c not in keys])
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in cols])
    best = df.groupBy(*keys).agg(F.min(packed).alias("_tb_first"))
    return best.select(*keys, *[F.col(f"_tb_first.{c}").alias(c) for c in cols])


def last_by_order(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Last row per key in ``order`` (the newest), as one partial aggregate."""
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in cols])
    best = df.groupBy(*keys).agg(F.max(packed).alias("_tb_last"))
    return best.select(*keys, *[F.col(f"_tb_last.{c}").alias(c) for c in cols])
