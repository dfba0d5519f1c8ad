"""Exact integer k-means with a LAESA pivot table.

The distances of every vector to a few fixed pivots are computed once and
stored beside the vector.  A round computes the centroids' distances to the
pivots (a table of centroids x pivots); by the triangle inequality the largest
difference of the two rows bounds a vector's distance to a centroid from
below.  Only centroids whose bound does not exceed the best distance known get
an exact integer distance.

A round is one pass over the stored table: tasks assign their vectors and
emit one partial sum per centroid, Spark adds these up, and the sums (at most
one row per centroid) reach the driver, which needs them to move the
centroids.  No vector is shuffled, so it does not matter how many vectors are
equal or share a centroid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.llm.common import column, stored, trim

SCALE = 256
LARGEST = 2.0 ** 20        # of a component: sums of squared differences stay within 64 bits
SLICE_ROWS = 2048          # vectors whose bounds are held at once


def kept_vectors(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``q`` (components times ``SCALE``, rounded down) of the
    vectors of exactly ``dims`` components, none null or non-finite."""
    rows = vectors.select(column(id_col).alias("vec_id"), column(vector_col).cast("array<double>").alias("v"))
    good = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    checked = F.transform("v", lambda x: F.when(F.abs(x) <= LARGEST, x).otherwise(
        F.raise_error(F.lit(f"a component is larger than {LARGEST:.0f}")).cast("double")))
    return (rows.filter(F.coalesce(good, F.lit(False)))
            .select("vec_id", F.transform(checked, lambda x: F.floor(x * SCALE).cast("int")).alias("q")))


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors (rows; a repeated row counts each time) of the
    smallest SHA-256 of ``seed:id``; ties go to the smaller components."""
    key: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
                         .cast("binary"), 256)
    return [r["q"] for r in kept.select("q", key.alias("h")).orderBy("h", "q").limit(k).collect()]


def chosen_pivots(candidates: list[list[int]], n: int) -> list[list[int]]:
    """``n`` of the candidates far from each other: the first one, then
    always the one farthest from those chosen."""
    import numpy as np
    points = np.array(candidates, dtype=np.int64)
    out, nearest = [0], None
    while len(out) < min(n, len(points)):
        d = ((points - points[out[-1]]) ** 2).sum(axis=1)
        nearest = d if nearest is None else np.minimum(nearest, d)
        if not nearest.max():
            break
        out.append(int(nearest.argmax()))
    return points[out].tolist()


def squared(x, y):
    """Exact squared distances of the rows of ``x`` to one vector ``y``."""
    d = x - y
    return (d * d).sum(axis=1)


def nearest(x, to_pivots, centroids, centroids_to_pivots):
    """Number of the nearest centroid (ties: the smaller number) and the
    squared distance, for every row of ``x``; also how many exact distances
    were computed."""
    import numpy as np
    rows = np.arange(len(x))
    bounds = np.abs(to_pivots[:, None, :] - centroids_to_pivots[None, :, :]).max(axis=2)
    # the centroid of the least bound first: it sets what others must beat
    guess = bounds.argmin(axis=1)
    best, distance = guess.astype(np.int64), ((x - centroids[guess]) ** 2).sum(axis=1)
    exact = len(x)
    # room for the rounding of the roots: a centroid at the same distance survives
    limit = np.sqrt(distance) * (1 + 1e-9) + 1e-6
    for c in range(len(centroids)):
        at = rows[(bounds[:, c] <= limit) & (guess != c)]
        if not len(at):
            continue
        d = squared(x[at], centroids[c])
        exact += len(at)
        better = (d < distance[at]) | ((d == distance[at]) & (c < best[at]))
        at, d = at[better], d[better]
        best[at], distance[at] = c, d
        limit[at] = np.sqrt(d) * (1 + 1e-9) + 1e-6
    return best, distance, exact


def over_vectors(table: DataFrame, centroids: list[list[int]], pivots: list[list[int]], schema: T.StructType,
                 emit: Callable) -> DataFrame:
    """``emit(vec_ids, x, best, distance, exact)`` -> column lists, or None,
    for every slice of the table; ``emit()`` at the end of a task."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        c, p = np.array(centroids, dtype=np.int64), np.array(pivots, dtype=np.int64)
        c_to_p = np.sqrt(np.stack([squared(c, v) for v in p], axis=1).astype(np.float64))
        state: dict = {}

        def batch_of(columns):
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                x = part.column(1).flatten().to_numpy().reshape(part.num_rows, -1).astype(np.int64)
                to_p = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
                made = emit(state, part.column(0), x, *nearest(x, to_p, c, c_to_p))
                if made:
                    yield batch_of(made)
        made = emit(state)
        if made:
            yield batch_of(made)
        trim()

    return table.select("vec_id", "q", "to_pivots").mapInArrow(run, schema)


def summed(table: DataFrame, centroids: list[list[int]], pivots: list[list[int]]) -> DataFrame:
    """Per non-empty centroid: ``cluster``, ``n``, ``total`` (distances) and
    the components' sums ``s0``, ``s1``, ...; the work done in ``exact``."""
    dims = len(centroids[0])
    fields = ["cluster", "n", "total", "exact", *[f"s{i}" for i in range(dims)]]
    schema = T.StructType([T.StructField(f, T.LongType()) for f in fields])
    k = len(centroids)

    def emit(state, vec_ids=None, x=None, best=None, distance=None, exact=0):
        import numpy as np
        if not state:
            state["sums"] = np.zeros((k, len(fields) - 1), dtype=np.int64)
        sums = state["sums"]
        if vec_ids is not None:
            order = np.argsort(best, kind="stable")
            found, starts = np.unique(best[order], return_index=True)
            sums[found, 0] += np.diff(np.append(starts, len(best)))
            sums[found, 1] += np.add.reduceat(distance[order], starts)
            sums[found, 3:] += np.add.reduceat(x[order], starts, axis=0)
            sums[found[0], 2] += exact
            return None
        found = np.flatnonzero(sums[:, 0])
        return [found, *sums[found].T] if len(found) else None

    parts = over_vectors(table, centroids, pivots, schema, emit)
    return parts.groupBy("cluster").agg(*[F.sum(f).alias(f) for f in fields[1:]])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2, pivots: int = 12,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster the vectors around at most ``k`` centroids.

    Vectors with other than ``dims`` components, or with a null or non-finite
    one, are left out; components become integers ``floor(256 * x)``, and one
    beyond 2 to the 20th ends the job with an error rather than a wrong sum.
    Centroids start as ``first_centroids``.  Each round assigns every vector
    to the nearest centroid (squared Euclidean distance; ties: the smaller
    number) and moves each centroid that has vectors to the componentwise
    ``floor`` of their mean; then the vectors are assigned once more.

    One row per vector: ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia`` and ``inertia`` (sums of distances over its cluster
    and over all) and ``centroid`` (the components of its final centroid).
    Fewer vectors than ``k`` make fewer centroids; equal centroids leave the
    later one empty; null ids and repeated rows are kept as rows of their
    own; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, dims, id_col, vector_col)
    id_type = kept.schema["vec_id"].dataType
    now = first_centroids(kept, k, seed)
    if not now:
        return spark.createDataFrame([], T.StructType([
            T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()),
            T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()),
            T.StructField("inertia", T.LongType()), T.StructField("centroid", T.ArrayType(T.IntegerType()))]))
    fixed = chosen_pivots(now, pivots)
    schema = T.StructType([T.StructField("vec_id", id_type), T.StructField("q", T.ArrayType(T.IntegerType())),
                           T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, p = to_arrow_schema(schema), np.array(fixed, dtype=np.int64)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.int64)
            d = np.sqrt(np.stack([squared(x, v) for v in p], axis=1).astype(np.float64))
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * len(p)
            rows = pa.ListArray.from_arrays(pa.array(offsets), pa.array(d.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(arrow[1].type),
                                              rows.cast(arrow[2].type)], schema=arrow)

    table = stored(kept.mapInArrow(measure, schema), "pivot-table")
    for _ in range(rounds):
        for r in summed(table, now, fixed).collect():      # at most one row per centroid
            now[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]

    out = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()),
                        T.StructField("distance", T.LongType())])

    def emit(state, vec_ids=None, x=None, best=None, distance=None, exact=0):
        return None if vec_ids is None else [vec_ids, best, distance]

    assigned = stored(over_vectors(table, now, fixed, out, emit), "assigned")
    totals = {r["cluster"]: r["total"] for r in
              assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    # one row per centroid: k bounds what is broadcast
    ends = spark.createDataFrame([(c, t, sum(totals.values()), now[c]) for c, t in sorted(totals.items())],
                                 "cluster int, cluster_inertia long, inertia long, centroid array<int>")
    return assigned.join(F.broadcast(ends), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
